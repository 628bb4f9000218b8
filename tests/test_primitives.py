"""Scans, intervals, rounding and blocks against brute force."""

import math
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions import text as X
from turnlake.functions.intervals import floor_div, last_writer_cells, owner_spans, union_lengths
from turnlake.functions.ordered import islands, prefix_scan, top_n, trailing


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(3)
    # One key holds most rows.
    data = [(0 if rnd.random() < 0.7 else rnd.randrange(1, 5), i, rnd.choice([None, 1, 2, 3]), rnd.choice("ab")) for i in range(500)]
    return spark.createDataFrame(data, "k int, t bigint, v int, s string")


def test_prefix_scan_equals_plain_window(series):
    got = prefix_scan(
        series, ["k"], ["t"], floor_div(F.col("t"), 37), sums={"n": F.lit(1), "sv": F.col("v")}, maxes={"m": F.col("v")},
        prevs={"p": F.col("v")}, nexts={"x": F.col("v")},
    ).select("k", "t", "n", "sv", "m", "p", "x")
    w = W.partitionBy("k").orderBy("t")
    b = w.rowsBetween(W.unboundedPreceding, -1)
    want = series.select(
        "k", "t", F.count(F.lit(1)).over(b), F.coalesce(F.sum("v").over(b), F.lit(0)), F.max("v").over(b), F.lag("v").over(w), F.lead("v").over(w)
    )
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_islands(series):
    got = islands(series, ["k"], ["t"], floor_div(F.col("t"), 23), F.col("s")).select("k", "t", "s", "island").collect()
    by = {}
    for k, t, s, island in sorted(map(tuple, got)):
        last, n = by.get(k, (None, -1))
        n = n + 1 if s != last else n
        assert island == n
        by[k] = (s, n)


def test_trailing(series):
    got = {(r.k, r.t): r.a for r in trailing(series, ["k"], "t", 15, 40, {"a": F.count("v")}).collect()}
    data = [tuple(r) for r in series.collect()]
    assert len(got) == len(data)
    for k, t, _, _ in data:
        assert got[k, t] == sum(1 for a, b, v, _ in data if a == k and t - 15 <= b < t and v is not None)


def test_top_n_prunes_before_shuffle(series):
    plan = top_n(series, ["k"], [F.col("t")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def _turns(rnd, n, span=400):
    out = []
    for i in range(n):
        s = rnd.randrange(0, span)
        out.append((rnd.randrange(2), i, s, s + rnd.randrange(0, 60), rnd.choice("ABC"), i))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_owner_spans(spark, seed):
    data = _turns(random.Random(seed), 60)
    df = spark.createDataFrame(data, "episode_id int, turn_id int, start_ms bigint, end_ms bigint, speaker string, ord int")
    got = {}
    for r in owner_spans(df, ["speaker"]).collect():
        for t in range(r.own_start, r.own_end):
            assert (r.episode_id, t) not in got  # disjoint
            got[r.episode_id, t] = r.speaker
    for ep in (0, 1):
        for t in range(470):
            act = sorted((s, e, i, who) for k, i, s, e, who, _ in data if k == ep and s <= t < e)
            assert got.get((ep, t)) == (act[0][3] if act else None)


@pytest.mark.parametrize("seed", [5, 6])
def test_cells_and_unions(spark, seed):
    rnd = random.Random(seed)
    data = [(*t, rnd.choice("rh")) for t in _turns(rnd, 60)]
    df = spark.createDataFrame(data, "episode_id int, turn_id int, start_ms bigint, end_ms bigint, speaker string, ord int, side string")
    frames = {}
    for ep, _, s, e, who, o, side in sorted(data, key=lambda x: x[5]):
        for t in range(s, e):
            frames[ep, t, side] = who
    got = {}
    for r in last_writer_cells(df, "side", ["r", "h"], bucket_ms=50).collect():
        for t in range(r.start_ms, r.end_ms):
            for side in "rh":
                who = r[f"who_{side}"]
                if who is not None:
                    got[r.episode_id, t, side] = who
    assert got == frames
    for r in union_lengths(df, ["episode_id", "speaker"], "side", ["r", "h"]).collect():
        ticks = {s: set() for s in "rh"}
        for ep, _, s, e, who, _, side in data:
            if (ep, who) == (r.episode_id, r.speaker):
                ticks[side] |= set(range(s, e))
        assert (r.len_r, r.len_h, r.len_all) == (len(ticks["r"]), len(ticks["h"]), len(ticks["r"] | ticks["h"]))


def test_exact_round_is_decimal_round(spark):
    rnd = random.Random(1)
    xs = [k / n for n in (8, 16, 32, 64, 160, 625, 999) for k in range(0, 40)] + [rnd.random() * 50 for _ in range(500)] + [0.00725, 0.125, 0.145, 2.675, 1.005]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", X.exact_round(F.col("x"), 4).alias("r4"), X.exact_round(F.col("x"), 2).alias("r2"), X.fixed2(F.col("x")).alias("f")).collect():
        assert r.r4 == round(r.x, 4) and r.r2 == round(r.x, 2) and r.f == f"{r.x:.2f}", r
    inf = spark.createDataFrame([(math.inf,)], "x double").select(X.exact_round(F.col("x"), 4)).first()[0]
    assert inf == math.inf


def test_shared_dir_is_the_named_one(spark):
    from turnlake.session import scratch_path

    named = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(named) and scratch_path(spark, "x") != scratch_path(spark, "x")
