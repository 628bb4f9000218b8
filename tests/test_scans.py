"""Runs and chains in two shuffles, and overlap totals by sweep, against plain versions."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from turnlake.functions.ordered import runs
from turnlake.operators import alignment as A
from turnlake.operators import masks as M


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


@pytest.mark.parametrize("width", [3, 50, 10_000])
def test_runs_over_bucket_borders(spark, width):
    rnd = random.Random(width)
    rows = [(k, t, rnd.choice(["a", "a", "a", "b", None]), rnd.choice([1, 2, None])) for k in (1, None) for t in sorted(rnd.sample(range(400), 120))]
    df = spark.createDataFrame(rows, "k int, t int, s string, v int").repartition(4)
    got = runs(df, ["k"], ["t"], F.floor(F.col("t") / width), F.col("s"),
               {"lo": (F.min("t"), F.min), "n": (F.count("v"), F.sum), "most": (F.max("v"), F.max)})
    want = []
    for k in (1, None):
        island, last = -1, "no label"
        for _, t, s, v in (r for r in rows if r[0] == k):
            if s != last:
                island, last = island + 1, s
                want.append([k, island, s, t, 0, None])
            want[-1][4] += v is not None
            want[-1][5] = max(x for x in (want[-1][5], v, -1) if x is not None) if (v is not None or want[-1][5] is not None) else None
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)


def test_detection_needs_two_shuffles(spark):
    frames = spark.createDataFrame([(1, 0, "a", -20.0, 0.5, 900.0)], "episode_id int, t_ms long, label string, rms_db double, flatness double, centroid_hz double")
    assert exchanges(M.detect_masks(frames, 10)) <= 2
    masks = spark.createDataFrame([(1, "tone", 0, 0, 10, 0.5)], "episode_id int, type string, mask_id int, start_ms long, end_ms long, conf double")
    assert exchanges(M.merge_masks(masks)) <= 2


def test_chains_reach_over_buckets(spark):
    rnd = random.Random(4)
    rows = []
    for k in range(300):
        start = rnd.randrange(0, 3_000_000)
        rows.append((rnd.choice([1, None]), rnd.choice(["x", "y"]), k, start, start + rnd.choice([10, 100, 1_000, 900_000]), rnd.random()))
    df = spark.createDataFrame(rows, "episode_id int, type string, mask_id int, start_ms long, end_ms long, conf double")
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        reach = None
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[3], r[4], r[2])):
            if reach is None or r[3] - reach >= 120:
                want.append([*key, r[3], r[4], 0])
                reach = r[4]
            reach = max(reach, r[4])
            want[-1][3], want[-1][4] = reach, want[-1][4] + 1
    want = [w for w in want if w[4] > 1 or w[3] - w[2] >= 80]
    got = M.merge_masks(df).select("episode_id", "type", "start_ms", "end_ms", "members").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("width, rows_held", [(60_000, 4096), (700, 3)])
def test_overlap_totals_are_sums_of_pairs(spark, monkeypatch, width, rows_held):
    monkeypatch.setattr(A, "SWEEP_ROWS", rows_held)
    rnd = random.Random(1)
    turns = []
    for k in range(200):
        start = rnd.randrange(0, 20_000)
        turns.append((rnd.choice([1, 2]), k, rnd.choice(["a", "b", "c", None]), start, start + rnd.choice([0, 50, 400, 9_000, -5])))
    turns += [(3, 900 + k, f"s{k % 3}", 0, 1000) for k in range(1000)]  # all of them at once
    df = spark.createDataFrame(turns, "episode_id int, turn_id int, speaker string, start_ms long, end_ms long")
    want = defaultdict(int)
    for i, x in enumerate(turns[:200]):
        for y in turns[:i]:
            both = min(x[4], y[4]) - max(x[3], y[3])
            if x[0] == y[0] and x[2] and y[2] and x[2] != y[2] and both > 0:
                want[x[0], *sorted((x[2], y[2]))] += both
    want |= {(3, "s0", "s1"): 334 * 333 * 1000, (3, "s0", "s2"): 334 * 333 * 1000, (3, "s1", "s2"): 333 * 333 * 1000}
    got = {tuple(r)[:3]: r.overlap_ms for r in A.overlap_totals(df, width).collect()}
    assert got == dict(want)


def test_overlap_totals_pay_no_python_call_for_each_bucket(spark):
    """A call of pandas for every minute of every recording was nearly all of the time."""
    turns = spark.range(400).selectExpr(
        "id div 2 as episode_id", "id as turn_id", "if(id % 2 = 0, 'a', 'b') as speaker", "0L as start_ms", "130000L as end_ms")
    got = A.overlap_totals(turns)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
    assert {(r.episode_id, r.a_speaker, r.b_speaker, r.overlap_ms) for r in got.collect()} == {(k, "a", "b", 130_000) for k in range(200)}
