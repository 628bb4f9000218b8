"""Merkle manifest against a plain version, for several arities."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from turnlake.llm import merkle
from turnlake.llm.ranks import ranked


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(digests, arity):
    """The root and each leaf's siblings."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, p in enumerate(proofs):
            first = at[k] - at[k] % arity
            p += [level[j] for j in range(first, min(first + arity, len(level))) if j != at[k]]
            at[k] //= arity
        level = [sha(*level[j : j + arity]) for j in range(0, len(level), arity)]
    return level[0], proofs


def plain(rows, arity):
    groups = {}
    for ident, group, digest in rows:
        groups.setdefault(group, []).append((ident is not None, ident or 0, digest, ident))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([d for _, _, d, _ in sorted(groups[g], key=lambda r: r[:3])], arity) for g in names}
    root, upper = climb([trees[g][0] for g in names], arity)
    out = []
    for k, g in enumerate(names):
        for (_, _, digest, ident), proof in zip(sorted(groups[g], key=lambda r: r[:3]), trees[g][1]):
            out.append((ident, g, digest, trees[g][0], root, "".join(proof + upper[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [2, 3])
@pytest.mark.parametrize("groups", [1, 6])
def test_manifest_matches_plain_version(spark, arity, groups):
    rng = random.Random(arity * 10 + groups)
    names = [None, "", "de", "en", "fr", "ü"][:groups] if groups > 1 else ["en"]
    rows = []
    for k in range(rng.choice([31, 64, 77])):
        g = names[0] if rng.random() < 0.4 else rng.choice(names)
        rows.append((rng.choice([k, k, k, None, 5]), g, leaf(k // 2)))
    if groups > 1:
        rows.append((1000, "zz", leaf("alone")))
    rows += [(7, "en", leaf("same"))] * 3
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string").repartition(5).withColumn("proof", F.lit("x")).withColumn("idx", F.lit(3))
    out = merkle.manifest(df, arity=arity)
    assert out.columns == ["doc_id", "lang", "leaf", "idx", "position", "group_size", "group_position", "groups", "subroot", "root", "proof"]
    got = merkle.verify(out, "leaf", arity=arity).collect()
    assert sorted(((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], bytes(r["proof"]).hex()) for r in got), key=str) == plain(rows, arity)
    assert all(r["folded_root"] == r["root"] and r["idx"] == 3 for r in got)
    wrong = merkle.verify(out.withColumn("leaf", F.reverse("leaf")), "leaf", arity=arity)
    assert wrong.where("folded_root = root").count() == 0


def test_empty_and_single(spark):
    schema = "doc_id long, lang string, leaf string"
    assert merkle.verify(merkle.manifest(spark.createDataFrame([], schema)), "leaf").count() == 0
    one = merkle.verify(merkle.manifest(spark.createDataFrame([(None, None, leaf(1))], schema)), "leaf").collect()[0]
    assert one["subroot"] == one["root"] == one["folded_root"] == leaf(1) and one["proof"] == b""


def test_leaf_of_nulls_and_long_texts(spark):
    rows = [(1, None, "é" * 200_000), (None, "", ""), (2, "x:1", None)]
    got = spark.createDataFrame(rows, "a long, b string, c string").select(merkle.leaf(F.col("a"), F.col("b"), F.col("c")).alias("h")).collect()
    assert [r["h"] for r in got] == [leaf(*r) for r in rows]


def test_ranks(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 2, 2, 2]), rng.choice([None, *range(50)])) for _ in range(500)]
    got = ranked(spark.createDataFrame(rows, "g int, v int").repartition(7), ["g"], ["v"], "test-ranks").collect()
    for g in (None, 1, 2):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}
        assert [r["v"] for r in own] == sorted((r["v"] for r in own), key=lambda v: -1 if v is None else v)
