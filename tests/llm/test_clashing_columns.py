"""Operators that carry other columns take any names for them, their own internal ones included."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnlake.llm import lines, minhash, mixing

NAMES = ["_id", "_h", "_rows", "_own", "_key", "_places", "_nth", "_times", "_copy", "_copies", "_source", "_quality", "id", "h", "own", "key", "places", "of",
         "of_text", "of_source", "row", "rest", "rows", "n_rows", "copies", "copy", "times", "nth", "label", "k", "last", "bits", "size", "score", "p", "held_out"]


@pytest.fixture(scope="module")
def plain(documents):
    long = "a line that five documents share and that is long enough"
    rows = [(k, f"{long}\n" + " ".join(f"w{(k // 2) * 10 + j}" for j in range(12)), "s" if k % 3 else None) for k in range(12)]
    return documents([*rows, (None, None), (12, ""), (12, "")])


@pytest.fixture(scope="module")
def clashing(plain):
    return plain.withColumns({n: F.concat(F.lit(f"{n}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in NAMES})


@pytest.mark.parametrize("name, run", [("lines", lines.dedup_lines), ("near", minhash.drop_near), ("mix", mixing.mix)])
def test_other_columns_are_carried(plain, clashing, name, run):
    own = run(plain)
    out = run(clashing)
    assert [c for c in out.columns if c not in NAMES] == own.columns
    assert sorted(map(tuple, out.drop(*NAMES).collect()), key=str) == sorted(map(tuple, own.collect()), key=str)
    for r in out.collect():
        ident = "-" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[n] == f"{n}:{ident}" for n in NAMES)


def test_quality_stage_carries_them(spark, tmp_path, plain, clashing):
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.quality(spark, clashing, str(tmp_path))
    assert out.columns == clashing.columns
    assert all(r["_quality"] == f"_quality:{'-' if r['doc_id'] is None else r['doc_id']}" for r in out.collect())
