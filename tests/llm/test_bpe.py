"""Byte-pair encoding and decoding against the library."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnlake.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SIGNS = ["'", "s", "re", "ll", "A", "é", "é", "̧", "1", "²", "Σ", "σ", " ", "\n", "\t", "\x1c", "​", "ß", "İ", "中", "🙂", "-", "_",
         "<|", "|>", "<|endoftext|>", "<|startoftext|>", "Ᲊ", "\U00016d68\U00016d67", "가", "가"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_equals_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["", " ", "a" * 5000, "ab" * 4000, "".join(rng.choice("abcdeéü") for _ in range(20000)), "<|endoftext|>", "x'", "'d\n'll", "''s 's's \"'s 'sab 'rex"]
    own = bpe.vocabulary(PATH)
    flat, at = own.encode(texts)
    want = [ids_of(library, t) for t in texts]
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == want
    lists = pa.array([*want, None, []], pa.list_(pa.int32()))
    assert own.decode(lists).to_pylist() == [*library.decode_batch(want, skip_special_tokens=False), "", ""]


def test_every_character(library):
    texts = [f"x{chr(c)}x1{chr(c)}.{chr(c)}" for c in range(0, 0x20000) if not 0xD800 <= c < 0xE000]
    flat, at = bpe.vocabulary(PATH).encode(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert at.tolist() == np.concatenate(([0], np.cumsum([len(w) for w in want]))).tolist()
    assert flat.tolist() == [v for w in want for v in w]


def test_rows_of_all_kinds(spark, documents, library):
    rows = [(1, None), (1, None), (2, ""), (None, "Some <|endoftext|> text"), (3, "It's A Line\n" * 30_000), (4, " \n\t"), (5, "x" * 200_000)]
    docs = documents(rows).withColumn("ids", F.lit("clash")).withColumn("c0", F.col("doc_id")).withColumn("decoded", F.lit(1))
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "decoded", "ids"]
    out = bpe.decode(coded, PATH)
    got = sorted(((r["doc_id"], r["text"], r["ids"], r["decoded"]) for r in out.collect()), key=lambda r: (r[0] or 0, r[1] or ""))
    want = [(i, t, ids_of(library, t), library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t in rows]
    assert got == sorted(want, key=lambda r: (r[0] or 0, r[1] or ""))
    assert bpe.decode(bpe.encode(documents([]), PATH), PATH).count() == 0


def test_decode_leaves_out_unknown_ids(spark, library):
    lists = [[1, 49407, 60000, 320], [], None, [-5], [49405]]
    out = bpe.decode(spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, ids array<int>"), PATH)
    got = {r["k"]: r["decoded"] for r in out.collect()}
    assert got[0] == library.decode([1, 49407, 320], skip_special_tokens=False) and got[1] == got[2] == got[3] == ""


def test_query_on_whole_table(spark, table, library):
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op13_bpe_round_trip"](spark, _data()).collect()}
    docs = table("documents").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = ids_of(library, d["text"])
        assert got[d["doc_id"]] == (d["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def _data():
    import os

    return os.environ.get("TURNLAKE_TEST_SF", "/root/testdata/sf0.001")


def test_refuses_other_vocabularies(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    held = json.load(open(PATH))
    held["model"]["merges"] = held["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(held))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "v.json"))
