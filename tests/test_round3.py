"""Alignment of whole texts in bit sets, and their blocks."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import _best_counts

from turnlake.operators import scoring as S


def test_pairs_in_strips_and_spans():
    rnd = random.Random(3)
    for _ in range(400):
        letters = "abcde"[: rnd.randrange(1, 6)]
        ref, hyp = ([rnd.choice(letters) for _ in range(rnd.randrange(0, 12))] for _ in range(2))
        substitutions, insertions, deletions = _best_counts(tuple(ref), tuple(hyp))
        for cut in ((1, 1), (2, 3), (3, 2), (8192, 1024)):
            assert S._edit_pair(ref, hyp, *cut) == (substitutions + insertions + deletions, deletions)


def test_long_texts_need_no_stream(spark, monkeypatch):
    rnd = random.Random(4)
    ref = [f"w{rnd.randrange(500)}" for _ in range(17_000)]
    hyp = ["zz" if rnd.random() < 0.02 else w for w in ref if rnd.random() > 0.02]
    side = lambda words: spark.createDataFrame([(1, k, " ".join(words[k * 100 : k * 100 + 100])) for k in range(170)], "k int, seg_id int, text string")
    monkeypatch.setattr(S, "_banded", None)  # texts of this size were streamed through a band of numpy rows
    got = S.document_wer(side(ref), side(hyp), ["k"]).first()
    numbers = {w: i for i, w in enumerate({*ref, *hyp})}
    coded = [np.array([numbers[w] for w in t]) for t in (ref, hyp)]
    cost, dels = S._edit_batch(coded[:1], coded[1:])[0]
    assert (got.num_errors, got.deletions, got.num_words) == (cost, dels, len(ref))


def test_text_blocks_keep_the_order_of_segments(spark):
    segments = [(1, 70, "g h"), (1, 0, "A, b"), (1, 3, None), (1, 5, " ... "), (1, 64, "f"), (1, 9, "c d e"), (2, 1, ""), (2, 70, None)]
    df = spark.createDataFrame(segments, "k int, seg_id int, text string")
    got = {r.b: r.toks for r in S.text_blocks(df, ["k"], 3).collect() if r.k == 1}
    want = [r[0] for r in spark.createDataFrame([(c,) for c in "abcdefgh"], "w string").select(F.xxhash64("w")).collect()]
    assert got == {0: want[:3], 1: want[3:6], 2: want[6:]}
    assert S.text_blocks(df, ["k"], 3).filter("k = 2").count() == 0
