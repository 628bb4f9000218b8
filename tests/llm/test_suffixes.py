"""Suffix dedup: runs of windows, the memory of a pass, and spans of copies that lie side by side."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from test_text_operators import brute_spans

from turnlake.llm import suffixes
from turnlake.llm import text as tx


def test_runs_name_every_window_once():
    rng = np.random.default_rng(4)
    match, seed = 60, 8
    for alphabet in (2, 26, 250):
        size = np.array([0, 59, 60, 0, 61, 500, 1, 700, 60, 0])
        offsets = np.concatenate(([0], np.cumsum(size)))
        data = rng.integers(0, alphabet, offsets[-1]).astype(np.uint8)
        data[offsets[7] : offsets[7] + 300] = data[offsets[5] + 100 : offsets[5] + 400]
        runs = [a.tolist() for a in suffixes.anchors(tx.Sums(data), offsets, match, seed)]
        windows, places = [], {}
        for row, anchor, first, last in zip(*runs):
            for w in range(first, last + 1):
                assert offsets[row] <= w <= offsets[row + 1] - match and w <= anchor <= w + match - seed
                windows.append(w)
                places.setdefault(data[w : w + match].tobytes(), set()).add(anchor - w)
        assert windows == [w for a, b in zip(offsets, offsets[1:]) for w in range(a, b - match + 1)]
        assert all(len(p) == 1 for p in places.values())


def test_a_pass_holds_few_bytes_at_once():
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(8_000)) for _ in range(250)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array(texts)], ["id", "text"])
    for _ in suffixes._text_cells(batch, 128, 400, 32):  # powers are kept from call to call
        pass
    tracemalloc.start()
    for _ in suffixes._text_cells(batch, 128, 400, 32):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # 2 MB of text in one piece took more than 100 MB


def test_copies_side_by_side_match_brute_force(documents):
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choice("abcdef é") for _ in range(n))
    whole, long = letters(600), letters(2500)
    rows = [(k, whole) for k in range(30)] + [(None, whole), (None, whole), (40, whole), (40, long), (41, long + letters(30)), (42, letters(900))]
    rows += [(50 + k, letters(rng.randint(0, 300)) + long[k * 100 : k * 100 + 420 + k] + letters(rng.randint(0, 300))) for k in range(12)]
    rows += [(70, ""), (71, None), (72, letters(399)), (73, whole + long), (74, long + whole)]
    for parts in (1, 7):
        got = suffixes.remove_repeats(documents(rows).repartition(parts)).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_spans(rows, 400)
