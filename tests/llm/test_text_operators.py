"""Line dedup, near dedup, suffix dedup, quality rules and classifier against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.llm import classifier, lines, minhash, rules, suffixes
from turnlake.llm import text as tx
from turnlake.llm.components import labels
from turnlake.llm.twins import bits_for, twice_seen

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = " \t\n\v\f\r"
ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (None, "a line without an id " * 4), (None, "a line without an id " * 4)]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- lines -------------------------------------------------------------------------------------------------

def brute_lines(rows):
    key = lambda s: lower(s.strip(BLANK))
    holders = defaultdict(list)
    for i, (ident, text) in enumerate(rows):
        for k in {key(s) for s in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(ident)
    last = {k: max((v for v in ids if v is not None), default=None) for k, ids in holders.items() if len(ids) >= 5}
    out = []
    for ident, text in rows:
        all_lines = (text or "").split("\n")
        kept = [s for s in all_lines if key(s) not in last or last[key(s)] == ident]
        out.append((ident, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_match_brute_force(documents):
    rng = random.Random(5)
    common = ["Shared Line number %d with quite some more words äö in it" % k for k in range(6)] + ["short line"]
    rows = []
    for k in range(80):
        parts = [rng.choice(common) if rng.random() < 0.4 else f"own words {k} {rng.random()} and some more text to be long" for _ in range(rng.randint(0, 6))]
        rows.append((k, "\n".join(p.upper() + "  " if rng.random() < 0.2 else p for p in parts)))
    rows += ODD + [rows[3], (1000, "x" * 300_000 + "\n" + common[0])]
    got = lines.dedup_lines(documents(rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows)


def test_lines_empty_table_and_clashing_columns(documents):
    docs = documents([]).withColumn("n_lines", F.lit("x"))
    out = lines.dedup_lines(docs)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]


def test_twins_never_miss(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 4000, 6000)
    df = spark.createDataFrame([(int(v),) for v in values], "v long").repartition(7)
    hashes = lambda b: iter([tx.mix(b.column(0).to_numpy().astype(np.uint64))])
    found = twice_seen(df, hashes, bits_for(6000))
    distinct, count = np.unique(values, return_counts=True)
    suspect = found.suspects(tx.mix(distinct.astype(np.uint64)))
    assert suspect[count > 1].all()
    assert suspect[count == 1].mean() < 0.1


# --- near documents ----------------------------------------------------------------------------------------

def shingle_set(text, size):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute_near(rows, size, percent=80):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    best = {}
    for k, (ident, _) in enumerate(rows):
        if ident is not None:
            best[root(k)] = min(best.get(root(k), ident), ident)
    return sorted(((i, len(s), best.get(root(k), None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def near_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.2 else "  ".join(copy)))
    return rows + ODD


@pytest.mark.parametrize("size", [2, 5])
def test_near_documents_match_brute_force(documents, size):
    rows = near_rows()
    got = minhash.near_documents(documents(rows), shingle=size).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_document_of_each_group_stays(documents):
    rows = near_rows(2)
    rows += [rows[0], rows[0]]
    kept = minhash.drop_near(documents(rows), shingle=5).collect()
    want = brute_near(rows, 5)
    groups = {c for i, n, c in want if n}
    assert Counter(r.doc_id for r in kept if WORD.search(r.text or "")) == Counter(groups)
    assert sum(1 for r in kept if not WORD.search(r.text or "")) == 3


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 62, 900).astype(np.uint64))
    b = np.concatenate((a[:800], rng.integers(0, 1 << 62, 100).astype(np.uint64)))
    both = np.concatenate((a, b, a[:1]))
    s = minhash.sketch(both, np.array([0, len(a), len(a) + len(b), len(both)]))
    assert (s != minhash._EMPTY).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.1


def test_long_sketch_keeps_filled_bins():
    rng = np.random.default_rng(0)
    for common, own in ((8, 1), (9, 1), (18, 2), (22, 2), (26, 3)):
        drawn = rng.integers(0, 1 << 62, (40, common + 2 * own)).astype(np.uint64)
        left, right = drawn[:, : common + own], np.concatenate((drawn[:, :common], drawn[:, common + own :]), axis=1)
        n = common + own
        s = minhash.sketch(np.concatenate((left, right)).ravel(), np.arange(81) * n, minhash.FINE)
        bits = minhash._one_bit(s)
        apart = np.unpackbits((bits[:40] ^ bits[40:]).view(np.uint8), axis=1).sum(axis=1)
        assert (apart <= 391).all()  # the limit of _far at 80 percent
        assert abs((s[:40] == s[40:]).mean() - common / (common + 2 * own)) < 0.03


def test_hot_buckets_of_short_documents_match_brute_force(documents):
    # Even documents link with one another (26 / 32), odd ones with their twin only (27 / 32; others 26 / 33 or less).
    rows = []
    for k in range(160):
        core = [f"core{i}" for i in range(26)] + [f"twin{k // 2}"]
        rows.append((k, " ".join(core + [f"own{k}-{i}" for i in range(2 + k % 2)])))
    got = minhash.near_documents(documents(rows), shingle=1).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_near(rows, 1)


def test_near_empty_table(documents):
    assert minhash.near_documents(documents([])).count() == 0
    assert minhash.drop_near(documents([])).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 3)]
    got = {r.node: r.label for r in labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(range(61)) | {100, 101}
    assert len({got[k] for k in range(61)}) == 1 and got[100] == got[101] != got[0]


# --- repeated spans ----------------------------------------------------------------------------------------

def brute_spans(rows, match):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + match] for b in data for k in range(len(b) - match + 1))
    out = []
    for (ident, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - match + 1):
            if seen[b[k : k + match]] > 1:
                gone[k : k + match] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + (len(gone) > 0 and gone[0]))
        out.append((ident, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def test_spans_match_brute_force(documents):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [letters(n) for n in (90, 399, 400, 401, 450, 700, 1500)]
    rows = []
    for k in range(40):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += letters(rng.randint(0, 500))
            if rng.random() < 0.7:
                text += rng.choice(passages)[rng.choice([0, 0, 17]) :]
        rows.append((k, text))
    rows += ODD + [(800, "z" * 900), (801, "ab" * 700), rows[5], (802, passages[6] * 3)]
    got = suffixes.remove_repeats(documents(rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got), key=str) == brute_spans(rows, 400)


def test_spans_of_a_text_longer_than_a_slice(documents, monkeypatch):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(600))
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = [(0, noise(5_000_000) + passage + noise(100)), (1, noise(50) + passage)]
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in suffixes.remove_repeats(documents(rows)).collect()}
    assert got == {0: (600, 1), 1: (600, 1)}


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 12))}) for _ in range(rng.randint(1, 6))]
        out = list(suffixes.merge([iter([(a, b, 0) for a, b in suffixes.front_code(r)]) for r in runs]))
        assert [t for t, _, _ in out] == sorted(t for r in runs for t in r)
        assert all(same == suffixes.lcp(out[k][0], t, 0) for k, (t, same, _) in enumerate(out[1:]))


# --- quality -----------------------------------------------------------------------------------------------

def brute_stats(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    hit = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_statistics_match_brute_force(documents, table):
    rows = [(r.doc_id, r.text) for r in table("documents").select("doc_id", "text").collect()]
    rows += ODD + [(1, "a b c d e f g h " * 3), (2, "é# é#\né# é#\n\n\nx"), (3, "w" * 100_000)]
    got = rules.statistics(documents(rows)).select("doc_id", *rules.STATS[:5]).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute_stats(t)) for i, t in rows), key=str)


def test_rules_agree_with_labels(table):
    marks = table("labels").select("doc_id", F.col("quality").alias("q"))
    kept = rules.quality_rules(table("documents")).join(marks, "doc_id")
    shares = {r.q: r.share for r in kept.groupBy("q").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert shares[1] > 0.95 and shares[0] < 0.2


def test_rules_fit_is_bounded_and_total(documents):
    assert rules.quality_rules(documents([])).count() == 0
    weight = rules.fit([], 3)
    assert weight.shape == (3, 3)
    out = rules.quality_rules(documents(ODD)).collect()
    assert len(out) == len(ODD) and all(0 <= r.quality <= 1 for r in out)


def test_classifier_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, marks = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    weights = classifier.fit(docs, marks, usable=~held)
    rows = classifier.score(docs, weights).join(marks.where(held), "doc_id").select("score", "quality").collect()
    right = [(r.score >= 0.3) == bool(r.quality) for r in rows]
    assert len(rows) > 40 and np.mean(right) > 0.93


def test_classifier_edges(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = classifier.fit(documents(ODD), none)
    out = classifier.score(documents(ODD).withColumn("score", F.lit("old")), weights).collect()
    assert len(out) == len(ODD) and all(r.score == 0.5 for r in out)
    assert classifier.score(documents([]), weights).count() == 0
    marks = spark.createDataFrame([(900, 1), (903, 0), (903, None), (None, 1)], "doc_id long, quality int")
    assert len(classifier.score(documents(ODD), classifier.fit(documents(ODD), marks)).collect()) == len(ODD)


def test_features_match_a_plain_count():
    text = "Ab, ab!! cd 12 " * 3
    data = np.frombuffer(text.encode(), np.uint8)
    index, begin, value = classifier.features(data, np.array([0, len(data)]))
    tokens = re.findall(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]+", text)
    fives = Counter(tuple(tokens[k : k + 5]) for k in range(len(tokens) - 4))
    assert begin[-1] == 2 * len(tokens) - 1 + sum(n - 1 for n in fives.values())
    assert value[0] == classifier.SCALE / len(tokens)
    assert zlib.crc32(index.tobytes()) == zlib.crc32(classifier.features(data, np.array([0, len(data)]))[0].tobytes())
