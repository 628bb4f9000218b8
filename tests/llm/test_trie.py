"""Prefix trie of conversations against a plain version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from turnlake.llm import trie


def plain(sequences):
    """Nodes of {conv: [(role, text), ..]}."""
    members, ends = {}, {}
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        ends.setdefault(tuple(s), []).append(c)
    children = {}
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        kids = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in kids) or 1
        saved[k] = sum(saved[x] for x in kids) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(children.get(k, [])), leaves[k], saved[k], sha(ends.get(k, [])))
        for k, m in members.items()
    )


def got(df):
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.select(*names).collect())


def tables(spark, sequences):
    rows = [(c, j, f"{r}|{t}".encode(), len(t.encode())) for c, s in sequences.items() for j, (r, t) in enumerate(s, 1)]
    lengths = [(c, len(s)) for c, s in sequences.items()]
    return (spark.createDataFrame(rows, "conv long, j long, digest binary, bytes long").repartition(3),
            spark.createDataFrame(lengths, "conv long, len long"))


def sequences(seed, count, words="abc", longest=7):
    rng = random.Random(seed)
    out = {}
    for c in rng.sample(range(-50, 5 * count), count):
        out[c] = [("u", rng.choice(words) * rng.randint(1, 2)) for _ in range(rng.randint(0, longest))]
    hot = [("u", "hot"), ("a", "é"), ("u", "x")]
    for c in rng.sample(sorted(out), count // 3):
        out[c] = hot[: rng.choice([3, 3, 3, 2])] + out[c][: rng.choice([0, 0, 0, 2])]
    return out


@pytest.mark.parametrize("seed, group, fan, block", [(1, 1000, 16, 256), (2, 7, 3, 256), (3, 1, 2, 2), (4, 5, 2, 1), (5, 10, 16, 3)])
def test_trie_matches_plain_version(spark, seed, group, fan, block):
    all_rows = sequences(seed, 90)
    out = trie.prefix_trie(*tables(spark, all_rows), block=block, group=group, fan=fan)
    assert got(out) == plain(all_rows)


def test_long_conversations_and_chunks(spark, monkeypatch):
    rng = random.Random(9)
    base = [("u", str(rng.random())) for _ in range(900)]
    rows = {1: base, 2: base, 3: base[:700], 4: base[:512], 5: [*base[:512], ("u", "other")], 6: base[:256], 7: [], 8: base[::-1]}
    rows |= {c: [("u", "copy")] for c in range(100, 160)}
    monkeypatch.setattr(trie, "SPAN", 100)
    assert got(trie.prefix_trie(*tables(spark, rows), group=4, fan=2)) == plain(rows)


def test_forests_merge_like_one(spark):
    """The step alone, over random edges: groups of any size give the nodes that one group gives."""
    rng = random.Random(4)
    for _ in range(60):
        rows = sorted([rng.choice("ab") for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 40)))
        lcp = [-1] + [next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b))) for a, b in zip(rows, rows[1:])]
        n = len(rows)
        fields = {"id": range(n), "rep": range(n), "depth": map(len, rows), "n": [1] * n, "low": range(n), "net": [0] * n, "leaves": [0] * n,
                  "children": [0] * n, "ends": [1] * n, "lcp": lcp, "shared": [max(0, v) for v in lcp]}
        fields = {k: np.array(list(v)) for k, v in fields.items()}
        want = sorted((r[3], *r[6:12]) for r in trie.forest(fields, True, iter(range(10**6, 10**7))) if r[0] == trie.NODE)
        numbers, nodes, step = iter(range(10**6, 10**7)), [], fields
        while len(step["id"]) > 1 and rng.random() < 0.9:
            cuts = sorted({0, len(step["id"]), *(rng.randrange(len(step["id"])) for _ in range(3))})
            items = []
            for a, b in zip(cuts, cuts[1:]):
                out = trie.forest({k: v[a:b] for k, v in step.items()}, False, numbers)
                nodes += [r for r in out if r[0] == trie.NODE]
                items += [r for r in out if r[0] == trie.ITEM]
            step = {f: np.array([r[k] for r in items]) for k, f in enumerate(trie.FIELDS)}
        nodes += [r for r in trie.forest(step, True, numbers) if r[0] == trie.NODE]
        assert sorted((r[3], *r[6:12]) for r in nodes) == want


def rebuild(conversations, every=5, heads=9):
    own = {}
    for c, turn, role, text in conversations:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % heads for c in own}
    return {c: own.get(c - c % every, [])[: h[c]] + own[c][h[c] :] for c in own}


def test_query_steps_with_nulls(spark):
    rng = random.Random(6)
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 10)):
            rows.append((c, rng.choice([None, t]) if t == 0 else t, rng.choice(["user", None, ""]), rng.choice(["", None, "same", f"own {rng.random()}", "ü" * 3])))
    rows = [r for r in rows if r[0] not in (5, 20)] + [(None, 1, "user", "nobody"), (2**40, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("turn", "rank2")
    df = df.withColumnRenamed("rank2", "turn").selectExpr("*", "1 as rank", "2 as conv", "3 as j")
    assert got(trie.prefix_trie(*trie.rebuilt(trie.turns(df)), group=6)) == plain(rebuild(rows))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(*trie.rebuilt(trie.turns(df))).count() == 0
    only = spark.createDataFrame([(3, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert got(trie.prefix_trie(*trie.rebuilt(trie.turns(only)))) == plain(rebuild([(3, 0, "user", "a")]))
