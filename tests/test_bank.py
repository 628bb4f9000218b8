"""The vector index against brute force; identification notes; the versioned bank over batches and replays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import bank as B
from turnlake.operators import vector_index as V
from turnlake.sources.bank_store import BankStore

BANK = "emb_id bigint, speaker_id int, display_name string, vec array<double>, created bigint, show string"
TURNS = "episode_id int, turn_id int, speaker string, start_ms bigint, end_ms bigint"


def unit(m):
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, np.inf, n)[:, None]


def clustered(rnd, dims, centres, each, spread):
    base = rnd.normal(size=(centres, dims))
    return np.concatenate([c + spread * rnd.normal(size=(each, dims)) for c in base])


@pytest.mark.parametrize("spread, cell", [(0.05, 8), (1.0, 16)])
def test_search_is_exact_and_opens_few_cells(spark, monkeypatch, spread, cell):
    rnd = np.random.default_rng(3)
    vecs = clustered(rnd, 12, 10, 20, spread)
    vecs[5] = vecs[60]
    vecs[7] = 0
    ask = np.concatenate([vecs[::9] + 0.01 * rnd.normal(size=(23, 12)), vecs[60:61], np.zeros((1, 12)), -vecs[:2]])
    rows = [(i, i % 7, f"S{i % 7}", vecs[i].tolist(), i, "ab"[i % 2]) for i in range(len(vecs))]
    bank = spark.createDataFrame(rows, BANK)
    queries = spark.createDataFrame([(str(i), v.tolist(), "ab"[i % 2]) for i, v in enumerate(ask)], "qid string, vec array<double>, show string")
    monkeypatch.setattr(B, "BANK_BLOCK", cell)
    monkeypatch.setattr(B, "GROUP_ROWS", 5)
    sims = np.round(unit(ask) @ unit(vecs).T, 12)
    for by in ((), ("show",)):
        got, report = B.match_bank_report(queries, bank, 0.9, 0.5, -1.0, by)
        got = {r.qid: r for r in got.collect()}
        for q in range(len(ask)):
            allowed = [i for i in range(len(vecs)) if not by or i % 2 == q % 2]
            best = min(allowed, key=lambda i: (-sims[q, i], f"s{i % 7}", -i, i))
            assert got[str(q)].sim == sims[q, best] and got[str(q)].emb_id == (best if sims[q, best] >= 0 else None)
        r = report.first()
        assert 0 < r.opened <= r.possible
        if spread < 1:
            assert r.opened < 0.35 * r.possible


def test_what_travels_grows_with_blocks_and_not_with_queries_times_bands(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    bank = spark.createDataFrame([(i, 1, "x", v.tolist(), i, "a") for i, v in enumerate(rnd.normal(size=(200, 32)))], BANK)
    queries = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rnd.normal(size=(100, 32)))], "qid string, vec array<double>")
    monkeypatch.setattr(B, "BANK_BLOCK", 50)
    written, settle = {}, V.settle

    def seen(df, label):
        written[label] = settle(df, label)
        return written[label]

    monkeypatch.setattr(V, "settle", seen)
    assert B.match_bank(queries, bank, low=-1.0).count() == 100
    assert "vec" not in written["vectors-more"].columns
    assert written["vectors-more"].count() <= 40  # at most 4 blocks of up to 100 queries and 8 units


def test_without_the_table_of_bands(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    vecs = rnd.normal(size=(50, 6))
    bank = spark.createDataFrame([(i, 1, "x", v.tolist(), i, "a") for i, v in enumerate(vecs)], BANK)
    queries = spark.createDataFrame([("1", vecs[3].tolist(), "a"), ("2", vecs[4].tolist(), "nowhere")], "qid string, vec array<double>, show string")
    monkeypatch.setattr(V, "MAX_BANDS", 0)
    got = {r.qid: r.emb_id for r in B.match_bank(queries, bank, by=("show",)).collect()}
    assert got == {"1": 3}
    assert B.match_bank(queries, bank.where("false")).count() == 0
    assert B.match_bank(queries.where("false"), bank).count() == 0


def test_pooling(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.5, 0.5]), (2, None), (3, [1.0, None]), (None, [2.0, 2.0])]
    got = {r.k: r.vec for r in B.pool_vectors(spark.createDataFrame(rows, "k int, vec array<double>"), ["k"]).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.5, 0.5], None: [2.0, 2.0]}


def batch(spark, episode, clusters):
    """Turns and one vector per cluster: {cluster: (segments, vector or None)}."""
    turns = [(episode, k * 100 + i, c, i * 2000, i * 2000 + 1500) for k, (c, (n, _)) in enumerate(clusters.items()) for i in range(n)]
    vectors = [(episode, c, v) for c, (_, v) in clusters.items() if v is not None]
    return spark.createDataFrame(turns, TURNS), spark.createDataFrame(vectors, "episode_id int, cluster_id string, vec array<double>")


def state(store, version=None):
    profiles = {r.key: (r.display_name, r.total_segments, r.auto_registered) for r in store.profiles(version).collect()}
    vectors = sorted((r.key, r.source_episode, r.cluster_id, r.created) for r in store.vectors(version).collect())
    return profiles, vectors


def test_two_batches_and_a_replay(spark, tmp_path):
    store = BankStore(spark, str(tmp_path / "bank"), buckets=4)
    one = batch(spark, 1, {"S0": (4, [1.0, 0.0, 0.0]), "S1": (3, [0.0, 1.0, 0.0]), "S2": (2, [0.0, 0.0, 1.0]), "S3": (5, None)})
    got = {r.cluster_id: r for r in B.learn(store, "b1", *one).collect()}
    assert set(got) == {"S0", "S1", "S3"}  # S2 has too few segments
    assert got["S0"].auto_registered and got["S0"].speaker_key == "auto_1_s0" and got["S0"].notes == []
    assert got["S3"].speaker_key is None and got["S3"].notes == [B.NO_AUDIO] and not got["S3"].auto_registered
    first = state(store)
    assert first[0] == {"auto_1_s0": ("Unknown Speaker S0", 0, True), "auto_1_s1": ("Unknown Speaker S1", 0, True)}

    two = batch(spark, 2, {"A": (6, [0.99, 0.1, 0.0]), "B": (3, [0.1, 0.7, 0.7]), "C": (3, [0.0, 0.6, 0.8])})
    before = {r.cluster_id: r for r in B.learn(store, "b2", *two).collect()}
    assert before["A"].speaker_key == "auto_1_s0"
    assert before["B"].confidence_level == "low" and before["B"].notes == ["Similarity 0.704 classified as low; review recommended."]
    second = state(store)
    assert second[0]["auto_1_s0"][1] == 6 and second[0]["auto_1_s1"][1] == 6
    assert len(second[1]) == 5 and store.version() == 2
    again = {r.cluster_id: r for r in B.learn(store, "b2", *two).collect()}
    assert {c: tuple(r) for c, r in again.items()} == {c: tuple(r) for c, r in before.items()}
    assert state(store) == second and state(store, 1) == first and store.version() == 2


def test_newest_vectors_stay(spark, tmp_path):
    store = BankStore(spark, str(tmp_path / "bank"), buckets=2)
    for episode in range(4):
        B.learn(store, f"b{episode}", *batch(spark, episode, {"S": (3, [1.0, 0.01 * episode])}), keep=2)
    profiles, vectors = state(store)
    assert [v[1] for v in vectors] == ["2", "3"] and list(profiles.values())[0][1] == 9
    B.learn(store, "heard again", *batch(spark, 3, {"S": (3, [1.0, 0.5])}), keep=2)
    assert [(v[1], v[3]) for v in state(store)[1]] == [("2", 3), ("3", 5)]
    assert store.bank().count() == 2 and store.bank(1).count() == 1


def test_a_failed_write_stays_unseen(spark, tmp_path):
    store = BankStore(spark, str(tmp_path / "bank"), buckets=2)
    B.learn(store, "b1", *batch(spark, 1, {"S": (3, [1.0, 0.0])}))
    held = state(store)
    rows = store.profiles().withColumn("total_segments", F.lit(99).cast("long"))
    broken = spark.createDataFrame([("k", "e", "c", [1.0], 1.0, 1)], "key string, source_episode string, cluster_id string, vec array<double>, quality double, created long")
    with pytest.raises(Exception):
        store.commit("bad", rows, broken.withColumn("created", F.raise_error(F.lit("lost")).cast("long")))
    assert state(store) == held and store.version() == 1
    B.learn(store, "b2", *batch(spark, 2, {"S": (3, [1.0, 0.0])}))
    assert list(state(store)[0].values())[0][1] == 3
