"""Nulls, repeated rows, Unicode text, file layouts and streams in several batches."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from turnlake.functions.ordered import islands, prefix_scan
from turnlake.functions.text import match_case, norm_name, norm_text
from turnlake.operators.alignment import align_midpoint, align_overlap, best_overlap
from turnlake.operators.bank import apply_mapping
from turnlake.operators.masks import match_sfx, merge_masks
from turnlake.sources.readers import episode_catalog, read_aligned, read_asr, read_review_manifest
from turnlake.streaming import streams as K


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_scans_keep_null_keys_and_null_order(spark):
    data = [(None, 5, "a"), (None, None, "b"), (1, None, "b"), (1, 7, None), (1, 9, None), (1, 70_000_000, "c")]
    df = spark.createDataFrame(data, "k int, t long, v string")
    out = prefix_scan(df, ["k"], ["t"], F.floor(F.col("t") / 1000), sums={"n": F.lit(1)}, prevs={"p": F.col("v")})
    assert rows(out) == sorted([(None, None, "b", 0, None), (None, 5, "a", 1, "b"), (1, None, "b", 0, None), (1, 7, None, 1, "b"), (1, 9, None, 2, None), (1, 70_000_000, "c", 3, None)], key=str)
    runs = islands(df, ["k"], ["t"], F.floor(F.col("t") / 1000), F.col("v"))
    assert runs.count() == len(data)


def test_masks_without_a_type_are_merged_too(spark):
    masks = spark.createDataFrame([(1, None, 1, 0, 100, 0.5), (1, None, 2, 150, 300, 0.9), (1, "tone", 3, 0, 90, 0.7)], "episode_id int, type string, mask_id int, start_ms long, end_ms long, conf double")
    assert {(r.type, r.start_ms, r.end_ms, r.members) for r in merge_masks(masks).collect()} == {(None, 0, 300, 2), ("tone", 0, 90, 1)}


def test_equal_rows_stay_apart(spark):
    words = spark.createDataFrame([(1, "w", 0, 100, {"x": 1})] * 2, "episode_id int, word string, start_ms long, end_ms long, more map<string,int>")
    turns = spark.createDataFrame([(1, 7, "A", 0, 500, 0.9)], "episode_id int, turn_id int, speaker string, start_ms long, end_ms long, conf double")
    assert [r.speaker for r in align_overlap(words, turns).collect()] == ["A", "A"]
    assert [r.best.speaker for r in best_overlap(words, turns, ["speaker"], "turn_id").collect()] == ["A", "A"]
    assert align_midpoint(words.drop("more"), turns).count() == 2
    masks = spark.createDataFrame([("tone", 1000.0, 0, 50)] * 3, "type string, freq_hz double, start_ms long, end_ms long")
    profiles = spark.createDataFrame([("tone", "p", 1010.0, 100.0, 50.0)], "type string, profile string, center_hz double, bandwidth_hz double, avg_ms double")
    assert [r.profile for r in match_sfx(masks, profiles).collect()] == ["p"] * 3


@pytest.mark.parametrize("text, want", [
    ("Good morning, all", "good morning all"), ("a\x1cb c\x85d", "a b c d"), ("  x 　", "x"),
])
def test_unicode_spaces_separate_words(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(norm_text(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("name, folded, cased", [
    ("Éva Müller", "evamuller", "EvaMuller"), ("Ёлка", "елка", "Елка"), ("ＡＢ１", "ab1", "AB1"), ("Άννα ς", "αννασ", "Αννας"),
    ("Straße", "strasse", "Straße"), ("", "", ""), (None, "", ""),
])
def test_names_fold_in_both_modes(spark, name, folded, cased):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(norm_name(F.col("n")), norm_name(F.col("n"), case_sensitive=True)).first()[:] == (folded, cased)


@pytest.mark.parametrize("heard, name, want", [
    ("Mike", "Jean-Luc O'Neil", "Jean-Luc O'Neil"), ("MIKE", "Jean-Luc", "JEAN-LUC"), ("mike", "Jean-Luc", "jean-luc"),
    ("Anna-Lena", "deForest kelley", "Deforest Kelley"), ("miKe", "Jean-luc", "Jean-luc"), ("", "X y", "X y"),
])
def test_match_case_shapes_every_part(spark, heard, name, want):
    assert spark.createDataFrame([(heard, name)], "a string, b string").select(match_case(F.col("a"), F.col("b"))).first()[0] == want


def test_mapping_touches_one_episode_and_takes_the_last_entry(spark):
    segments = spark.createDataFrame([(1, 1, "S0"), (2, 1, "S0")], "episode_id int, seg_id int, speaker string")
    mapping = spark.createDataFrame([(1, "S0", "Zoe", 1), (1, " S0", "Abe", 2)], "episode_id int, label string, name string, ord int")
    out = apply_mapping(segments, mapping).collect()
    assert sorted((r.episode_id, r.speaker) for r in out) == [(1, "Abe"), (2, "S0")]


def test_files_without_a_key_take_their_name(spark, tmp_path):
    asr = {"segments": [{"id": 1, "start": 0, "end": 1, "text": "a b", "words": [{"word": "a", "start": 0, "end": 0.5, "probability": 0.9}]}, {"id": 2, "start": 1, "end": 2, "text": "c", "words": []}]}
    (tmp_path / "asr").mkdir()
    (tmp_path / "asr" / "show 1+e1.asr.json").write_text(json.dumps(asr, indent=2))
    segments, words = read_asr(spark, str(tmp_path / "asr"), multiline=True)
    assert {r.episode_id for r in segments.collect()} == {"show 1+e1.asr"} and segments.count() == 2 and words.count() == 1
    assert {r.episode_id for r in read_asr(spark, str(tmp_path / "asr"), multiline=True, episode_from="folder")[0].collect()} == {"asr"}
    (tmp_path / "e7.jsonl").write_text('{"start": 0, "end": 1, "speaker": "A", "text": "x", "words": []}\n\n')
    assert [r.episode_id for r in read_aligned(spark, str(tmp_path / "e7.jsonl")).collect()] == ["e7"]
    manifest = {"episode_id": "e", "clusters": {"S0": [{"id": 1, "start": 0.5, "end": 1.0, "text": "t"}]}, "S1": {"snippets": [{"id": 2, "start": 1, "end": 2, "text": "u"}]}}
    (tmp_path / "summary.json").write_text(json.dumps(manifest, indent=2))
    assert {(r.cluster, r.layout) for r in read_review_manifest(spark, str(tmp_path / "summary.json"), whole_files=True).collect()} == {("S0", 0), ("S1", 1)}


def test_catalog_reads_its_own_layout(spark, tmp_path):
    for show, folder, body in (("a", "e1", {"show_slug": "a", "episode_id": "x"}), ("a", "e2", {"show_slug": "a", "episode_id": "x"}), ("b", "e1", {})):
        where = tmp_path / show / "episodes" / folder
        os.makedirs(where)
        (where / "metadata.json").write_text(json.dumps(body, indent=1))
    assert sorted(r.label for r in episode_catalog(spark, str(tmp_path)).collect()) == ["a · x", "a · x (e2)", "b · e1"]


def _land(spark, path, parts, schema):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return K.stream_new_files(spark, str(path), spark.read.parquet(str(path)).schema, files_per_batch=1)


def test_recordings_that_land_later_are_aligned_in_full(spark, tmp_path):
    day = lambda k: f"2024-05-0{k + 1} 10:00:00"
    words = [[(k, 0, i, i * 60_000, i * 60_000 + 500, day(k)) for i in range(60)] for k in range(3)]
    turns = [[(k, t, f"S{t % 2}", t * 600_000, t * 600_000 + 400_000, day(k)) for t in range(6)] for k in range(3)]
    end = [(-1, 0, 0, 0, 1, day(8))]
    w = _land(spark, tmp_path / "w", [*words, end], "episode_id int, seg_id int, word_idx int, start_ms long, end_ms long, started_at string")
    t = _land(spark, tmp_path / "t", [*turns, [(-1, 0, "x", 0, 1, day(8))]], "episode_id int, turn_id int, speaker string, start_ms long, end_ms long, started_at string")
    K.run_to_files(K.stream_align(w, t), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).where("episode_id >= 0").select("episode_id", "seg_id", "word_idx", "speaker")
    flat = lambda parts, schema: spark.createDataFrame([r for p in parts for r in p], schema)
    want = align_midpoint(
        flat(words, "episode_id int, seg_id int, word_idx int, start_ms long, end_ms long, started_at string"),
        flat(turns, "episode_id int, turn_id int, speaker string, start_ms long, end_ms long, started_at string").withColumn("conf", F.lit(1.0)),
    ).select("episode_id", "seg_id", "word_idx", "speaker")
    assert rows(got) == rows(want) and got.where("speaker = 'Unknown'").count() > 0


def test_sessions_close_and_late_rows_are_left_out(spark, tmp_path):
    day = lambda k: f"2024-05-0{k + 1} 10:00:00"
    schema = "episode_id int, type string, mask_id int, start_ms long, end_ms long, started_at string"
    parts = [[(k, "tone", 2 * i, i * 1000, i * 1000 + 90, day(k)) for i in range(5)] + [(k, "tone", 2 * i + 1, i * 1000 + 150, i * 1000 + 200, day(k)) for i in range(5)] for k in range(3)]
    late = [(0, "tone", 99, 9_000, 9_500, day(0))]
    s = _land(spark, tmp_path / "m", [*parts, late, [(-1, "tone", 0, 0, 500, day(8))]], schema)
    K.run_to_files(K.stream_mask_sessions(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).where("episode_id >= 0").select("episode_id", "type", "start_ms", "end_ms", "members")
    on_time = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("conf", F.lit(1.0))
    assert rows(got) == rows(merge_masks(on_time).select("episode_id", "type", "start_ms", "end_ms", "members"))


def test_words_leave_once_over_late_batches_and_a_restart(spark, tmp_path):
    """Turns and words arrive up to some minutes late and out of order, and the stream stops in between."""
    rnd = random.Random(3)
    words = [(e, 0, i, i * 2_000, i * 2_000 + rnd.choice([0, 300, 1_501]), "2024-05-01 10:00:00") for e in range(2) for i in range(400)]
    turns = []
    for e in range(2):
        for k in range(120):
            start = rnd.randrange(0, 800_000)
            turns.append((e, k, rnd.choice(["A", "B", "", None]), start, start + rnd.choice([0, 900, 4_000, 90_000]), "2024-05-01 10:00:00"))
    turns += [(0, 900, "C", 100_000, 130_000, "2024-05-01 10:00:00")] * 2
    end = "2025-05-01 10:00:00"
    w_schema = "episode_id int, seg_id int, word_idx int, start_ms long, end_ms long, started_at string"
    t_schema = "episode_id int, turn_id int, speaker string, start_ms long, end_ms long, started_at string"

    def late(rows):
        """Four parts by time, each row at most one part (200 s) late."""
        parts = [[], [], [], []]
        for r in rows:
            parts[min(3, r[3] // 200_000 + rnd.randint(0, 1))].append(r)
        return parts

    w_parts, t_parts = late(words), late(turns)
    for k in range(5):
        for name, parts, closing, schema in (("w", w_parts, (-1, 0, 0, 0, 1, end), w_schema), ("t", t_parts, (-1, 0, "x", 0, 1, end), t_schema)):
            rows_ = parts[k] if k < 4 else [closing]
            spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        if k in (1, 4):  # stops after two batches, goes on from the checkpoint
            w, t = (K.stream_new_files(spark, str(tmp_path / n), s, files_per_batch=1) for n, s in (("w", w_schema), ("t", t_schema)))
            K.run_to_files(K.stream_align(w, t, lateness="7 minutes"), str(tmp_path / "out"), str(tmp_path / "cp"))
            if k == 1:
                assert 0 <= spark.read.parquet(str(tmp_path / "out")).count() < len(words)
    got = spark.read.parquet(str(tmp_path / "out")).where("episode_id >= 0").select("episode_id", "seg_id", "word_idx", "speaker")
    want = align_midpoint(spark.createDataFrame(words, w_schema), spark.createDataFrame(turns, t_schema).withColumn("conf", F.lit(1.0)))
    assert rows(got) == rows(want.select("episode_id", "seg_id", "word_idx", "speaker"))


def test_small_files_are_made_by_many_tasks(spark, tmp_path):
    """A few bytes an episode, but a file each: they were all made by one task."""
    from turnlake.sources import writers as W

    lines = spark.range(64).selectExpr("id as episode_id", "1 as section", "0 as pos", "0 as sub", "'x' as line")
    W.write_lines(lines, str(tmp_path / "text"), ["section", "pos", "sub"])
    made = list((tmp_path / "text").glob("episode_id=*/part-*"))
    assert len(made) == 64 and len({p.name.split("-")[1] for p in made}) > 3
    spark.read.text(str(tmp_path / "text")).createOrReplaceTempView("small_files")
    assert spark.sql("select count(distinct episode_id) from small_files").first()[0] == 64


class _State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def appendValue(self, row):
        self.rows.append(row)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def clear(self):
        self.rows = []


def test_words_that_come_together_are_one_state_row():
    """A state row for each word was nearly all of the time of an alignment."""
    import pandas as pd

    from turnlake.streaming.live_align import FirstOwner

    class One(_State):
        def get(self):
            return self.rows[0]

        def update(self, row):
            self.rows = [row]

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):
            return self.states.setdefault(name, _State())

        def getValueState(self, name, schema):
            return self.states.setdefault(name, One())

        def registerTimer(self, at):
            self.timers.append(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    handle, owner = Handle(), FirstOwner()
    owner.init(handle)
    n = 500
    batch = pd.DataFrame({"is_word": [True] * n, "close_ms": [10_000 * (1 + k // 25) for k in range(n)], "seg_id": range(n), "word_idx": [1] * n,
                          "mid2": [800 * k for k in range(n)], "t_start": [None] * n, "t_end": [None] * n, "turn_id": [None] * n, "speaker": [None] * n})
    list(owner.handleInputRows((1,), iter([batch]), None))
    assert len(handle.states["words"].rows) == 1 and handle.timers == [10_000]
