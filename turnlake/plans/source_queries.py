"""Round trips through the file formats: tables -> files -> readers.

Files go to a fresh folder below the shared scratch location.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.blocks import wide
from ..functions.text import exact_round
from ..session import listing, scratch_path
from ..sources import readers as R
from ..sources import writers as W
from .registry import query
from .sqltext import ms3, rnd


def _sec(c):
    return (F.col(c) / 1000).cast("string")


def _written(t, docs, label):
    """One JSON document per line; a document covers one segment, so none grows with its episode."""
    path = scratch_path(t.spark, label)
    docs.write.text(path)
    return path


_WORDS = "SELECT episode_id::VARCHAR AS episode_id, {0} AS seg_id, word_idx, word, start_ms, end_ms, {1} AS prob FROM word"


def _asr_docs(t, word_key="word", prob_key="probability"):
    words = F.concat(
        F.array(F.struct(F.lit("  ").alias(word_key), F.lit("0").alias("start"), F.lit("0").alias("end"), F.lit("1").alias(prob_key))),
        F.transform("words", lambda w: F.struct(
            F.concat(F.lit(" "), w["word"]).alias(word_key), (w["start_ms"] / 1000).cast("string").alias("start"),
            (w["end_ms"] / 1000).cast("string").alias("end"),
            F.when(w["word_idx"] % 10 != 0, w["prob"].cast("string")).alias(prob_key),
        )),
    )
    seg = F.struct(F.col("seg_id").alias("id"), _sec("start_ms").alias("start"), _sec("end_ms").alias("end"), "text", F.lit("0.5").alias("confidence"), words.alias("words"))
    return t.aseg.select(F.to_json(F.struct(F.col("episode_id").cast("string").alias("file"), F.array(seg).alias("segments"))).alias("value"))


@query("read_asr", "A1 M2 M14", _WORDS.format("seg_id", "CASE WHEN word_idx%10<>0 THEN prob ELSE 0 END"), "word")
def read_asr(t):
    """Blank words are written and must vanish; every tenth probability is missing (read as 0)."""
    _, words = R.read_asr(t.spark, _written(t, _asr_docs(t), "asr"))
    return words


@query("read_asr_segments", "A1", "SELECT episode_id::VARCHAR AS episode_id, seg_id, start_ms, end_ms, text, 0.5::DOUBLE AS asr_conf FROM seg", "seg")
def read_asr_segments(t):
    segments, _ = R.read_asr(t.spark, _written(t, _asr_docs(t), "asr"))
    return segments


@query("read_asr_eval", "A2 M14", _WORDS.format("0::BIGINT", "CASE WHEN word_idx%10<>0 THEN prob ELSE 1 END"), "word")
def read_asr_eval(t):
    """The other dialect has no ids (position 0 here) and defaults a missing p to 1."""
    _, words = R.read_asr(t.spark, _written(t, _asr_docs(t, "w", "p"), "asr-eval"), "eval")
    return words


@query("read_diarization", "A3 M4", "SELECT episode_id::VARCHAR AS episode_id, turn_id, CASE WHEN turn_id%4=1 THEN 'cluster_0' ELSE speaker END AS speaker, start_ms, end_ms, conf FROM turn", "turn")
def read_diarization(t):
    """Speakers of every fourth turn are missing and take their cluster position."""
    seg = F.struct(
        F.col("turn_id").alias("id"), _sec("start_ms").alias("start"), _sec("end_ms").alias("end"),
        F.when(F.col("turn_id") % 4 != 1, F.col("speaker")).alias("speaker"), F.col("conf").cast("string").alias("confidence"),
    )
    docs = t.turn.select(F.to_json(F.struct(F.col("episode_id").cast("string").alias("file"), F.array(seg).alias("segments"))).alias("value"))
    return R.read_diarization(t.spark, _written(t, docs, "diarization"))


@query("write_rttm", "B6 M15", f"SELECT episode_id, start_ms, end_ms, 'SPEAKER '||episode_id||' 1 '||{ms3('start_ms')}||' '||{ms3('end_ms-start_ms')}||' <NA> <NA> '||speaker||' <NA> <NA>' AS line FROM turn_ovl", "turn_ovl")
def write_rttm(t):
    return W.rttm_lines(t.turn_ovl)


@query("read_rttm", "A4 B6", "SELECT episode_id::VARCHAR AS episode_id, start_ms, end_ms, speaker FROM turn_ovl", "turn_ovl")
def read_rttm(t):
    path = scratch_path(t.spark, "rttm")
    W.write_rttm(t.turn_ovl, path)
    noise = t.turn_ovl.select(F.lit(";; comment line").alias("value"), F.col("episode_id"))
    noise.select("value").write.text(f"{path}-noise")
    return R.read_rttm(t.spark, [path, f"{path}-noise"])


@query("read_aligned", "A5 B5", """SELECT episode_id::VARCHAR AS episode_id, start_ms, end_ms, speaker, text, len(words)::BIGINT AS n_words, words[1].word AS first_word, words[-1].speaker AS last_speaker FROM aseg""", "aseg")
def read_aligned(t):
    path = scratch_path(t.spark, "aligned")
    W.write_aligned(t.aseg, path)
    got = R.read_aligned(t.spark, path)
    return got.select(
        "episode_id", "start_ms", "end_ms", "speaker", "text", F.size("words").cast("bigint").alias("n_words"),
        F.element_at("words", 1)["word"].alias("first_word"), F.element_at("words", -1)["speaker"].alias("last_speaker"),
    )


@query("read_transcript", "A6 M8", """SELECT episode_id::VARCHAR AS episode_id, seg_id, start_ms, end_ms, speaker, round(speaker_conf,6) AS speaker_conf, CASE WHEN seg_id%2=0 THEN 'orig'||seg_id END AS original_speaker,
  len(words)::BIGINT AS n_words, list_aggregate(list_transform(words, lambda w: CASE WHEN w.speaker='Unknown' THEN speaker ELSE w.speaker END),'string_agg',',') AS word_speakers FROM aseg""", "aseg")
def read_transcript(t):
    words = F.transform("words", lambda w: F.struct(
        w["word"].alias("word"), (w["start_ms"] / 1000).cast("string").alias("start"), (w["end_ms"] / 1000).cast("string").alias("end"),
        F.when(w["speaker"] != "Unknown", w["speaker"]).alias("speaker"),
    ))
    meta = F.struct(F.when(F.col("seg_id") % 2 == 0, F.concat(F.lit("orig"), F.col("seg_id").cast("string"))).alias("original_speaker"))
    seg = F.struct(F.col("seg_id").alias("id"), _sec("start_ms").alias("start"), _sec("end_ms").alias("end"), "speaker", "text",
                   F.col("speaker_conf").cast("string").alias("speaker_confidence"), words.alias("words"), meta.alias("metadata"))
    docs = t.aseg.select(F.to_json(F.struct(F.col("episode_id").cast("string").alias("file"), F.array(seg).alias("segments"))).alias("value"))
    got = R.read_transcript(t.spark, _written(t, docs, "transcript"))
    return got.select(
        "episode_id", "seg_id", "start_ms", "end_ms", "speaker", F.round("speaker_conf", 6).alias("speaker_conf"), "original_speaker",
        F.size("words").cast("bigint").alias("n_words"), F.array_join(F.transform("words", lambda w: w["speaker"]), ",").alias("word_speakers"),
    )


@query("read_cast", "A7 M18", """SELECT 'show'||(ord%3) AS "show", (ord%4+1)::INT AS season, canonical, role, array_to_string(aliases,',') AS aliases, array_to_string(misspellings,',') AS misspellings FROM castv""", "castv")
def read_cast(t):
    member = F.struct(F.col("canonical").alias("canonical_name"), "role", "aliases", F.col("misspellings").alias("common_misspellings"))
    docs = t.cast.select(F.to_json(F.struct(
        F.concat(F.lit("show"), (F.col("ord") % 3).cast("string")).alias("show_slug"), (F.col("ord") % 4 + 1).cast("string").alias("season_number"),
        F.array(member).alias("cast_members"))).alias("value"))
    got = R.read_cast(t.spark, _written(t, docs, "cast"))
    return got.select("show", "season", "canonical", "role", F.array_join("aliases", ",").alias("aliases"), F.array_join("misspellings", ",").alias("misspellings"))


@query("read_cost_log", "A9 M12", "SELECT event_id, provider, model, round(cost_usd,6) AS cost_usd, duration_s, media_path, date_trunc('millisecond', ts) AS ts FROM cost", "cost")
def read_cost_log(t):
    docs = t.cost.select(F.to_json(F.struct(
        "event_id", "provider", "model", "cost_usd", F.col("duration_s").alias("duration_seconds"), "media_path",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))).alias("value"))
    got = R.read_cost_log(t.spark, _written(t, docs, "cost")).drop("metadata")
    return got.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("cost_metadata", "A9 M12", "SELECT event_id, event_id%7 AS attempt, CASE WHEN event_id%2=0 THEN 'r'||event_id%3 END AS region, CASE WHEN event_id%2=0 THEN provider ELSE NULL END AS tag FROM cost", "cost")
def cost_metadata(t):
    """Metadata of events keeps keys that no schema lists, nested ones too."""
    nested = F.when(F.col("event_id") % 2 == 0, F.struct(F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("region"), F.array("provider").alias("tags")))
    docs = t.cost.select(F.to_json(F.struct("event_id", "cost_usd", F.struct((F.col("event_id") % 7).alias("attempt"), nested.alias("where")).alias("metadata"))).alias("value"))
    got = R.read_cost_log(t.spark, _written(t, docs, "cost-metadata"))
    key = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return got.select("event_id", key("$.attempt", "bigint").alias("attempt"), key("$.where.region", "string").alias("region"), key("$.where.tags[0]", "string").alias("tag"))


@query("read_runtime_log", "A9 M13", f"SELECT clip::VARCHAR AS clip, tool, stage, duration_s, audio_s, {rnd('rtf', 6)} AS rtf FROM runtime", "runtime")
def read_runtime_log(t):
    docs = t.runtime.select(F.to_json(F.struct(
        F.col("clip").cast("string").alias("clip"), "tool", "stage", "duration_s", F.unix_timestamp("ts").cast("double").alias("timestamp"),
        F.col("audio_s").alias("audio_duration_s"), "rtf")).alias("value"))
    got = R.read_runtime_log(t.spark, _written(t, docs, "runtime"))
    return got.select("clip", "tool", "stage", "duration_s", "audio_s", exact_round(F.col("rtf"), 6).alias("rtf"))


_MANIFEST = """SELECT t.episode_id, t.speaker AS cluster, t.turn_id, t.start_ms, t.end_ms, t.end_ms-t.start_ms AS duration_ms, trim(coalesce(b.text,'')) AS text, b.speaker AS assigned_speaker FROM turn_ovl t LEFT JOIN (
  SELECT t.episode_id, t.turn_id, s.text, s.speaker FROM turn_ovl t JOIN seg s ON t.episode_id=s.episode_id AND least(t.end_ms,s.end_ms)>greatest(t.start_ms,s.start_ms)
  QUALIFY row_number() OVER (PARTITION BY t.episode_id, t.turn_id ORDER BY least(t.end_ms,s.end_ms)-greatest(t.start_ms,s.start_ms) DESC, s.seg_id)=1) b USING (episode_id, turn_id) WHERE t.end_ms>t.start_ms"""


@query("review_manifest", "B9 D3", _MANIFEST, "turn_ovl seg")
def review_manifest(t):
    return W.review_manifest(t.turn_ovl, t.seg.drop("ws"))


@query("read_review_manifest", "A10 H2", """SELECT episode_id::VARCHAR AS episode_id, speaker AS cluster, turn_id AS entry_id, start_ms, end_ms, CASE WHEN turn_id%3=0 THEN 1 ELSE 0 END AS layout FROM turn_ovl WHERE end_ms>start_ms""", "turn_ovl seg")
def read_review_manifest(t):
    """Two thirds of the entries in the current layout, one third in the legacy one."""
    rows = W.review_manifest(t.turn_ovl, t.seg.drop("ws"))
    new = W.manifest_documents(rows.filter("turn_id % 3 <> 0")).select(F.col("document").alias("value"))
    entry = F.struct(F.col("turn_id").alias("id"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    legacy = rows.filter("turn_id % 3 = 0").select(
        F.concat(
            F.lit('{"episode_id": "'), F.col("episode_id").cast("string"), F.lit('", "'), "cluster", F.lit('": {"snippets": ['),
            F.to_json(entry), F.lit("]}}"),
        ).alias("value")
    )
    got = R.read_review_manifest(t.spark, _written(t, new.unionByName(legacy), "manifest"))
    return got.select("episode_id", "cluster", "entry_id", "start_ms", "end_ms", "layout")


@query("episode_catalog", "A11", """WITH e AS (SELECT DISTINCT episode_id FROM seg),
  m AS (SELECT 'show'||(episode_id%5) AS show_slug, 'S01E'||(episode_id%60) AS code, episode_id::VARCHAR AS dir FROM e),
  n AS (SELECT *, show_slug||' · '||code AS l, row_number() OVER (PARTITION BY show_slug, code ORDER BY show_slug, dir) AS k FROM m)
  SELECT show_slug, code AS episode_id, dir, CASE WHEN k=1 THEN l ELSE l||' ('||dir||')' END AS label FROM n""", "seg")
def episode_catalog(t):
    """One metadata file per episode in a folder per show and episode, read by the operator itself."""
    path = scratch_path(t.spark, "shows")
    show = F.concat(F.lit("show"), (F.col("episode_id") % 5).cast("string"))
    docs = t.seg.select("episode_id").distinct().select(
        show.alias("show"), F.col("episode_id").cast("string").alias("dir"),
        F.to_json(F.struct(F.when(F.col("episode_id") % 4 != 0, show).alias("show_slug"),
                           F.concat(F.lit("S01E"), (F.col("episode_id") % 60).cast("string")).alias("episode_id"))).alias("value"),
    )
    wide(docs, "dir").write.options(**W.MOVED_BY_TASKS).partitionBy("show", "dir").text(path)
    return R.episode_catalog(t.spark, path, "*/*/*.txt", show_at=-3).select("show_slug", "episode_id", "dir", "label")


@query("merge_catalogs", "H4", """WITH e AS (SELECT 'show'||(p_partkey%5) AS show_slug, 'E'||(p_partkey%40) AS episode_id, p_partkey::VARCHAR AS dir, CASE WHEN p_partkey%2=0 THEN 0 ELSE 1 END AS root FROM part),
  n AS (SELECT *, show_slug||' · '||episode_id AS l, row_number() OVER (PARTITION BY show_slug, episode_id ORDER BY root, dir) AS k FROM e)
  SELECT show_slug, episode_id, dir, CASE WHEN k=1 THEN l ELSE l||' ('||dir||')' END AS label FROM n""")
def merge_catalogs(t):
    rows = t.raw("part").select(
        F.concat(F.lit("show"), (F.col("p_partkey") % 5).cast("string")).alias("show_slug"),
        F.concat(F.lit("E"), (F.col("p_partkey") % 40).cast("string")).alias("episode_id"),
        F.col("p_partkey").cast("string").alias("dir"), F.col("p_partkey").cast("string").alias("path"), "p_partkey",
    )
    got = R.merge_catalogs(rows.filter("p_partkey % 2 = 0"), rows.filter("p_partkey % 2 = 1"))
    return got.select("show_slug", "episode_id", "dir", "label")


@query("write_transcript_text", "B1 B5", "SELECT episode_id, sum(len(text)-len(replace(text,chr(10),''))+1)::BIGINT AS n_lines FROM seg GROUP BY 1", "seg")
def write_transcript_text(t):
    """Text documents written per episode and counted back."""
    from ..operators.transcript import render_text

    path = scratch_path(t.spark, "text")
    W.write_lines(render_text(t.seg), path, ["section", "pos", "sub"])
    with listing(t.spark, 8 * t.spark.sparkContext.defaultParallelism):
        written = t.spark.read.text(path)
    return written.groupBy(F.col("episode_id").cast("bigint").alias("episode_id")).agg(F.count(F.lit(1)).alias("n_lines"))
