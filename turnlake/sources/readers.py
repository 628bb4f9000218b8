"""Readers: file contents -> canonical tables.  Schemas are declared, never inferred.

Bad numbers become defaults or null by ``try_cast``; times become BIGINT ms.
Multi-file input is read in parallel, one JSON document per line by default
(``multiline=True`` for pretty-printed single documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..session import listing

# Record layouts of the exchanged files.  Numbers are read as text
# so that a malformed value costs one field, not the record.
_WORD = "array<struct<word:string,start:string,end:string,probability:string,speaker:string>>"
ASR = f"file string, segments array<struct<id:string,start:string,end:string,text:string,confidence:string,words:{_WORD}>>"
ASR_EVAL = (
    "file string, language string, segments array<struct<start:string,end:string,text:string,"
    "words:array<struct<w:string,start:string,end:string,p:string>>>>"
)
DIARIZATION = "file string, segments array<struct<id:string,start:string,end:string,speaker:string,track:string,confidence:string>>"
ALIGNED = f"file string, start string, end string, speaker string, text string, words {_WORD}"
TRANSCRIPT = (
    "file string, segments array<struct<id:string,start:string,end:string,speaker:string,text:string,"
    f"speaker_confidence:string,words:{_WORD},metadata:variant>>"
)
CAST = (
    "show_slug string, season_number string, cast_members array<struct<canonical_name:string,role:string,"
    "aliases:array<string>,common_misspellings:array<string>>>"
)
COST = (
    "event_id bigint, provider string, model string, cost_usd double, duration_seconds double, media_path string, "
    "metadata variant, timestamp string"
)
RUNTIME = "clip string, tool string, stage string, duration_s double, timestamp double, audio_duration_s double, rtf double"
METADATA = "show_slug string, episode_id string"
_ENTRY = "array<struct<id:bigint,start:double,end:double,text:string>>"


def _ms(seconds: Column) -> Column:
    return F.round(F.coalesce(seconds.try_cast("double"), F.lit(0.0)) * 1000).cast("bigint")


def _prob(col: Column, default: float | None) -> Column:
    value = col.try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def _json(spark: SparkSession, path: str, schema: str, multiline: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)


def _named(docs: DataFrame, episode_from: str) -> DataFrame:
    """Documents without a ``file`` key take the stem of their file, or the name of its folder."""
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.element_at(F.split(path, "/"), -2 if episode_from == "folder" else -1)
    if episode_from != "folder":
        name = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return docs.withColumn("file", F.coalesce(F.nullif("file", F.lit("")), name))


def _seg_id(entry: Column, pos: Column) -> Column:
    # An id of 0 is indistinguishable from a missing one and takes the position.
    return F.coalesce(F.nullif(entry.try_cast("bigint"), F.lit(0)), pos.cast("bigint"))


def read_asr(
    spark: SparkSession, path: str, dialect: str = "native", multiline: bool = False, episode_from: str = "stem"
) -> tuple[DataFrame, DataFrame]:
    """(segments, words) of ASR documents; blank words dropped, id falls back to the position.

    ``eval`` documents use the keys w/p, and a missing p counts as 1.
    """
    if dialect == "eval":
        docs = _named(_json(spark, path, ASR_EVAL, multiline), episode_from)
        segs = docs.select(F.col("file").alias("episode_id"), F.posexplode("segments").alias("pos", "s"))
        seg_id, conf = F.col("pos").cast("bigint"), F.lit(None).cast("double")
        word, prob = (lambda w: w["w"]), (lambda w: _prob(w["p"], 1.0))
    else:
        docs = _named(_json(spark, path, ASR, multiline), episode_from)
        segs = docs.select(F.col("file").alias("episode_id"), F.posexplode("segments").alias("pos", "s"))
        seg_id, conf = _seg_id(F.col("s.id"), F.col("pos")), _prob(F.col("s.confidence"), 0.0)
        word, prob = (lambda w: w["word"]), (lambda w: _prob(w["probability"], 0.0))
    segs = segs.withColumn("seg_id", seg_id)
    segments = segs.select(
        "episode_id", "seg_id", _ms(F.col("s.start")).alias("start_ms"), _ms(F.col("s.end")).alias("end_ms"),
        F.coalesce("s.text", F.lit("")).alias("text"), conf.alias("asr_conf"),
    )
    kept = F.filter(F.coalesce("s.words", F.expr("array()").cast(segs.schema["s"].dataType["words"].dataType)),
                    lambda w: F.trim(F.coalesce(word(w), F.lit(""))) != "")
    words = segs.select("episode_id", "seg_id", F.posexplode(kept).alias("i", "w")).select(
        "episode_id", "seg_id", (F.col("i") + 1).alias("word_idx"), F.trim(word(F.col("w"))).alias("word"),
        _ms(F.col("w.start")).alias("start_ms"), _ms(F.col("w.end")).alias("end_ms"), prob(F.col("w")).alias("prob"),
    )
    return segments, words


def read_diarization(spark: SparkSession, path: str, multiline: bool = False, episode_from: str = "stem") -> DataFrame:
    """Turns; a missing speaker becomes ``cluster_<position>``."""
    docs = _named(_json(spark, path, DIARIZATION, multiline), episode_from)
    rows = docs.select(F.col("file").alias("episode_id"), F.posexplode("segments").alias("pos", "s"))
    return rows.select(
        "episode_id", _seg_id(F.col("s.id"), F.col("pos")).alias("turn_id"),
        F.coalesce(F.nullif("s.speaker", F.lit("")), F.concat(F.lit("cluster_"), F.col("pos").cast("string"))).alias("speaker"),
        _ms(F.col("s.start")).alias("start_ms"), _ms(F.col("s.end")).alias("end_ms"),
        _prob(F.col("s.confidence"), None).alias("conf"),
    )


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """SPEAKER lines with at least eight fields; end = start + duration."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), SPACE).alias("p"))
    rows = parts.filter((F.size("p") >= 8) & (F.col("p")[0] == "SPEAKER"))
    start, dur = _ms(F.col("p")[3]), _ms(F.col("p")[4])
    return rows.select(
        F.col("p")[1].alias("episode_id"), start.alias("start_ms"), (start + dur).alias("end_ms"),
        F.col("p")[7].alias("speaker"),
    )


def read_aligned(spark: SparkSession, path: str, episode_from: str = "stem") -> DataFrame:
    """Aligned segments, one JSON object per line; blank lines are skipped."""
    rows = _named(_json(spark, path, ALIGNED, False), episode_from).filter(F.coalesce("start", "end", "speaker", "text").isNotNull())
    word = lambda w: F.struct(
        w["word"].alias("word"), _ms(w["start"]).alias("start_ms"), _ms(w["end"]).alias("end_ms"),
        w["speaker"].alias("speaker"),
    )
    return rows.select(
        F.col("file").alias("episode_id"), _ms(F.col("start")).alias("start_ms"), _ms(F.col("end")).alias("end_ms"),
        "speaker", "text", F.transform("words", word).alias("words"),
    )


def read_transcript(spark: SparkSession, path: str, multiline: bool = False, episode_from: str = "stem") -> DataFrame:
    """Transcript segments; a word's speaker falls back to its segment's.  ``metadata`` keeps every key, listed or not (VARIANT)."""
    docs = _named(_json(spark, path, TRANSCRIPT, multiline), episode_from)
    rows = docs.select(F.col("file").alias("episode_id"), F.posexplode("segments").alias("pos", "s"))
    word = lambda w: F.struct(
        F.trim(w["word"]).alias("word"), _ms(w["start"]).alias("start_ms"), _ms(w["end"]).alias("end_ms"),
        F.coalesce(F.nullif(w["speaker"], F.lit("")), F.col("s.speaker"), F.lit("")).alias("speaker"),
        _prob(w["probability"], None).alias("prob"),
    )
    return rows.select(
        "episode_id", _seg_id(F.col("s.id"), F.col("pos")).alias("seg_id"),
        _ms(F.col("s.start")).alias("start_ms"), _ms(F.col("s.end")).alias("end_ms"),
        F.coalesce("s.speaker", F.lit("")).alias("speaker"), F.coalesce("s.text", F.lit("")).alias("text"),
        _prob(F.col("s.speaker_confidence"), None).alias("speaker_conf"),
        F.try_variant_get("s.metadata", "$.original_speaker", "string").alias("original_speaker"),
        F.filter(F.transform("s.words", word), lambda w: F.coalesce(w["word"], F.lit("")) != "").alias("words"),
        F.col("s.metadata").alias("metadata"),
    )


def read_cast(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(show, season, ord, canonical, role, aliases, misspellings) per cast member."""
    docs = _json(spark, path, CAST, multiline)
    empty = F.array().cast("array<string>")
    return docs.select(
        F.col("show_slug").alias("show"), F.col("season_number").try_cast("int").alias("season"),
        F.posexplode("cast_members").alias("ord", "m"),
    ).filter(F.coalesce("m.canonical_name", F.lit("")) != "").select(
        "show", "season", F.col("ord").cast("bigint").alias("ord"), F.col("m.canonical_name").alias("canonical"),
        F.coalesce("m.role", F.lit("other")).alias("role"),
        F.coalesce("m.aliases", empty).alias("aliases"),
        F.coalesce("m.common_misspellings", empty).alias("misspellings"),
    )


def read_cost_log(spark: SparkSession, path: str) -> DataFrame:
    """Cost events; ``metadata`` keeps whatever an event carries (VARIANT)."""
    rows = _json(spark, path, COST, False)
    return rows.select(
        "event_id", "provider", "model", "cost_usd", F.col("duration_seconds").alias("duration_s"), "media_path",
        F.try_to_timestamp(F.replace("timestamp", F.lit("Z"), F.lit("+00:00"))).alias("ts"),
        "metadata",
    ).filter(F.col("cost_usd").isNotNull())


def read_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RUNTIME, False).select(
        "clip", "tool", "stage", "duration_s", F.timestamp_seconds("timestamp").alias("ts"),
        F.col("audio_duration_s").alias("audio_s"), "rtf",
    )


def read_review_manifest(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Entries of both manifest layouts: declared clusters first, legacy snippets appended.

    One document per line, or with ``whole_files`` one (possibly indented) document per file.
    """
    return parse_review_manifest(spark.read.text(path, wholetext=whole_files))


def parse_review_manifest(docs: DataFrame) -> DataFrame:
    """``value`` holds one JSON document per row; (episode_id, cluster, layout, pos, entry fields)."""
    head = F.from_json("value", f"episode_id string, clusters map<string,{_ENTRY}>")
    # Every other top-level object with a ``snippets`` list is a legacy cluster.
    tops = F.filter(
        F.json_object_keys("value"), lambda k: ~k.isin("episode_id", "clusters", "segments", "created")
    )
    base = docs.withColumn("h", head)
    declared = base.select(
        F.col("h.episode_id").alias("episode_id"), F.explode("h.clusters").alias("cluster", "entries")
    ).withColumn("layout", F.lit(0))
    whole = F.from_json("value", "map<string,string>")
    legacy = (
        base.filter(F.size(tops) > 0)
        .select(F.col("h.episode_id").alias("episode_id"), F.explode(F.map_filter(whole, lambda k, v: F.array_contains(tops, k))).alias("cluster", "body"))
        .select("episode_id", "cluster", F.from_json("body", f"snippets {_ENTRY}")["snippets"].alias("entries"))
        .filter(F.col("entries").isNotNull())
        .withColumn("layout", F.lit(1))
    )
    return declared.unionByName(legacy).select(
        "episode_id", "cluster", "layout", F.posexplode("entries").alias("pos", "e")
    ).select(
        "episode_id", "cluster", "layout", F.col("pos").cast("bigint").alias("pos"), F.col("e.id").alias("entry_id"),
        F.round(F.col("e.start") * 1000).cast("bigint").alias("start_ms"),
        F.round(F.col("e.end") * 1000).cast("bigint").alias("end_ms"), F.col("e.text").alias("text"),
    )


def episode_catalog(
    spark: SparkSession, root: str, pattern: str = "*/episodes/*/metadata.json", show_at: int = -4
) -> DataFrame:
    """Labels ``slug · id`` of the metadata files below ``root``, by default <show>/episodes/<dir>/metadata.json.

    ``show_at`` is the place of the show's folder in the path, from its end; ``name=`` before a folder's value
    (partitioned tables) is left out.  A missing slug or id takes the folder's name.
    """
    with listing(spark, 8 * spark.sparkContext.defaultParallelism):
        docs = spark.read.schema(METADATA).option("multiLine", True).json(f"{root}/{pattern}")
    docs = docs.withColumn("path", F.col("_metadata.file_path"))
    folder = lambda at: F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), at)), "^[a-z_]+=", "")
    return label_catalog(
        docs.select(
            F.coalesce(F.nullif("show_slug", F.lit("")), folder(show_at)).alias("show_slug"),
            F.coalesce(F.nullif("episode_id", F.lit("")), folder(-2)).alias("episode_id"),
            folder(-2).alias("dir"), F.col("path").alias("path"),
        )
    )


def label_catalog(entries: DataFrame) -> DataFrame:
    """Add labels; all but the first entry of a label get their folder as suffix.

    ``sort_key`` orders ignoring case.  The first entry is a minimum, combined
    before the shuffle, so many copies of one label are no burden.
    """
    place = F.struct(*[c for c in ("root", "path") if c in entries.columns])
    labelled = entries.withColumn("label", F.concat_ws(" · ", "show_slug", "episode_id")).withColumn("__at", place)
    first = labelled.groupBy("label").agg(F.min("__at").alias("__first"))
    final = F.when(F.col("__at") == F.col("__first"), F.col("label")).otherwise(
        F.concat("label", F.lit(" ("), F.col("dir"), F.lit(")"))
    )
    return labelled.join(first, "label").withColumn("label", final).withColumn("sort_key", F.lower("label")).drop(
        "__at", "__first"
    )


def merge_catalogs(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Current root first, then the legacy root; labels made distinct over both."""
    cols = ["show_slug", "episode_id", "dir", "path"]
    return label_catalog(
        current.select(*cols, F.lit(0).alias("root")).unionByName(legacy.select(*cols, F.lit(1).alias("root")))
    )
