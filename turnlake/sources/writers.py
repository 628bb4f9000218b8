"""Writers: canonical tables -> the exchanged file formats.

Ordered text formats are range-partitioned by (episode, position) and sorted within
partitions: part files read in name order give the document, at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import tasks
from ..functions.text import ms_fixed3
from ..operators.alignment import best_overlap


#: Many small files: each task moves its own into place, not the driver all of them one by one when the job ends.  A job
#: that fails may leave files behind, so the path must be a new one.
MOVED_BY_TASKS = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def _seconds(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def write_lines(
    lines: DataFrame, path: str, order: list[str], text: str = "line", per_episode: bool = True
) -> None:
    """Ordered text: one folder per episode, or one set of part files for all.

    Lines that name their episode (RTTM) need no folder each; a large corpus is
    then a number of even part files instead of one small file per recording.
    """
    keys = ["episode_id", *order]
    # Small lines, but a folder and a file for each episode: a counted number of tasks creates them.
    rows = lines.repartitionByRange(*([tasks(lines)] if per_episode else []), *keys).sortWithinPartitions(*keys).select(
        "episode_id", F.col(text).alias("value")
    )
    if per_episode:
        rows.write.options(**MOVED_BY_TASKS).partitionBy("episode_id").text(path)
    else:
        rows.select("value").write.text(path)


def aligned_records(segments: DataFrame) -> DataFrame:
    """Aligned segments in file layout (seconds, words with speakers)."""
    word = lambda w: F.struct(
        w["word"].alias("word"), _seconds(w["start_ms"]).alias("start"), _seconds(w["end_ms"]).alias("end"),
        w["speaker"].alias("speaker"),
    )
    return segments.select(
        F.col("episode_id").alias("file"), _seconds(F.col("start_ms")).alias("start"),
        _seconds(F.col("end_ms")).alias("end"), "speaker", "text", F.transform("words", word).alias("words"),
    )


def write_aligned(segments: DataFrame, path: str, per_episode: bool = False) -> None:
    """JSON lines in (episode, start) order; every record names its episode."""
    rows = aligned_records(segments).repartitionByRange("file", "start").sortWithinPartitions("file", "start")
    if per_episode:
        rows.withColumn("episode_id", F.col("file")).write.partitionBy("episode_id").json(path)
    else:
        rows.write.json(path)


def rttm_lines(turns: DataFrame) -> DataFrame:
    line = F.concat_ws(
        " ", F.lit("SPEAKER"), F.col("episode_id").cast("string"), F.lit("1"), ms_fixed3(F.col("start_ms")),
        ms_fixed3(F.col("end_ms") - F.col("start_ms")), F.lit("<NA>"), F.lit("<NA>"), F.col("speaker"),
        F.lit("<NA>"), F.lit("<NA>"),
    )
    return turns.select("episode_id", "start_ms", "end_ms", line.alias("line"))


def write_rttm(turns: DataFrame, path: str, per_episode: bool = False) -> None:
    write_lines(rttm_lines(turns), path, ["start_ms", "end_ms"], per_episode=per_episode)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def review_manifest(turns: DataFrame, transcript: DataFrame) -> DataFrame:
    """Per usable turn its duration, best-overlapping text and speaker, keyed by cluster."""
    usable = turns.filter(F.col("end_ms") > F.col("start_ms")).select(
        "episode_id", "turn_id", "speaker", "start_ms", "end_ms"
    )
    hit = best_overlap(usable, transcript, ["text", "speaker"], "seg_id")
    cluster = F.coalesce(
        F.nullif("speaker", F.lit("")), F.concat(F.lit("cluster_"), F.col("turn_id").cast("string"))
    )
    return hit.select(
        "episode_id", cluster.alias("cluster"), "turn_id", "start_ms", "end_ms",
        (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.trim(F.coalesce("best.text", F.lit(""))).alias("text"), F.col("best.speaker").alias("assigned_speaker"),
    )


def manifest_documents(manifest: DataFrame, part_size: int = 1024) -> DataFrame:
    """Manifest as JSON, in parts of bounded size per cluster."""
    entry = F.struct(
        F.col("turn_id").alias("id"), _seconds(F.col("start_ms")).alias("start"), _seconds(F.col("end_ms")).alias("end"),
        _seconds(F.col("duration_ms")).alias("duration"), "assigned_speaker", "text",
    )
    part = F.floor(F.col("turn_id") / part_size).cast("bigint")
    return (
        manifest.groupBy("episode_id", "cluster", part.alias("part"))
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        .select(
            "episode_id", "cluster", "part",
            F.to_json(
                F.struct(F.col("episode_id").cast("string").alias("episode_id"),
                         F.create_map(F.col("cluster"), F.col("entries")).alias("clusters"))
            ).alias("document"),
        )
    )
