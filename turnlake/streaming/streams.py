"""Streaming operators.  Each takes streaming DataFrames and returns one; sinks are separate.

Running totals keep one state row per group key.  Windows, joins, sessions and deduplication carry
watermarks and run in append mode, so their state is bounded by the allowed lateness.

Event time is the wall clock of a recording's start (column ``clock``) plus the offset in the recording.
Media time alone would be one clock for all recordings, and the watermark of the first would
cut off the beginning of every later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .live_align import stream_align  # noqa: F401


def stream_cost(events: DataFrame) -> DataFrame:
    """Running cost per provider and model (``update`` or ``complete`` mode)."""
    return events.groupBy("provider", "model").agg(
        F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("runs"), F.sum("duration_s").alias("duration_s"),
        F.max("ts").alias("last_used"), F.max_by("media_path", F.struct("ts", "event_id")).alias("last_media"),
    )


def stream_runtime(log: DataFrame, window: str | None = None, lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Running tool/stage statistics; with ``window`` per tumbling or sliding event-time window."""
    keys: list = ["tool", "stage"]
    if window:
        log = log.withWatermark("ts", lateness)
        keys.append(F.window("ts", window, slide) if slide else F.window("ts", window))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.sum("duration_s").alias("total_s"),
        F.min("duration_s").alias("min_s"), F.max("duration_s").alias("max_s"), F.avg("rtf").alias("mean_rtf"),
    )


def stream_new_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Rows of files not seen before, oldest first; the sink's checkpoint remembers the files done."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def event_time(ms: Column, clock: str = "started_at") -> Column:
    return F.timestamp_micros(F.unix_micros(F.col(clock).cast("timestamp")) + ms * 1000)


def stream_mask_sessions(
    masks: DataFrame, gap_ms: int = 120, min_ms: int = 80, lateness: str = "10 minutes", clock: str = "started_at"
) -> DataFrame:
    """Live merging of masks, in append mode: sessions whose gap counts from the end of each event."""
    # Sessions that touch are merged, while a gap of exactly ``gap_ms`` must separate.
    reach = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0)) + gap_ms - 1
    gap = F.concat(reach.cast("string"), F.lit(" milliseconds"))
    stamped = masks.withColumn("ts", event_time(F.col("start_ms"), clock)).withWatermark("ts", lateness)
    merged = stamped.groupBy("episode_id", "type", F.session_window("ts", gap)).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"),
    )
    return merged.filter((F.col("members") > 1) | (F.col("end_ms") - F.col("start_ms") >= min_ms)).drop("session_window")


def stream_dedup(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """First event per key within the allowed lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain what is available into parquet (append mode, exactly once by checkpoint)."""
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()


def run_to_snapshot(stream: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> None:
    """Drain into snapshots ``out/epoch=<n>``; a replayed epoch rewrites only its own folder."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    q = (
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    """The newest snapshot; older ones are listed, not read."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    newest = max(int(n.partition("=")[2]) for n in names if n.startswith("epoch="))
    return spark.read.parquet(f"{out}/epoch={newest}")
