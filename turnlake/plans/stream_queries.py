"""Streaming queries: the same tables as streams, drained and compared with batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import streams as K
from .registry import query


def _stream(t, df, label, files=1):
    """Write a derived table and read it back as a file stream."""
    path = scratch_path(t.spark, label)
    df.write.parquet(path)
    return K.stream_new_files(t.spark, path, df.schema)


#: Recordings land in three batches, a day apart; the last batch only moves the clock on.
LANDINGS = 3
START = "2024-01-01 00:00:00"


def _landings(t, df, label, clock="started_at"):
    """A derived table as a stream of one landing per batch: recordings land one after the other.

    A landing is as many files as the session has shuffle partitions.  The closing batch holds one row of no
    recording, a year later, so that the watermark passes all others.
    """
    path, files = scratch_path(t.spark, label), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.col("episode_id"), F.lit(LANDINGS))
    stamped = df.withColumn(clock, F.to_timestamp(F.lit(START)) + F.make_dt_interval(turn.cast("int")))
    for k in range(LANDINGS):
        stamped.filter(turn == k).repartition(files).write.mode("append").parquet(path)
    closing = stamped.limit(1).withColumn("episode_id", F.lit(-1).cast(df.schema["episode_id"].dataType)).withColumn(
        clock, F.to_timestamp(F.lit(START)) + F.make_dt_interval(F.lit(366))
    )
    closing.write.mode("append").parquet(path)
    return K.stream_new_files(t.spark, path, stamped.schema, files_per_batch=files)


def _closed(t, df, label, ts):
    """A log as a stream: all rows, then one row a year after a date that no row reaches, which closes the windows."""
    path, files = scratch_path(t.spark, label), int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(files).write.parquet(path)
    closing = df.limit(1).withColumn(ts, F.to_timestamp(F.lit("2100-01-01")).cast(df.schema[ts].dataType)).withColumn("tool", F.lit(None).cast("string"))
    closing.write.mode("append").parquet(path)
    return K.stream_new_files(t.spark, path, df.schema, files_per_batch=files)


def _files(t, stream, label):
    out = scratch_path(t.spark, label)
    K.run_to_files(stream, out, f"{out}-checkpoint")
    return t.spark.read.schema(stream.schema).parquet(out)


def _snapshot(t, stream, label):
    out = scratch_path(t.spark, label)
    K.run_to_snapshot(stream, out, f"{out}-checkpoint")
    return K.latest_snapshot(t.spark, out)


@query("stream_cost", "K1", """SELECT provider, model, round(sum(cost_usd),6) AS cost_usd, count(*) AS runs, round(sum(duration_s),6) AS duration_s, max(ts) AS last_used,
  arg_max(media_path, event_id) AS last_media FROM cost GROUP BY ALL""", "cost")
def stream_cost(t):
    got = _snapshot(t, K.stream_cost(_stream(t, t.cost, "cost")), "cost-totals")
    return got.withColumn("cost_usd", F.round("cost_usd", 6)).withColumn("duration_s", F.round("duration_s", 6)).withColumn(
        "last_used", F.col("last_used").cast("timestamp_ntz")
    )


@query("stream_runtime", "K2", "SELECT tool, stage, count(*) AS runs, round(sum(duration_s),6) AS total_s, min(duration_s) AS min_s, max(duration_s) AS max_s, round(avg(rtf),6) AS mean_rtf FROM runtime GROUP BY ALL", "runtime")
def stream_runtime(t):
    got = _snapshot(t, K.stream_runtime(_stream(t, t.runtime, "runtime")), "runtime-totals")
    return got.withColumn("total_s", F.round("total_s", 6)).withColumn("mean_rtf", F.round("mean_rtf", 6))


@query("stream_runtime_tumbling", "K2", "SELECT tool, stage, date_trunc('day', ts) AS day, count(*) AS runs, round(sum(duration_s),6) AS total_s FROM runtime GROUP BY ALL", "runtime")
def stream_runtime_tumbling(t):
    got = _files(t, K.stream_runtime(_closed(t, t.runtime, "runtime", "ts"), "1 day"), "runtime-days")
    return got.select("tool", "stage", F.col("window.start").cast("timestamp_ntz").alias("day"), "runs", F.round("total_s", 6).alias("total_s"))


@query("stream_runtime_sliding", "K2 F7", """SELECT tool, stage, d + INTERVAL (6*k) HOUR AS window_start, count(*) AS runs FROM (SELECT tool, stage, ts, time_bucket(INTERVAL '6 hours', ts) AS d, unnest([0,-1]) AS k FROM runtime) GROUP BY ALL""", "runtime")
def stream_runtime_sliding(t):
    got = _files(t, K.stream_runtime(_closed(t, t.runtime, "runtime", "ts"), "12 hours", slide="6 hours"), "runtime-slides")
    return got.select("tool", "stage", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "runs")


@query("stream_new_episodes", "K3", "SELECT episode_id, count(*) AS segments FROM seg GROUP BY 1", "seg")
def stream_new_episodes(t):
    """Two landings, two runs over one checkpoint: every row arrives once."""
    seg = t.seg.select("episode_id", "seg_id")
    landing, out = scratch_path(t.spark, "landing"), scratch_path(t.spark, "seen")
    for part in (0, 1):
        seg.filter(F.col("episode_id") % 2 == part).write.mode("append").parquet(landing)
        K.run_to_files(K.stream_new_files(t.spark, landing, seg.schema), out, f"{out}-checkpoint")
    return t.spark.read.schema(seg.schema).parquet(out).groupBy("episode_id").agg(F.count(F.lit(1)).alias("segments"))


@query("stream_align", "K4", "SELECT episode_id, seg_id, word_idx, speaker FROM aligned", "aligned")
def stream_align(t):
    """Words and turns as two streams, recordings one after the other, with the default lateness; no batch step."""
    words = _landings(t, t.plain_word.select("episode_id", "seg_id", "word_idx", "start_ms", "end_ms"), "words")
    turns = _landings(t, t.turn.select("episode_id", "turn_id", "speaker", "start_ms", "end_ms"), "turns")
    got = _files(t, K.stream_align(words, turns), "aligned").filter("episode_id >= 0")
    return got.select("episode_id", "seg_id", "word_idx", "speaker")


@query("stream_mask_sessions", "K5", """SELECT episode_id, type, start_ms, end_ms, members FROM (
  SELECT episode_id, type, g, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS members FROM (
   SELECT *, sum(n) OVER (PARTITION BY episode_id, type ORDER BY start_ms, end_ms, mask_id) AS g FROM (
    SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY episode_id, type ORDER BY start_ms, end_ms, mask_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 120 THEN 0 ELSE 1 END AS n FROM mask)) GROUP BY ALL)
  WHERE members>1 OR end_ms-start_ms>=80""", "mask")
def stream_mask_sessions(t):
    """Recordings one after the other, sessions emitted once they are closed."""
    masks = _landings(t, t.mask.select("episode_id", "type", "mask_id", "start_ms", "end_ms"), "masks")
    return _files(t, K.stream_mask_sessions(masks), "mask-sessions").filter("episode_id >= 0")


@query("stream_dedup", "K6", "SELECT DISTINCT media_path, provider FROM cost", "cost")
def stream_dedup(t):
    """Repeated runs on one file; the allowed lateness spans the data."""
    events = _stream(t, t.cost.select("media_path", "provider", "ts"), "cost-events")
    return _files(t, K.stream_dedup(events, ["media_path", "provider"], "60 days"), "cost-unique").select("media_path", "provider")
