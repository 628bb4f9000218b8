"""Masked ("bleeped") speech: detection, merging, matching, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import SCAN_MS, floor_div
from ..functions.ordered import BUCKET, runs, trailing_buckets
from ..functions.text import fmt_timestamp
from .alignment import ROW, by_row


def merge_masks(masks: DataFrame, gap_ms: int = 120, min_ms: int = 80) -> DataFrame:
    """Chain events of one episode and type whose gap is below ``gap_ms``.

    Results shorter than ``min_ms`` are dropped unless they were merged.
    """
    keys = ["episode_id", "type"]
    # Chains inside buckets first; of their few rows those that reach over a border are put together.
    inside = W.partitionBy(*keys, "__bucket").orderBy("start_ms", "end_ms", "mask_id")
    whole = W.partitionBy(*keys).orderBy("__bucket", "chain")

    def chained(rows: DataFrame, over: WindowSpec, name: str) -> DataFrame:
        reach = F.max("end_ms").over(over.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumn("__reach", reach)
        new = F.when(F.col("__reach").isNull() | (F.col("start_ms") - F.col("__reach") >= gap_ms), 1).otherwise(0)
        return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(over))

    parts = chained(masks.withColumn("__bucket", floor_div(F.col("start_ms"), SCAN_MS)), inside, "chain").groupBy(*keys, "__bucket", "chain").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("members"), F.max("conf").alias("conf")
    )
    merged = chained(parts, whole, "whole").groupBy(*keys, "whole").agg(
        F.min("start_ms").alias("start_ms"),
        F.max("end_ms").alias("end_ms"),
        F.sum("members").alias("members"),
        F.max("conf").alias("conf"),
    )
    return merged.filter((F.col("members") > 1) | (F.col("end_ms") - F.col("start_ms") >= min_ms)).drop("whole")


def detect_masks(
    frames: DataFrame,
    hop_ms: int,
    tone_hz: tuple[float, float] = (800.0, 2500.0),
    tone_flatness: float = 0.2,
    noise_flatness: float = 0.6,
    drop_db: float = 20.0,
    trail_ms: int = 2000,
    floor_db: float = -60.0,
    min_snr_db: float = 10.0,
    min_conf: float = 0.7,
    min_ms: int = 80,
    max_ms: int = 1000,
    gap_ms: int = 120,
) -> DataFrame:
    """Mask events from per-frame features (t_ms, label, rms_db, flatness, centroid_hz).

    tone: centre inside the band and little spread; noise: flat spectrum; mute: level
    at least ``drop_db`` below the trailing mean inside speech.  Bands and limits of
    the unspecified rules are parameters.
    """
    level = trailing_buckets(
        frames, ["episode_id"], "t_ms", trail_ms, SCAN_MS, {"trail_db": F.avg("rms_db")}
    )
    snr = F.col("rms_db") - floor_db
    drop = F.col("trail_db") - F.col("rms_db")
    tone_conf = 1.0 - F.col("flatness")
    noise_conf = F.col("flatness")
    mute_conf = F.least(F.lit(1.0), F.lit(0.5) + drop / (4 * drop_db))
    kind = (
        F.when(F.col("label").isNotNull() & (drop >= drop_db) & (mute_conf >= min_conf), "mute")
        .when(
            F.col("centroid_hz").between(*tone_hz) & (F.col("flatness") <= tone_flatness)
            & (snr >= min_snr_db) & (tone_conf >= min_conf), "tone",
        )
        .when((F.col("flatness") >= noise_flatness) & (snr >= min_snr_db) & (noise_conf >= min_conf), "noise")
        .otherwise("none")
    )
    conf = F.when(kind == "mute", mute_conf).when(kind == "tone", tone_conf).otherwise(noise_conf)
    marked = level.withColumn("kind", kind).withColumn("conf", conf)
    half = hop_ms // 2
    # The frames are dealt and sorted once, for the trailing level and the runs; runs and events follow by recording.
    found = runs(
        marked, ["episode_id"], ["t_ms"], BUCKET, F.col("kind"),
        {"from_ms": (F.min("t_ms"), F.min), "to_ms": (F.max("t_ms"), F.max), "conf_sum": (F.sum("conf"), F.sum), "frames": (F.count("conf"), F.sum)},
    )
    events = found.filter(F.col("label") != "none").select(
        "episode_id", F.col("label").alias("type"), F.greatest(F.col("from_ms") - half, F.lit(0)).cast("bigint").alias("start_ms"),
        (F.col("to_ms") + half).cast("bigint").alias("end_ms"), (F.col("conf_sum") / F.col("frames")).alias("conf"), F.col("island").alias("mask_id"),
    )
    merged = merge_masks(events, gap_ms, min_ms)
    dur = F.col("end_ms") - F.col("start_ms")
    return merged.filter((F.col("type") == "mute") | (dur <= max_ms))


def learn_sfx(masks: DataFrame, band_hz: int = 100) -> DataFrame:
    """Recurring signatures: one profile per type and frequency band."""
    dur = F.col("end_ms") - F.col("start_ms")
    return (
        masks.groupBy("type", floor_div(F.col("freq_hz"), band_hz).alias("band"))
        .agg(
            F.avg("freq_hz").alias("center_hz"), F.avg(dur).alias("avg_ms"), F.count(F.lit(1)).alias("seen")
        )
        .withColumn("profile", F.concat_ws("_", "type", F.col("band").cast("string")))
        .withColumn("bandwidth_hz", F.lit(float(band_hz)))
    )


def match_sfx(masks: DataFrame, profiles: DataFrame, bin_hz: int = 100) -> DataFrame:
    """Nearest learned profile of the same type whose band holds the mask's frequency.

    Profiles are laid over frequency bins, so masks meet only near ones.
    """
    low, high = F.col("center_hz") - F.col("bandwidth_hz"), F.col("center_hz") + F.col("bandwidth_hz")
    p = profiles.select(
        F.col("type").alias("__t"),
        F.explode(F.sequence(F.floor(low / bin_hz), F.floor(high / bin_hz))).alias("__b"),
        "profile", "center_hz", "bandwidth_hz", "avg_ms",
    )
    m = masks.withColumn(ROW, F.monotonically_increasing_id()).withColumn("__mb", F.floor(F.col("freq_hz") / bin_hz))
    cond = (
        (F.col("type") == F.col("__t")) & (F.col("__mb") == F.col("__b"))
        & (F.abs(F.col("freq_hz") - F.col("center_hz")) <= F.col("bandwidth_hz"))
    )
    dur = F.col("end_ms") - F.col("start_ms")
    dist = F.round(
        F.abs(F.col("freq_hz") - F.col("center_hz")) / F.col("bandwidth_hz")
        + F.abs(dur - F.col("avg_ms")) / F.greatest(F.col("avg_ms"), F.lit(1.0)), 9,
    )
    joined = m.join(p, cond, "left").withColumn("__d", dist)
    best = F.min(F.when(F.col("profile").isNotNull(), F.struct("__d", "profile")))
    return by_row(joined, masks.columns, best.alias("__m")).select(
        *masks.columns, F.col("__m.profile").alias("profile"), F.col("__m.__d").alias("distance")
    )


def mask_stats(masks: DataFrame, durations: DataFrame) -> DataFrame:
    """Counts per episode, per type and per person, and the rate per minute of the total."""
    rolled = masks.groupingSets(
        [[F.col("episode_id")], [F.col("episode_id"), F.col("type")], [F.col("episode_id"), F.col("person_id")]],
        F.col("episode_id"), F.col("type"), F.col("person_id"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.grouping("type").alias("gt"), F.grouping("person_id").alias("gp")
    )
    level = F.when((F.col("gt") == 0), "type").when(F.col("gp") == 0, "person").otherwise("total")
    rate = F.when(
        (level == "total") & (F.col("duration_ms") > 0), F.col("n") / (F.col("duration_ms") / 60000)
    )
    return rolled.join(durations, "episode_id", "left").select(
        "episode_id", level.alias("level"),
        F.coalesce("type", F.col("person_id").cast("string"), F.lit("")).alias("value"),
        "n", F.round(rate, 6).alias("per_minute"),
    )


def mask_timeline(masks: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    return masks.groupBy("episode_id", (floor_div(F.col("start_ms"), bin_ms) * bin_ms).alias("time_ms")).agg(
        F.count(F.lit(1)).alias("value")
    )


def mask_person_totals(masks: DataFrame) -> DataFrame:
    return masks.groupBy("person_id").agg(
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), F.count(F.lit(1)).alias("masks")
    ).orderBy(F.desc("total_ms"), "person_id")


def mask_table(masks: DataFrame) -> DataFrame:
    """The review table: word, person, time stamp, sentence."""
    return masks.select(
        F.coalesce("word_label", F.lit("[BLEEP]")).alias("WORD"),
        F.coalesce("person", F.lit("")).alias("PERSON"),
        fmt_timestamp(F.col("start_ms")).alias("TIMESTAMP"),
        F.coalesce("sentence_text", F.lit("")).alias("SENTENCE USED IN"),
    )
