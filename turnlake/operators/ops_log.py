"""Run logs, costs, ingestion reports, metadata and preprocessing decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_n
from ..functions.text import exact_round

# Default API price and decision limits.
USD_PER_MINUTE = 0.006
MUSIC_LIMIT, CLARITY_LIMIT, SNR_LIMIT, REVERB_LIMIT = 0.3, 0.6, 15.0, 0.5


def rtf(processing_s: Column, audio_s: Column) -> Column:
    """Processing time over audio time, 4 digits; null when there is no audio."""
    return F.when(audio_s > 0, exact_round(processing_s / audio_s, 4))


def estimate_cost(duration_s: Column, last_end_ms: Column, per_minute: float = USD_PER_MINUTE) -> Column:
    """Minutes x price, 4 digits; a missing duration is the last segment end; null when <= 0."""
    seconds = F.coalesce(duration_s, last_end_ms / 1000)
    return F.when(seconds > 0, exact_round(seconds / 60 * per_minute, 4))


def cost_rollup(events: DataFrame) -> DataFrame:
    """Totals overall, per provider and per (provider, model), rounded once at the end."""
    last = F.struct("ts", "event_id")
    rolled = events.groupingSets(
        [[], [F.col("provider")], [F.col("provider"), F.col("model")]], F.col("provider"), F.col("model")
    ).agg(
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.count(F.lit(1)).alias("runs"),
        F.round(F.sum("duration_s"), 6).alias("duration_s"),
        F.max("ts").alias("last_used"),
        F.max_by("media_path", last).alias("last_media"),
    )
    return rolled


def runtime_stats(log: DataFrame, tool: str | None = None, stage: str | None = None) -> DataFrame:
    """Durations and real-time factors per tool and stage; the factor only where logged."""
    if tool is not None:
        log = log.filter(F.col("tool") == tool)
    if stage is not None:
        log = log.filter(F.col("stage") == stage)
    r = lambda c: F.round(c, 6)
    return log.groupBy("tool", "stage").agg(
        F.count(F.lit(1)).alias("runs"),
        r(F.sum("duration_s")).alias("total_s"),
        r(F.avg("duration_s")).alias("mean_s"),
        F.min("duration_s").alias("min_s"),
        F.max("duration_s").alias("max_s"),
        r(F.avg("rtf")).alias("mean_rtf"),
        F.min("rtf").alias("min_rtf"),
        F.max("rtf").alias("max_rtf"),
    )


def runtime_cube(log: DataFrame) -> DataFrame:
    """The same counts for every combination of the optional tool and stage filters."""
    return log.cube("tool", "stage").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("duration_s"), 6).alias("total_s"),
        F.round(F.avg("rtf"), 6).alias("mean_rtf"),
    )


def ingest_summary(results: DataFrame, bank: DataFrame | None = None) -> DataFrame:
    out = results.groupBy("speaker_id").agg(
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")
    )
    if bank is None:
        return out.withColumn("total", F.col("accepted") + F.col("rejected"))
    held = bank.groupBy("speaker_id").agg(F.count(F.lit(1)).alias("bank_total"))
    return out.join(held, "speaker_id", "left").na.fill(0, ["bank_total"])


def top_reasons(results: DataFrame, k: int = 3) -> DataFrame:
    """First k distinct rejection reasons per speaker, in the order seen."""
    seen = results.filter(~F.col("accepted")).groupBy("speaker_id", "rejection_reason").agg(
        F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")
    )
    return top_n(seen, ["speaker_id"], [F.col("first_ord")], k).withColumn("rn", F.col("rn").cast("bigint"))


def preprocess_decision(quality: DataFrame, separate: bool | None = None, enhance: bool | None = None) -> DataFrame:
    """Whether to separate vocals and to enhance; an explicit setting wins."""
    auto_sep = (F.col("music_ratio") > MUSIC_LIMIT) | (F.col("speech_clarity") < CLARITY_LIMIT)
    auto_enh = (F.col("snr") < SNR_LIMIT) | (F.col("reverb_score") > REVERB_LIMIT)
    return quality.withColumn(
        "separate", auto_sep if separate is None else F.lit(separate)
    ).withColumn("enhance", auto_enh if enhance is None else F.lit(enhance))


def _patched(base: Column, update: Column) -> Column:
    """Entries of ``update`` replace those of ``base``; null values delete."""
    empty = F.create_map().cast("map<string,string>")
    base, update = F.coalesce(base, empty), F.coalesce(update, empty)
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, F.map_filter(update, lambda k, v: v.isNotNull()))


def patch_metadata(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Shallow patch per episode; ``artifacts`` and ``shared_artifacts`` merge per key.

    ``fields`` holds the other entries.  ``created_at`` of an existing row is kept;
    an emptied ``shared_artifacts`` becomes null.
    """
    j = current.alias("c").join(updates.alias("u"), "episode_id", "full_outer")
    shared = _patched(F.col("c.shared_artifacts"), F.col("u.shared_artifacts"))
    return j.select(
        "episode_id",
        _patched(F.col("c.fields"), F.col("u.fields")).alias("fields"),
        _patched(F.col("c.artifacts"), F.col("u.artifacts")).alias("artifacts"),
        F.when(F.size(shared) > 0, shared).alias("shared_artifacts"),
        F.coalesce("c.created_at", "u.created_at").alias("created_at"),
    )


def dual_source(aligned: DataFrame, prefer: str = "vocals") -> DataFrame:
    """Rows of the preferred source where the episode has it, else of the other."""
    sources = aligned.groupBy("episode_id").agg(
        F.coalesce(F.max(F.when(F.col("source") == prefer, F.col("source"))), F.min("source")).alias("source")
    )
    return aligned.join(sources, ["episode_id", "source"])


def cast_snapshot(cast: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Canonical names per show and season, one row per place in the cast.

    ``changed`` tells whether the show's season differs anywhere from the previous
    snapshot (same layout); a season without one has changed.  Places are compared
    row by row, so no list is built.
    """
    keys = ["show", "season"]
    now = cast.select(*keys, "ord", F.trim("canonical").alias("canonical")).filter(F.col("canonical") != "")
    if previous is None:
        changed = now.select(*keys).distinct().withColumn("changed", F.lit(True))
    else:
        old = previous.select(*keys, "ord", F.col("canonical").alias("__old"))
        changed = now.join(old, [*keys, "ord"], "full_outer").groupBy(*keys).agg(
            F.bool_or(~F.col("canonical").eqNullSafe(F.col("__old"))).alias("changed")
        )
    code = F.concat(F.lit("S"), F.format_string("%02d", "season"))
    return now.join(changed, keys).select(*keys, code.alias("season_code"), "ord", "canonical", "changed")
