"""Speaking time, turn patterns and cross-episode statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import SCAN_MS, floor_div
from ..functions.ordered import prefix_scan


def speaking_time(segments: DataFrame) -> DataFrame:
    """Per episode and speaker: duration, words, segments and share of the dialogue.

    ``segments`` carry ``n_words``.  The share divides pre-aggregated rows.
    """
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    per = segments.groupBy("episode_id", "speaker").agg(
        F.sum(dur).alias("dur_ms"),
        F.sum("n_words").cast("bigint").alias("word_count"),
        F.count(F.lit(1)).alias("segment_count"),
    )
    total = F.sum("dur_ms").over(W.partitionBy("episode_id"))
    return per.withColumn(
        "pct", F.round(F.when(total > 0, F.col("dur_ms") * 100 / total), 6)
    )


def talk_ranking(speaking: DataFrame) -> DataFrame:
    return (
        speaking.groupBy("speaker")
        .agg(F.sum("dur_ms").alias("total_ms"), F.countDistinct("episode_id").alias("episodes"))
        .orderBy(F.desc("total_ms"), "speaker")
    )


def _time_scan(turns: DataFrame, **scan) -> DataFrame:
    return prefix_scan(
        turns, ["episode_id"], ["start_ms", "end_ms", "turn_id"], floor_div(F.col("start_ms"), SCAN_MS), **scan
    )


def turn_stats(turns: DataFrame) -> DataFrame:
    """Segments, speaker changes, segments per turn and duration statistics per episode."""
    scanned = _time_scan(turns, prevs={"was": F.col("speaker")})
    dur = F.col("end_ms") - F.col("start_ms")
    change = F.count_if(F.col("was").isNotNull() & (F.col("was") != F.col("speaker")))
    out = scanned.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("segments"), change.alias("changes"),
        F.avg(dur).alias("avg_ms"), F.min(dur).alias("min_ms"), F.max(dur).alias("max_ms"),
    )
    return out.withColumn("per_turn", F.round(F.col("segments") / (F.col("changes") + 1), 6)).withColumn(
        "avg_ms", F.round("avg_ms", 6)
    )


def speaker_shares(turns: DataFrame) -> DataFrame:
    """Speech time per speaker as a share of the recording (overlaps may exceed 1)."""
    dur = F.col("end_ms") - F.col("start_ms")
    per = turns.groupBy("episode_id", "speaker").agg(
        F.sum(dur).alias("dur_ms"), F.count(F.lit(1)).alias("segments"), F.max("end_ms").alias("last_end")
    )
    whole = F.max("last_end").over(W.partitionBy("episode_id"))
    return per.withColumn("share", F.round(F.col("dur_ms") / whole, 6)).drop("last_end")


def speaker_transitions(turns: DataFrame) -> DataFrame:
    """Who follows whom: counts, gaps and overlaps between consecutive turns."""
    nxt = _time_scan(turns, nexts={"n": F.struct("speaker", "start_ms")}).filter(F.col("n").isNotNull())
    gap = F.col("n.start_ms") - F.col("end_ms")
    return nxt.groupBy(F.col("speaker").alias("from_speaker"), F.col("n.speaker").alias("to_speaker")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.greatest(gap, F.lit(0))).alias("gap_ms"),
        F.sum(F.greatest(-gap, F.lit(0))).alias("overlap_ms"),
        F.count_if(gap < 0).alias("n_overlaps"),
    )


def cross_episode(speaking: DataFrame) -> DataFrame:
    """Speaker totals rolled up over show, season and episode."""
    rolled = speaking.rollup("show", "season", "episode_id", "speaker").agg(
        F.sum("dur_ms").alias("dur_ms"), F.sum("word_count").alias("word_count"),
        F.sum("segment_count").alias("segment_count"),
        F.grouping_id().alias("level"),
    )
    return rolled


def speaker_seasons(speaking: DataFrame) -> DataFrame:
    """Per speaker: totals by show and season, by show, and overall."""
    return speaking.groupingSets(
        [[F.col("speaker")], [F.col("speaker"), F.col("show")], [F.col("speaker"), F.col("show"), F.col("season")]],
        F.col("speaker"), F.col("show"), F.col("season"),
    ).agg(F.sum("dur_ms").alias("dur_ms"), F.countDistinct("episode_id").alias("episodes"))


def first_appearance(speaking: DataFrame) -> DataFrame:
    return speaking.groupBy("speaker").agg(F.min("episode_id").alias("first_episode"))


def asr_summary(words: DataFrame, stages: DataFrame | None = None) -> DataFrame:
    """Segments, words and mean word confidence; with ``stages`` also time per stage."""
    # Words combine per segment first, so the distinct count is a plain count.
    per_seg = words.groupBy("episode_id", "seg_id").agg(
        F.count(F.lit(1)).alias("w"), F.sum("prob").alias("p")
    )
    out = per_seg.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum("w").alias("word_count"),
        F.round(F.sum("p") / F.sum("w"), 6).alias("mean_conf"),
    )
    if stages is None:
        return out
    wide = stages.groupBy("episode_id").agg(
        F.sum(F.when(F.col("stage") == "asr", F.col("duration_s"))).alias("asr_s"),
        F.sum(F.when(F.col("stage") == "diarization", F.col("duration_s"))).alias("diarization_s"),
    )
    return out.join(wide, "episode_id", "left")


def run_status(runs: DataFrame) -> DataFrame:
    elapsed = F.col("ended").cast("timestamp").cast("double") - F.col("started").cast("timestamp").cast("double")
    return runs.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(elapsed), 3).alias("mean_elapsed_s")
    )


def stage_status(artifacts: DataFrame, expected: Sequence[str]) -> DataFrame:
    """One boolean column per expected artifact key."""
    flags = [F.coalesce(F.bool_or(F.col("key") == k), F.lit(False)).alias(k) for k in expected]
    return artifacts.groupBy("episode_id").agg(*flags)


def analytics_document(speaking: DataFrame, stats: DataFrame) -> DataFrame:
    """JSON per episode: dialogue total, speakers, mask statistics."""
    speakers = speaking.groupBy("episode_id").agg(
        F.sum("dur_ms").alias("total_ms"),
        F.array_sort(
            F.collect_list(F.struct(F.col("speaker").alias("name"), "dur_ms", "pct", "word_count", "segment_count"))
        ).alias("speakers"),
    )
    pick = lambda level: F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("level") == level, F.struct("value", "n"))))
    )
    bleeps = stats.groupBy("episode_id").agg(
        F.max(F.when(F.col("level") == "total", F.col("n"))).alias("total_count"),
        pick("type").alias("by_type"), pick("person").alias("by_person"),
        F.max("per_minute").alias("rate_per_minute"),
    )
    return speakers.join(bleeps, "episode_id", "left").select(
        "episode_id",
        F.to_json(
            F.struct(
                "episode_id",
                (F.col("total_ms") / 1000).alias("total_dialogue_duration"),
                F.transform(
                    "speakers",
                    lambda s: F.struct(
                        s["name"].alias("name"), (s["dur_ms"] / 1000).alias("duration_seconds"),
                        F.round(s["pct"], 1).alias("percentage_of_dialogue"),
                        s["word_count"].alias("word_count"), s["segment_count"].alias("segment_count"),
                    ),
                ).alias("speakers"),
                F.struct("total_count", "by_type", "by_person", "rate_per_minute").alias("bleeps"),
            )
        ).alias("document"),
    )


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose key has no parent (null keys are not violations)."""
    p = parent.select(F.col(pk).alias("__pk"))
    return child.filter(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("__pk"), "left_anti")


def without_orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, mode: str = "cascade") -> DataFrame:
    """``cascade`` drops orphans, ``set_null`` keeps the row and clears its key."""
    p = parent.select(F.col(pk).alias("__pk")).distinct()
    joined = child.join(p, F.col(fk) == F.col("__pk"), "left")
    if mode == "cascade":
        return joined.filter(F.col("__pk").isNotNull() | F.col(fk).isNull()).drop("__pk")
    return joined.withColumn(fk, F.col("__pk")).select(*child.columns)
