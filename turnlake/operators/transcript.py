"""Segments and words: confidence, speaker mix, numbering, rendering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.intervals import SCAN_MS, floor_div
from ..functions.ordered import islands, prefix_scan, runs, top_n
from ..functions.text import (
    UNKNOWN,
    blank_to_null,
    fixed2,
    fmt_timestamp,
    let,
    ms_fixed2,
    timestamp_suffix,
    words_of,
)

SEG_BUCKET = 1024


def seg_bucket(n: int = SEG_BUCKET) -> Column:
    return floor_div(F.col("seg_id"), n)


# --- words ---------------------------------------------------------------


def filter_words(words: Column, min_prob: float | None) -> Column:
    """Drop array entries below ``min_prob``; 0 or None keeps all; null counts as 0."""
    if not min_prob:
        return words
    return F.filter(words, lambda w: F.coalesce(w["prob"], F.lit(0.0)) >= F.lit(float(min_prob)))


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def segment_confidence(
    words: Column, avg_logprob: Column | None = None, explicit: Column | None = None
) -> Column:
    """Mean word probability; else the explicit value; else exp(avg_logprob); else 0."""
    n = F.size(words)
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(w["prob"], F.lit(0.0)))
    fallbacks = [_clamp(c) for c in (explicit,) if c is not None]
    if avg_logprob is not None:
        fallbacks.append(_clamp(F.exp(avg_logprob)))
    fallback = F.coalesce(*fallbacks, F.lit(0.0))
    return F.when(n > 0, _clamp(total / n)).otherwise(fallback)


def synthesise_words(words: Column, text: Column, start: Column, end: Column, conf: Column) -> Column:
    """A segment without words becomes one word spanning it."""
    lone = F.array(
        F.struct(
            text.alias("word"), start.cast("bigint").alias("start_ms"),
            end.cast("bigint").alias("end_ms"), conf.cast("double").alias("prob"),
        )
    )
    return F.when(F.size(F.coalesce(words, F.array())) > 0, words).otherwise(lone)


def even_word_times(text: Column, start: Column, end: Column) -> Column:
    """Equal slots for whitespace tokens, nearest millisecond."""
    span = end - start

    def slots(ws: Column) -> Column:
        n = F.size(ws)
        at = lambda i: start + F.floor((2 * i * span + n) / (2 * n)).cast("bigint")
        return F.transform(
            ws,
            lambda w, i: F.struct(
                w.alias("word"), at(i).alias("start_ms"), at(i + 1).alias("end_ms"), F.lit(1.0).alias("prob")
            ),
        )

    return let(words_of(text), slots)


def normalise_segments(raw: DataFrame) -> DataFrame:
    """Coerce loosely typed segments (string columns allowed) to the canonical form.

    Unreadable start -> 0, unreadable end -> start, speaker falls back through
    speaker_name, speaker, speaker_label to ``SPEAKER_<position>``.
    """
    start = F.coalesce(F.col("start").try_cast("double"), F.lit(0.0))
    end = F.coalesce(F.col("end").try_cast("double"), start)
    ms = lambda c: F.round(c * 1000).cast("bigint")
    speaker = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("speaker_name", "speaker", "speaker_label")],
        F.format_string("SPEAKER_%02d", F.col("seg_id")),
    )
    word = lambda w: F.struct(
        F.coalesce(F.nullif(w["word"], F.lit("")), w["token"], F.lit("")).alias("word"),
        ms(F.coalesce(w["start"].try_cast("double"), start)).alias("start_ms"),
        ms(F.coalesce(w["end"].try_cast("double"), w["start"].try_cast("double"), start)).alias("end_ms"),
        w["probability"].try_cast("double").alias("prob"),
    )
    return raw.select(
        "episode_id",
        "seg_id",
        ms(start).alias("start_ms"),
        ms(end).alias("end_ms"),
        speaker.alias("speaker"),
        F.trim(F.coalesce(F.col("text"), F.lit(""))).alias("text"),
        F.transform(F.coalesce(F.col("words"), F.array()), word).alias("words"),
    )


def reindex(segments: DataFrame, order: Sequence[str] = ("start_ms", "seg_id")) -> DataFrame:
    """``segment_id`` := 0-based position within the episode."""
    return prefix_scan(
        segments, ["episode_id"], order, floor_div(F.col(order[0]), SCAN_MS),
        sums={"segment_id": F.lit(1).cast("bigint")},
    )


# --- speakers per segment and episode --------------------------------------


def speaker_mix(aligned: DataFrame) -> DataFrame:
    """Per segment and speaker: spoken duration and word count; Unknown excluded."""
    return (
        aligned.filter(F.col("speaker") != UNKNOWN)
        .groupBy("episode_id", "seg_id", "speaker")
        .agg(
            F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("dur_ms"),
            F.count(F.lit(1)).alias("n_words"),
            F.min("word_idx").alias("first_idx"),
        )
    )


def segment_speakers(aligned: DataFrame, prefer_longer: bool = True, with_mix: bool = True) -> DataFrame:
    """Dominant speaker, confidences, word count and (optionally) the mix per segment.

    One pass over the words: per (segment, speaker) first, combined map-side, then
    per segment over a handful of rows.  ``mix`` is null where nobody was heard.
    """
    known = F.col("speaker") != UNKNOWN
    per = aligned.groupBy("episode_id", "seg_id", "speaker").agg(
        F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("dur_ms"),
        F.count(F.lit(1)).alias("n_words"),
        F.min("word_idx").alias("i"),
        # Integer parts per billion: the mean does not depend on summation order.
        F.sum(F.round(F.coalesce(F.col("prob"), F.lit(0.0)) * 1e9).cast("bigint")).alias("p"),
    )
    metric = F.col("dur_ms") if prefer_longer else F.col("n_words")
    pick = F.max_by(
        F.struct("speaker", "dur_ms"), F.when(known, F.struct(metric.alias("m"), (-F.col("i")).alias("ni")))
    )
    aggs = [
        pick.alias("w"),
        F.sum(F.when(known, F.col("dur_ms"))).alias("total"),
        (F.sum("p") / 1e9 / F.sum("n_words")).alias("asr_conf"),
        F.sum("n_words").alias("n"),
    ]
    if with_mix:
        aggs.append(F.collect_list(F.when(known, F.struct("speaker", "dur_ms", "n_words"))).alias("mix"))
    got = per.groupBy("episode_id", "seg_id").agg(*aggs)
    share = F.when(F.col("total") > 0, F.col("w.dur_ms") / F.col("total"))
    conf = F.when(F.col("w").isNull(), F.col("asr_conf")).otherwise(
        share if prefer_longer else F.col("asr_conf")
    )
    out = [
        F.coalesce("w.speaker", F.lit(UNKNOWN)).alias("speaker"),
        conf.alias("speaker_conf"),
        F.col("asr_conf"),
        F.col("n").alias("n_words"),
    ]
    if with_mix:
        out.append(F.when(F.size("mix") > 0, F.array_sort("mix")).alias("mix"))
    return got.select("episode_id", "seg_id", *out)


def dominant_speaker(aligned: DataFrame, prefer_longer: bool = True) -> DataFrame:
    """One speaker per segment.

    Longest duration (first heard on ties), confidence = its share, null when no
    time was spoken; without ``prefer_longer`` the most words, confidence = mean
    word probability.  Segments heard by nobody are ``Unknown``.
    """
    return segment_speakers(aligned, prefer_longer, with_mix=False)


def aligned_segments(segments: DataFrame, aligned: DataFrame, with_mix: bool = True) -> DataFrame:
    """Segments with their dominant speaker, confidences, word count and mix."""
    drop = [c for c in ("speaker",) if c in segments.columns]
    return segments.drop(*drop).join(
        segment_speakers(aligned, with_mix=with_mix), ["episode_id", "seg_id"]
    )


def first_heard(segments: DataFrame, order: str = "seg_id") -> DataFrame:
    """Distinct speakers with their first position, ranked 0.. per episode."""
    seen = (
        segments.filter(blank_to_null(F.col("speaker")).isNotNull())
        .groupBy("episode_id", "speaker")
        .agg(F.min(order).alias("first_ord"))
    )
    # One row per speaker and episode here, not one per segment.
    w = W.partitionBy("episode_id").orderBy("first_ord", "speaker")
    return seen.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))


def number_speakers(segments: DataFrame) -> DataFrame:
    """k-th distinct speaker heard -> ``SPEAKER_%02d``; missing -> ``SPEAKER_XX``."""
    names = first_heard(segments).select(
        F.col("episode_id").alias("__e"),
        F.col("speaker").alias("__s"),
        F.format_string("SPEAKER_%02d", "position").alias("label"),
    )
    joined = segments.join(
        names, (F.col("episode_id") == F.col("__e")) & (F.col("speaker") == F.col("__s")), "left"
    )
    return joined.withColumn("label", F.coalesce("label", F.lit("SPEAKER_XX"))).drop("__e", "__s")


def alignment_summary(segments: DataFrame, aligned: DataFrame, turns: DataFrame) -> DataFrame:
    """Counts per episode: ASR segments, turns, words (Unknown included), unaligned, speakers."""
    words = aligned.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("words_aligned"),
        F.count_if(F.col("speaker") == UNKNOWN).alias("unaligned"),
    )
    speakers = (
        speaker_mix(aligned)
        .groupBy("episode_id", "speaker")
        .agg(F.min(F.struct("seg_id", "first_idx")).alias("f"))
        .groupBy("episode_id")
        .agg(F.array_sort(F.collect_list(F.struct("f", "speaker"))).alias("s"))
        .select("episode_id", F.array_join(F.col("s.speaker"), ",").alias("speakers"))
    )
    return (
        segments.groupBy("episode_id").agg(F.count(F.lit(1)).alias("asr_segments"))
        .join(turns.groupBy("episode_id").agg(F.count(F.lit(1)).alias("turns")), "episode_id", "left")
        .join(words, "episode_id", "left")
        .join(speakers, "episode_id", "left")
        .select(
            "episode_id", "asr_segments",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "words_aligned", "unaligned")],
            F.coalesce("speakers", F.lit("")).alias("speakers"),
        )
    )


def transcript_summary(segments: DataFrame) -> DataFrame:
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    totals = segments.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("segment_count"), F.sum(dur).alias("total_duration_ms")
    )
    order = first_heard(segments).groupBy("episode_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "speaker"))).alias("o")
    )
    return totals.join(order, "episode_id", "left").select(
        "episode_id", "segment_count", "total_duration_ms",
        F.array_join(F.col("o.speaker"), ",").alias("speaker_order"),
    )


def speaker_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("episode_id", "speaker").agg(F.count(F.lit(1)).alias("segments"))


# --- turns from words and frames -------------------------------------------


def merge_turns(words: DataFrame) -> DataFrame:
    """Consecutive same-speaker words (by start) -> one turn with its span and word count."""
    found = runs(
        words, ["episode_id"], ["start_ms", "seg_id", "word_idx"], floor_div(F.col("start_ms"), SCAN_MS), F.col("speaker"),
        {"start_ms": (F.min("start_ms"), F.min), "end_ms": (F.max("end_ms"), F.max), "n_words": (F.count(F.lit(1)), F.sum)},
    )
    return found.select("episode_id", F.col("island").alias("turn_id"), F.col("label").alias("speaker"), "start_ms", "end_ms", "n_words")


def turn_text(words: DataFrame, part_ms: int = SCAN_MS) -> DataFrame:
    """Text of the merged turns in time-ordered parts.

    A monologue may be as long as its recording, so its text comes in parts of at
    most ``part_ms``; joined in ``part`` order they are the whole turn.
    """
    numbered = _word_runs(words).withColumn("part", floor_div(F.col("start_ms"), part_ms))
    entry = F.struct("start_ms", "seg_id", "word_idx", "word")
    return (
        numbered.groupBy("episode_id", F.col("island").alias("turn_id"), "speaker", "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("ws"))
        .select("episode_id", "turn_id", "speaker", "part", F.array_join(F.col("ws.word"), " ").alias("text"))
    )


def _word_runs(words: DataFrame) -> DataFrame:
    return islands(
        words, ["episode_id"], ["start_ms", "seg_id", "word_idx"],
        floor_div(F.col("start_ms"), SCAN_MS), F.col("speaker"),
    )


def labels_to_turns(frames: DataFrame, hop_ms: int) -> DataFrame:
    """Runs of equal frame labels -> [t - hop/2, t_last + hop/2], first start >= 0."""
    half = hop_ms // 2
    found = runs(
        frames, ["episode_id"], ["t_ms"], floor_div(F.col("t_ms"), SCAN_MS), F.col("label"),
        {"from_ms": (F.min("t_ms"), F.min), "to_ms": (F.max("t_ms"), F.max), "n_frames": (F.count(F.lit(1)), F.sum)},
    )
    start = F.col("from_ms") - half
    return found.select(
        "episode_id", F.col("island").alias("turn_id"), F.col("label").alias("speaker"),
        F.when(F.col("island") == 0, F.greatest(start, F.lit(0))).otherwise(start).cast("bigint").alias("start_ms"),
        (F.col("to_ms") + half).alias("end_ms"), "n_frames",
    )


def sliding_windows(frames: DataFrame, size_ms: int = 1500, hop_ms: int = 750) -> DataFrame:
    """Overlapping windows stamped at their midpoint; only windows inside the recording."""
    last = frames.groupBy("episode_id").agg(F.max("t_ms").alias("__end"))
    low = F.greatest(F.ceil((F.col("t_ms") - size_ms + 1) / hop_ms), F.lit(0)).cast("bigint")
    high = floor_div(F.col("t_ms"), hop_ms)
    return (
        frames.filter(low <= high)
        .withColumn("window_id", F.explode(F.sequence(low, high)))
        .groupBy("episode_id", "window_id")
        .agg(F.count(F.lit(1)).alias("n_frames"), F.avg("rms_db").alias("mean_rms_db"))
        .join(last, "episode_id")
        .filter(F.col("window_id") * hop_ms + size_ms <= F.col("__end") + 1)
        .withColumn("mid_ms", F.col("window_id") * hop_ms + size_ms // 2)
        .drop("__end")
    )


# --- review -----------------------------------------------------------------


def review_queue(segments: DataFrame, limit: int = 20) -> DataFrame:
    """First ``limit`` segments per episode whose speaker starts with UNKNOWN."""
    unknown = segments.filter(F.upper(F.col("speaker")).startswith("UNKNOWN"))
    return top_n(unknown, ["episode_id"], [F.col("seg_id")], limit)


def original_label(original: Column, speaker: Column) -> Column:
    return F.coalesce(blank_to_null(original), blank_to_null(speaker), F.lit("unknown"))


def trim_to_primary(segments: DataFrame, mix: str = "mix", label: str = "original") -> DataFrame:
    """End no later than start + time spoken by the primary label; flag cuts over 50 ms."""
    span = F.aggregate(
        F.filter(F.coalesce(F.col(mix), F.array()), lambda m: m["speaker"] == F.col(label)),
        F.lit(0).cast("bigint"),
        lambda acc, m: acc + m["dur_ms"],
    )
    cut = F.when(span > 0, F.least(F.col("end_ms"), F.col("start_ms") + span)).otherwise(F.col("end_ms"))
    return segments.withColumn("trimmed_end", cut).withColumn(
        "trimmed", F.col("trimmed_end") < F.col("end_ms") - 50
    )


def top_snippets(trimmed: DataFrame, k: int = 5, min_ms: int = 1500, label: str = "original") -> DataFrame:
    """k longest snippets per cluster; short ones only when they were trimmed."""
    kept = _snippet_rows(trimmed, min_ms)
    return top_n(kept, ["episode_id", label], [F.desc("dur_ms"), F.col("seg_id")], k)


def _snippet_rows(trimmed: DataFrame, min_ms: int) -> DataFrame:
    dur = F.greatest(F.col("trimmed_end") - F.col("start_ms"), F.lit(0))
    return (
        trimmed.filter(F.col("end_ms") > F.col("start_ms"))
        .withColumn("dur_ms", dur)
        .filter((F.col("dur_ms") > 0) & ((F.col("dur_ms") >= min_ms) | F.col("trimmed")))
    )


def cluster_totals(trimmed: DataFrame, k: int = 5, min_ms: int = 1500, label: str = "original") -> DataFrame:
    """Totals over all kept rows of a cluster plus its k best snippet ids."""
    totals = _snippet_rows(trimmed, min_ms).groupBy("episode_id", label).agg(
        F.count(F.lit(1)).alias("total_segments"), F.sum("dur_ms").alias("total_ms")
    )
    best = top_snippets(trimmed, k, min_ms, label).groupBy("episode_id", label).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rn", "seg_id")))["seg_id"].cast("array<string>"), ",")
        .alias("snippets")
    )
    return totals.join(best, ["episode_id", label])


def first_segments(segments: DataFrame, k: int = 8, label: str = "original") -> DataFrame:
    """Earliest k segments of every cluster."""
    valid = segments.filter(F.col("end_ms") > F.col("start_ms"))
    return top_n(valid, ["episode_id", label], [F.col("start_ms"), F.col("seg_id")], k)


# --- rendering --------------------------------------------------------------
# A document is the ordered set of its lines: one row per line, so a recording of
# any length renders without gathering it in one task.


def header_lines(metadata: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """``Title Case: value`` lines, caller header first and winning, then a blank line.

    Both inputs are (episode_id, ord, key, value).
    """
    meta = metadata.withColumn("src", F.lit(1))
    if header is not None:
        kept = meta.join(header.select("episode_id", "key"), ["episode_id", "key"], "left_anti")
        meta = header.withColumn("src", F.lit(0)).unionByName(kept)
    title = F.initcap(F.trim(F.replace(F.col("key"), F.lit("_"), F.lit(" "))))
    lines = meta.select(
        "episode_id",
        F.lit(0).alias("section"),
        (F.col("src") * 1000000 + F.col("ord")).cast("bigint").alias("pos"),
        F.lit(0).alias("sub"),
        F.concat(title, F.lit(": "), F.col("value")).alias("line"),
    )
    gap = meta.select("episode_id").distinct().select(
        "episode_id", F.lit(0).alias("section"), F.lit(1 << 40).cast("bigint").alias("pos"),
        F.lit(0).alias("sub"), F.lit("").alias("line"),
    )
    return lines.unionByName(gap)


def summary_metadata(segments: DataFrame) -> DataFrame:
    """Default document metadata as (episode_id, ord, key, value) rows."""
    s = transcript_summary(segments)
    entries = F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("segment_count").alias("key"),
                 F.col("segment_count").cast("string").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("speaker_order").alias("key"),
                 F.col("speaker_order").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.lit("total_duration_seconds").alias("key"),
                 ms_fixed2(F.col("total_duration_ms")).alias("value")),
    )
    return s.select("episode_id", F.inline(entries))


def _speaker() -> Column:
    return F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit(UNKNOWN))


def render_text(
    segments: DataFrame,
    metadata: DataFrame | None = None,
    header: DataFrame | None = None,
    details: bool = False,
) -> DataFrame:
    """(episode_id, section, pos, sub, line); order by the middle three to read the document."""
    body = F.concat(
        F.lit("["), fmt_timestamp(F.col("start_ms")), F.lit("] "), _speaker(), F.lit(": "),
        F.coalesce(F.col("text"), F.lit("")),
    )
    lines = [F.struct(F.lit(0).alias("sub"), body.alias("line"))]
    if details:
        indent = lambda c: F.when(c != "", F.concat(F.lit("    "), c))
        lines.append(F.struct(F.lit(1).alias("sub"), indent(detail_line("; ", counts=True)).alias("line")))
        lines.append(F.struct(F.lit(2).alias("sub"), indent(word_timeline()).alias("line")))
    out = segments.select(
        "episode_id", F.lit(1).alias("section"), F.col("seg_id").cast("bigint").alias("pos"),
        F.inline(F.array(*lines)),
    ).filter(F.col("line").isNotNull())
    if metadata is not None or header is not None:
        head = header_lines(metadata, header) if metadata is not None else header_lines(
            header.limit(0), header
        )
        out = head.unionByName(out)
    return out


def detail_line(sep: str, counts: bool) -> Column:
    """Alignment details of a segment with speaker_conf, asr_conf, mix and words columns."""
    mix = F.array_join(
        F.transform("mix", lambda m: F.concat(m["speaker"], F.lit(":"), ms_fixed2(m["dur_ms"]), F.lit("s"))), ", "
    )
    n = F.array_join(
        F.transform("mix", lambda m: F.concat(m["speaker"], F.lit(":"), m["n_words"].cast("string"))), ", "
    )
    has_mix = F.size(F.coalesce(F.col("mix"), F.array())) > 0
    parts = [
        F.concat(F.lit("speaker_conf="), fixed2(F.col("speaker_conf"))),
        F.concat(F.lit("asr_conf="), fixed2(F.col("asr_conf"))),
        F.when(has_mix, F.concat(F.lit("mix="), mix)),
    ]
    if counts:
        parts.append(F.when(has_mix, F.concat(F.lit("speaker_counts="), n)))
    parts.append(F.when(F.size("words") > 0, F.concat(F.lit("words="), F.size("words").cast("string"))))
    return F.concat_ws(sep, *parts)


def word_timeline(show: int = 12) -> Column:
    """The first words with their times; the rest is counted (a display rule)."""
    def one(w: Column) -> Column:
        who = F.when(
            w["speaker"].isNotNull() & (w["speaker"] != "") & (w["speaker"] != UNKNOWN),
            F.concat(F.lit("@"), w["speaker"]),
        ).otherwise("")
        return F.concat(
            F.trim(w["word"]), F.lit("["), fmt_timestamp(w["start_ms"]), F.lit("-"),
            fmt_timestamp(w["end_ms"]), F.lit("]"), who,
        )

    shown = F.transform(
        F.filter(F.slice("words", 1, show), lambda w: F.trim(w["word"]) != F.lit("")), one
    )
    more = F.when(
        F.size("words") > show,
        F.array(F.concat(F.lit("...(+"), (F.size("words") - show).cast("string"), F.lit(" more)"))),
    ).otherwise(F.array().cast("array<string>"))
    return F.when(
        F.size("words") > 0, F.concat(F.lit("Words: "), F.array_join(F.concat(shown, more), ", "))
    ).otherwise(F.lit(""))


def text_lines(segments: DataFrame, timestamps: bool = True) -> DataFrame:
    """The simple text transcript: stamped lines with the short stamp repeated at the end."""
    line = F.concat(_speaker(), F.lit(": "), F.col("text"))
    if timestamps:
        line = F.concat(
            F.lit("["), fmt_timestamp(F.col("start_ms")), F.lit("] "), line,
            timestamp_suffix(F.col("start_ms")),
        )
    return segments.select("episode_id", "seg_id", line.alias("line"))


def srt_index(segments: DataFrame, skip_blank: bool = False) -> DataFrame:
    """Number all rows by position; ``skip_blank`` then drops blank text, leaving holes."""
    numbered = prefix_scan(
        segments, ["episode_id"], ["seg_id"], seg_bucket(), sums={"__n": F.lit(1).cast("bigint")}
    ).withColumn("srt_no", F.col("__n") + 1).drop("__n")
    if skip_blank:
        numbered = numbered.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return numbered


def render_srt(segments: DataFrame, details: bool = False, skip_blank: bool = False) -> DataFrame:
    """One row per subtitle entry: (episode_id, srt_no, entry)."""
    lines = [F.concat(F.lit("["), _speaker(), F.lit("] "), F.coalesce(F.col("text"), F.lit("")))]
    if details:
        first, last = F.element_at("words", 1), F.element_at("words", -1)
        lines.append(F.nullif(detail_line(" | ", counts=False), F.lit("")))
        lines.append(
            F.when(
                F.size("words") > 0,
                F.concat(
                    F.lit("word_window="),
                    ms_fixed2(F.greatest(last["end_ms"] - first["start_ms"], F.lit(0))), F.lit("s"),
                ),
            )
        )
    stamp = F.concat(
        fmt_timestamp(F.col("start_ms"), ","), F.lit(" --> "), fmt_timestamp(F.col("end_ms"), ",")
    )
    entry = F.regexp_replace(
        F.concat_ws("\n", F.col("srt_no").cast("string"), stamp, *lines), r"[ \t\n\r\f]+$", ""
    )
    return srt_index(segments, skip_blank).select("episode_id", "srt_no", entry.alias("entry"))


def to_document(
    segments: DataFrame, extras: DataFrame | None = None, part_size: int = SEG_BUCKET, alignment: DataFrame | None = None,
    corrections: DataFrame | None = None,
) -> DataFrame:
    """Nested JSON payload in parts of ``part_size`` segments; part 0 carries all that is about the whole.

    ``extras`` are (episode_id, ord, key, value) rows that override the metadata.  ``alignment`` holds the rows of
    :func:`alignment_summary`: they are the ``alignment`` block, and the metadata's ``alignment_summary`` and ``speaker_order``
    where extras name none.  ``corrections`` are the distinct results per episode (episode_id, original, corrected, canonical,
    method, confidence), the ``name_corrections`` block.
    """
    fields = [
        c for c in ("seg_id", "start_ms", "end_ms", "speaker", "text", "speaker_conf", "asr_conf", "mix", "words", "metadata")
        if c in segments.columns
    ]
    in_order = lambda a, b: F.when(a["seg_id"] < b["seg_id"], -1).when(a["seg_id"] > b["seg_id"], 1).otherwise(0)  # noqa: E731  open metadata has no order
    parts = (
        segments.withColumn("part", floor_div(F.col("seg_id"), part_size))
        .groupBy("episode_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*fields)), in_order).alias("segments"))
    )
    meta = summary_metadata(segments)
    if extras is not None:
        kept = meta.join(extras.select("episode_id", "key"), ["episode_id", "key"], "left_anti")
        meta = kept.unionByName(extras)
    block = None
    if alignment is not None:
        names = F.filter(F.split("speakers", ","), lambda n: n != "").alias("speakers")
        block = alignment.select("episode_id", F.struct("asr_segments", "turns", "words_aligned", "unaligned", names).alias("about"))
        summary = block.select("episode_id", F.lit(1000).alias("ord"), F.lit("alignment_summary").alias("key"), F.to_json("about").alias("value"))
        # What the metadata names already stays.
        meta = meta.unionByName(summary.join(meta.select("episode_id", "key"), ["episode_id", "key"], "left_anti").select(*meta.columns))
    meta = meta.groupBy("episode_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata")
    )
    about = parts.groupBy("episode_id").agg(F.min("part").alias("part")).join(meta, "episode_id")
    blocks = ["episode_id", "part", "metadata", "segments"]
    if block is not None:
        about = about.join(block.select("episode_id", F.struct(F.col("about").alias("metadata")).alias("alignment")), "episode_id", "left")
        blocks.append("alignment")
    if corrections is not None:
        results = F.struct("original", "corrected", "canonical", "method", "confidence")
        listed = corrections.groupBy("episode_id").agg(F.array_sort(F.collect_set(results)).alias("name_corrections"))
        about = about.join(listed, "episode_id", "left")
        blocks.append("name_corrections")
    return parts.join(about, ["episode_id", "part"], "left").select(
        "episode_id", "part", F.to_json(F.struct(*blocks)).alias("document"),
    )
