"""Time joins between words, speaker turns, transcript segments and masks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import wide
from ..functions.intervals import (
    BUCKET_MS,
    SCAN_MS,
    floor_div,
    locate_points,
    overlap_pairs,
    owner_spans,
)
from ..functions.ordered import prefix_scan
from ..functions.text import UNKNOWN

TIE = "UNK"
OUTSIDE = "UNKNOWN"
ROW = "__row"
#: Time that one sweep covers, and borders that it turns into rows at once.
SWEEP_MS, SWEEP_ROWS = 60_000, 4096


def by_row(pairs: DataFrame, columns: list[str], *aggs: Column) -> DataFrame:
    """Aggregate per numbered row; equal rows stay apart and columns may have any type."""
    held = pairs.groupBy(ROW).agg(F.first(F.struct(*columns)).alias("__held"), *aggs)
    return held.select("__held.*", *[c for c in held.columns if c not in (ROW, "__held")])


def align_midpoint(
    words: DataFrame, turns: DataFrame, tolerance_ms: int | None = None, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """Give every word the speaker whose turn holds its midpoint.

    Containment is [start, end); among several turns the smallest (start, end)
    owns the word.  With ``tolerance_ms`` a word in a gap goes to the nearest turn
    within that distance, the earlier one on equal distance.  Words without owner
    are ``Unknown``.  A null word probability takes the turn's confidence.

    A sequential pointer walk would lose words after a gap; this is the intended
    containment rule, independent of row order.
    """
    payload = ["speaker", "conf"]
    spans = owner_spans(turns, payload)
    end = F.greatest(F.col("end_ms"), F.col("start_ms"))
    mid2 = F.col("start_ms") + end
    fixed = words.withColumn("end_ms", end)
    if tolerance_ms is None:
        hit = locate_points(fixed, spans, mid2, payload, bucket_ms=bucket_ms)
        speaker, conf = F.col("__p_speaker"), F.col("__p_conf")
    else:
        hit = locate_points(
            fixed,
            _with_gap_sides(spans, max(0, tolerance_ms)),
            mid2,
            ["speaker", "conf", "left", "right"],
            bucket_ms=bucket_ms,
        )
        reach = F.lit(2 * max(0, tolerance_ms))
        to_left = mid2 - F.col("__p_left.at") * 2
        to_right = F.col("__p_right.at") * 2 - mid2
        left_ok, right_ok = to_left <= reach, to_right <= reach
        pick = F.when(
            F.coalesce(left_ok, F.lit(False))
            & (~F.coalesce(right_ok, F.lit(False)) | (to_left <= to_right)),
            F.col("__p_left"),
        ).when(F.coalesce(right_ok, F.lit(False)), F.col("__p_right"))
        speaker = F.coalesce("__p_speaker", pick["speaker"])
        conf = F.coalesce("__p_conf", pick["conf"])
    out = hit.withColumn("speaker", F.coalesce(F.nullif(speaker, F.lit("")), F.lit(UNKNOWN)))
    if "prob" in words.columns:
        out = out.withColumn("prob", F.coalesce(F.col("prob"), conf))
    return out.select(*words.columns, *([] if "speaker" in words.columns else ["speaker"]))


def _with_gap_sides(spans: DataFrame, tol: int) -> DataFrame:
    """Ownership spans plus the parts of each gap that lie within ``tol`` of an edge."""
    side = lambda at: F.struct(at.alias("at"), F.col("speaker"), F.col("conf"))
    base = spans.select("episode_id", "own_start", "own_end", "speaker", "conf")
    near = prefix_scan(
        base,
        ["episode_id"],
        ["own_start"],
        floor_div(F.col("own_start"), SCAN_MS),
        nexts={"right": side(F.col("own_start"))},
        prevs={"__before": F.col("own_start")},
    )
    a, b = F.col("own_end"), F.col("right.at")
    near_left = F.least(a + tol + 1, b)
    none = F.lit(None)
    nothing = F.when(F.lit(False), side(F.col("own_start")))
    left = near.select(
        "episode_id",
        a.alias("own_start"),
        near_left.alias("own_end"),
        none.cast("string").alias("speaker"),
        none.cast("double").alias("conf"),
        side(a).alias("left"),
        F.col("right"),
    )
    right = near.filter(b.isNotNull()).select(
        "episode_id",
        F.greatest(b - tol, near_left).alias("own_start"),
        b.alias("own_end"),
        none.cast("string").alias("speaker"),
        none.cast("double").alias("conf"),
        side(a).alias("left"),
        F.col("right"),
    )
    lead_in = near.filter(F.col("__before").isNull()).select(
        "episode_id",
        (F.col("own_start") - tol).alias("own_start"),
        F.col("own_start").alias("own_end"),
        none.cast("string").alias("speaker"),
        none.cast("double").alias("conf"),
        nothing.alias("left"),
        side(F.col("own_start")).alias("right"),
    )
    gaps = left.unionByName(right).unionByName(lead_in).filter(F.col("own_start") < F.col("own_end"))
    owned = base.select(
        "*", nothing.alias("left"), nothing.alias("right")
    )
    return owned.unionByName(gaps)


def align_overlap(
    words: DataFrame,
    turns: DataFrame,
    eps_ms: int = 50,
    strict: bool = False,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """Give every word the single turn with the largest overlap, the word widened by eps.

    Overlap is not summed per speaker.  Equal maxima give ``UNK`` even for one
    speaker; no overlap gives ``UNKNOWN``, or drops the word when ``strict``.
    """
    spans = turns.groupBy("episode_id", "start_ms", "end_ms").agg(
        F.count(F.lit(1)).alias("n"), F.min("speaker").alias("who")
    )
    pairs = overlap_pairs(
        words.withColumn(ROW, F.monotonically_increasing_id()), spans, ["n", "who"], how="left" if not strict else "inner", once=False,
        bucket_ms=bucket_ms, widen_ms=eps_ms,
    )
    # The largest and the "other end" of the largest overlap differ iff there is a tie.
    first = F.max(
        F.struct("overlap_ms", F.col("b_start").alias("s"), F.col("b_end").alias("e"), "b_n", "b_who")
    )
    last = F.max(F.struct("overlap_ms", (-F.col("b_start")).alias("s"), (-F.col("b_end")).alias("e")))
    best = by_row(pairs, words.columns, first.alias("__f"), last.alias("__l"))
    tied = (
        (F.col("__f.s") != -F.col("__l.s"))
        | (F.col("__f.e") != -F.col("__l.e"))
        | (F.col("__f.b_n") > 1)
    )
    speaker = (
        F.when(F.col("__f.overlap_ms").isNull(), F.lit(OUTSIDE))
        .when(tied, F.lit(TIE))
        .otherwise(F.col("__f.b_who"))
    )
    return best.withColumn("speaker", speaker).drop("__f", "__l")


def best_overlap(
    a: DataFrame, b: DataFrame, b_cols: list[str], b_order: str, bucket_ms: int = BUCKET_MS
) -> DataFrame:
    """For each row of ``a`` the row of ``b`` with the largest positive overlap.

    Ties go to the lowest ``b_order``.  Adds ``best`` (struct of ``b_cols``) and
    ``overlap_ms``; both null where nothing overlaps.
    """
    folded = b.groupBy("episode_id", "start_ms", "end_ms").agg(
        F.min(F.struct(F.col(b_order).alias("o"), F.struct(*b_cols).alias("v"))).alias("m")
    )
    pairs = overlap_pairs(
        a.withColumn(ROW, F.monotonically_increasing_id()), folded, ["m"], how="left", once=False, bucket_ms=bucket_ms
    )
    key = F.when(
        F.col("overlap_ms").isNotNull(), F.struct(F.col("overlap_ms"), (-F.col("b_m.o")).alias("no"))
    )
    return by_row(
        pairs, a.columns, F.max_by(F.col("b_m.v"), key).alias("best"), F.max("overlap_ms").alias("overlap_ms")
    )


def near_match(a: DataFrame, b: DataFrame, b_cols: list[str], tol_ms: int = 50) -> DataFrame:
    """Pairs whose starts and ends both differ by less than ``tol_ms`` (band join)."""
    left = a.withColumn("__nb", floor_div(F.col("start_ms"), tol_ms))
    right = b.select(
        F.col("episode_id").alias("__k"),
        F.explode(
            F.sequence(
                floor_div(F.col("start_ms"), tol_ms) - 1, floor_div(F.col("start_ms"), tol_ms) + 1
            )
        ).alias("__rb"),
        F.col("start_ms").alias("b_start"),
        F.col("end_ms").alias("b_end"),
        *[F.col(c).alias(f"b_{c}") for c in b_cols],
    )
    cond = (
        (F.col("episode_id") == F.col("__k"))
        & (F.col("__nb") == F.col("__rb"))
        & (F.abs(F.col("start_ms") - F.col("b_start")) < tol_ms)
        & (F.abs(F.col("end_ms") - F.col("b_end")) < tol_ms)
    )
    return left.join(right, cond).drop("__k", "__nb", "__rb")


def overlapped_speech(turns: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of intersecting turns of different speakers, with their overlap."""
    a = turns.select("episode_id", F.col("turn_id").alias("a_turn"), F.col("speaker").alias("a_speaker"),
                     "start_ms", "end_ms")
    pairs = overlap_pairs(a, turns, ["turn_id", "speaker"], bucket_ms=bucket_ms)
    return pairs.filter(
        (F.col("a_turn") < F.col("b_turn_id")) & (F.col("a_speaker") != F.col("b_speaker"))
    ).select(
        "episode_id", "a_turn", F.col("b_turn_id").alias("b_turn"), "a_speaker", "b_speaker", "overlap_ms"
    )


def overlap_totals(turns: DataFrame, bucket_ms: int = SWEEP_MS) -> DataFrame:
    """Overlapped speech per episode and pair of speakers (a < b): the overlaps of all their turns, summed.

    No pairs of turns arise.  Turns are cut at bucket borders; in a bucket, a sweep over the turns' borders knows how many
    turns of each speaker are open, and the time between two borders counts for every two speakers that are.  Work
    grows with borders times speakers.
    """
    last = F.greatest(F.col("end_ms") - 1, F.col("start_ms"))
    spoken = turns.where(F.col("speaker").isNotNull() & (F.col("end_ms") > F.col("start_ms")))
    cut = spoken.select(
        "episode_id", "speaker", "start_ms", "end_ms",
        F.explode(F.sequence(floor_div(F.col("start_ms"), bucket_ms), floor_div(last, bucket_ms))).alias("bucket"),
    )
    low, high = F.col("bucket") * bucket_ms, (F.col("bucket") + 1) * bucket_ms
    borders = F.inline(F.array(
        F.struct(F.greatest("start_ms", low).cast("bigint").alias("t"), F.lit(1).cast("bigint").alias("change")),
        F.struct(F.least("end_ms", high).cast("bigint").alias("t"), F.lit(-1).cast("bigint").alias("change")),
    ))
    # Turns that begin or end together are one border.
    steps = cut.select("episode_id", "bucket", "speaker", borders).groupBy("episode_id", "bucket", "speaker", "t").agg(F.sum("change").alias("change"))
    keys = ["episode_id", "bucket"]
    laid = wide(steps.where("change <> 0"), *keys).sortWithinPartitions(*keys, "t")
    episode = turns.schema["episode_id"].dataType.simpleString()
    found = laid.select(*keys, "t", "speaker", "change").mapInArrow(_sweep, f"episode_id {episode}, a_speaker string, b_speaker string, overlap_ms bigint")
    return found.groupBy("episode_id", "a_speaker", "b_speaker").agg(F.sum("overlap_ms").alias("overlap_ms"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Borders by episode, bucket and time, any number of buckets in a row; the bucket at hand is all that is held."""
    at, open_turns, total, before = None, {}, {}, 0
    for batch in (b.slice(k, SWEEP_ROWS) for b in batches for k in range(0, b.num_rows, SWEEP_ROWS)):
        kind = batch.schema.field(0).type
        out: list[tuple] = []
        for episode, bucket, t, speaker, change in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (episode, bucket):
                if total:
                    out += [(at[0], *pair, ms) for pair, ms in total.items()]
                at, open_turns, total = (episode, bucket), {}, {}
            elif t > before and len(open_turns) > 1:
                names = sorted(open_turns)
                for k, a in enumerate(names):
                    for b in names[k + 1 :]:
                        total[a, b] = total.get((a, b), 0) + open_turns[a] * open_turns[b] * (t - before)
            before = t
            left = open_turns.get(speaker, 0) + change
            if left:
                open_turns[speaker] = left
            else:
                open_turns.pop(speaker)
        yield _totals(out, kind)
    if total:
        yield _totals([(at[0], *pair, ms) for pair, ms in total.items()], kind)


def _totals(rows: list[tuple], episode: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), (), ()]
    kinds = (episode, pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["episode_id", "a_speaker", "b_speaker", "overlap_ms"])


def attribute_masks(masks: DataFrame, turns: DataFrame) -> DataFrame:
    """Speaker with the largest overlapping turn; null where the mask is in silence."""
    hit = best_overlap(masks, turns, ["speaker"], "turn_id")
    return hit.withColumn("speaker", F.col("best.speaker")).drop("best")


def mask_sentence(masks: DataFrame, segments: DataFrame, token: str = "[BLEEP]") -> DataFrame:
    """Sentence of the best-overlapping segment and the default word label."""
    hit = best_overlap(masks, segments, ["text", "seg_id"], "seg_id")
    return (
        hit.withColumn("sentence_text", F.col("best.text"))
        .withColumn("sentence_seg", F.col("best.seg_id"))
        .withColumn("word_label", F.lit(token))
        .drop("best")
    )


def split_masks(masks: DataFrame, turns: DataFrame) -> DataFrame:
    """Cut masks at ownership boundaries; uncovered remainders keep a null speaker."""
    spans = owner_spans(turns, ["speaker"]).select(
        "episode_id", F.col("own_start").alias("start_ms"), F.col("own_end").alias("end_ms"), "speaker"
    )
    hits = overlap_pairs(masks, spans, ["speaker"])
    covered = hits.select(
        *masks.columns,
        F.greatest("start_ms", "b_start").alias("piece_start"),
        F.least("end_ms", "b_end").alias("piece_end"),
        F.col("b_speaker").alias("speaker"),
    )
    # Edge rows stand for the mask limits; a hole between neighbours is a remainder.
    edge = lambda col: masks.select(
        "*", F.col(col).alias("piece_start"), F.col(col).alias("piece_end"),
        F.lit(None).cast("string").alias("speaker"),
    )
    rows = covered.unionByName(edge("start_ms")).unionByName(edge("end_ms"))
    # Pieces of one mask only: bounded by the mask's own length.
    w = W.partitionBy("mask_id").orderBy("piece_start", "piece_end")
    nxt = rows.withColumn("__next", F.lead("piece_start").over(w))
    holes = nxt.filter(F.col("__next") > F.col("piece_end")).select(
        *masks.columns,
        F.col("piece_end").alias("piece_start"),
        F.col("__next").alias("piece_end"),
        F.lit(None).cast("string").alias("speaker"),
    )
    return covered.unionByName(holes)
