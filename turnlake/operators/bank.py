"""Speaker vectors: pooling, matching against a bank, retention, label application."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import GROUP_ROWS
from ..functions.intervals import floor_div
from ..functions.ordered import prefix_scan, top_n
from ..functions.text import blank_to_null, exact_round, let, ms_fixed3, norm_key
from ..session import settle
from ..sources.bank_store import BankStore
from .alignment import best_overlap
from .vector_index import Index

#: Stored vectors of a cell, and queries that meet it at once, at most.
BANK_BLOCK = 8192


def clamp_thresholds(high: float, medium: float, low: float) -> tuple[float, float, float]:
    """Thresholds within 0..1 and high >= medium >= low."""
    high, medium, low = (max(0.0, min(1.0, x)) for x in (high, medium, low))
    medium = min(medium, high)
    return high, medium, min(low, medium)


def confidence_level(sim: Column, high: float = 0.85, medium: float = 0.75, low: float = 0.6) -> Column:
    high, medium, low = clamp_thresholds(high, medium, low)
    return F.when(sim >= high, "high").when(sim >= medium, "medium").when(sim >= low, "low")


def read_bank(bank: DataFrame, dim: int) -> DataFrame:
    """Vectors of the right length only, with the case-insensitive sort key of their profile."""
    return bank.filter(F.size("vec") == dim).withColumn("name_key", F.lower("display_name"))


def valid_clusters(turns: DataFrame, min_segments: int = 3, min_ms: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    dur = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    return (
        turns.groupBy(*by, "episode_id", F.col("speaker").alias("cluster_id"))
        .agg(F.count(F.lit(1)).alias("segments"), F.sum(dur).alias("dur_ms"))
        .filter((F.col("segments") >= min_segments) & (F.col("dur_ms") >= min_ms))
    )


def pool_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key, combined map-side: one vector per key and task is shuffled.

    The vectors of a key have one length; null vectors, and those with a null element, are left out.
    """
    whole = vectors.where(F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    mean = Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))
    return whole.groupBy(*keys).agg(vector_to_array(mean).alias("vec"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns in DOUBLE; 0 when a norm is 0."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def match_bank(
    queries: DataFrame,
    bank: DataFrame,
    high: float = 0.85,
    medium: float = 0.75,
    low: float = 0.6,
    by: Sequence[str] = (),
) -> DataFrame:
    """Best stored vector per query by cosine over the whole bank (max pooling per speaker).

    ``queries`` are (by.., qid, vec), unique qid; ``bank`` is (by.., emb_id, speaker_id,
    display_name, vec, created), unique emb_id.  Ties go to the first in (name, newest)
    order.  Below ``low`` the query stays unmatched; its best similarity is kept.  ``by``
    columns scope the bank, by show for instance; a query without any vector in its
    scope has no row.
    """
    return match_bank_report(queries, bank, high, medium, low, by)[0]


def match_bank_report(
    queries: DataFrame, bank: DataFrame, high: float = 0.85, medium: float = 0.75, low: float = 0.6, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``match_bank`` and one row (opened, possible): how many cells of the bank the queries asked for, and all they have."""
    order = F.struct(F.lower("display_name").alias("name_key"), (-F.col("created")).alias("newest"), F.col("emb_id").alias("id"))
    index = Index(bank.select(*by, "emb_id", "vec", order.alias("rank")), BANK_BLOCK, by)
    best, report = index.search(queries.select(*by, "qid", "vec"), min(GROUP_ROWS, BANK_BLOCK))
    info = bank.select("emb_id", "speaker_id", "display_name")
    level = confidence_level(F.col("sim"), high, medium, low)
    named = lambda c: F.when(level.isNotNull(), F.col(c)).alias(c)
    out = best.join(info, "emb_id").select("qid", "sim", level.alias("level"), named("speaker_id"), named("display_name"), named("emb_id"))
    return out, report


def retain_newest(bank: DataFrame, n: int = 20) -> DataFrame:
    return top_n(bank, ["speaker_id"], [F.desc("created"), F.desc("emb_id")], n).drop("rn")


def retain_best(bank: DataFrame, n: int = 20) -> DataFrame:
    """Keep the n best by quality (null = 0); among equals the newest goes first."""
    q = F.coalesce("quality", F.lit(0.0))
    return top_n(bank, ["speaker_id"], [q.desc(), F.col("created"), F.col("emb_id")], n).drop("rn")


def register_unmatched(matches: DataFrame) -> DataFrame:
    """New profiles for unmatched clusters, keyed by episode and cluster.

    Without the episode in the key, equal cluster labels of two recordings would
    fall into one profile.
    """
    key = F.lower(F.concat_ws("_", F.lit("auto"), F.col("episode_id").cast("string"), "cluster_id"))
    return matches.filter(F.col("speaker_id").isNull()).select(
        "episode_id",
        "cluster_id",
        key.alias("key"),
        F.concat(F.lit("Unknown Speaker "), F.col("cluster_id")).alias("display_name"),
        F.array("cluster_id").alias("aliases"),
        F.lit(True).alias("auto_registered"),
    )


def identification_summary(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("episode_id").agg(
        F.count_if(F.col("speaker_key").isNotNull()).alias("matched"),
        F.count_if(F.col("speaker_key").isNull()).alias("unmatched"),
    )


def segment_counter(assignments: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Total segments per speaker key, added to the totals already stored."""
    added = assignments.filter(F.col("speaker_key").isNotNull()).groupBy("speaker_key").agg(
        F.sum("segments").alias("added")
    )
    if profiles is None:
        return added
    total = F.coalesce(F.col("total_segments"), F.lit(0)) + F.coalesce("added", F.lit(0))
    return profiles.join(added, profiles["key"] == added["speaker_key"], "left").select(
        "key", total.cast("bigint").alias("total_segments")
    )


def identify(
    turns: DataFrame,
    vectors: DataFrame,
    bank: DataFrame,
    min_segments: int = 3,
    min_ms: int = 1000,
    high: float = 0.85,
    medium: float = 0.75,
    low: float = 0.6,
    auto_register: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Assignments of the valid clusters of a batch against one snapshot of the bank, with review ``notes``.

    Matching a snapshot makes the result independent of cluster order.  ``by`` columns of
    turns and bank scope the matching.  A cluster without a usable vector is neither
    matched nor registered.
    """
    return identify_vectors(turns, vectors, bank, min_segments, min_ms, high, medium, low, auto_register, by).drop("vec")


# The notes of an assignment.
NO_AUDIO = "No usable audio for cluster."
NO_MATCH = "No speaker met the minimum similarity threshold; manual labeling required."


def _fixed3(x: Column) -> Column:
    """Three decimals of a similarity."""
    thousandths = F.round(F.abs(exact_round(x, 3)) * 1000).cast("bigint")
    return F.concat(F.when(x < 0, "-").otherwise(""), ms_fixed3(thousandths))


def identify_vectors(
    turns: DataFrame, vectors: DataFrame, bank: DataFrame, min_segments: int = 3, min_ms: int = 1000, high: float = 0.85,
    medium: float = 0.75, low: float = 0.6, auto_register: bool = False, by: Sequence[str] = (), ids_are_keys: bool = False,
) -> DataFrame:
    """``identify`` with the pooled vector of each cluster (``vec``).

    A speaker's key is the bank's ``speaker_id`` where ``ids_are_keys``, else it follows from the display name.
    """
    clusters = valid_clusters(turns, min_segments, min_ms, by)
    kept = vectors.join(clusters.select("episode_id", "cluster_id"), ["episode_id", "cluster_id"], "left_semi")
    qid = F.concat_ws("\u001f", F.col("episode_id").cast("string"), "cluster_id")
    pooled = settle(pool_vectors(kept, ["episode_id", "cluster_id"]).withColumn("qid", qid), "bank-pooled")
    asked = pooled
    if by:
        asked = pooled.join(clusters.select("episode_id", "cluster_id", *by), ["episode_id", "cluster_id"])
    got = match_bank(asked.select(*by, "qid", "vec"), bank, high, medium, low, by)
    out = clusters.withColumn("qid", qid).join(pooled.select("qid", "vec"), "qid", "left").join(got, "qid", "left")
    matched = F.col("speaker_id").isNotNull()
    known_key = F.col("speaker_id").cast("string") if ids_are_keys else norm_key(F.col("display_name"))
    new = F.lit(auto_register) & ~matched & F.col("vec").isNotNull()
    auto_key = F.lower(F.concat_ws("_", F.lit("auto"), F.col("episode_id").cast("string"), "cluster_id"))
    note = (
        F.when(F.col("vec").isNull(), F.lit(NO_AUDIO))
        .when(~matched & ~new, F.lit(NO_MATCH))
        .when(matched & F.col("level").isin("medium", "low"),
              F.concat(F.lit("Similarity "), _fixed3(F.col("sim")), F.lit(" classified as "), "level", F.lit("; review recommended.")))
    )
    return out.select(
        *by, "episode_id", "cluster_id", "segments", "dur_ms",
        F.when(matched, F.col("sim")).alias("similarity"),
        F.col("level").alias("confidence_level"),
        F.when(new, auto_key).otherwise(known_key).alias("speaker_key"),
        F.when(new, F.concat(F.lit("Unknown Speaker "), F.col("cluster_id"))).otherwise(F.col("display_name")).alias("display_name"),
        new.alias("auto_registered"),
        F.array_compact(F.array(note)).alias("notes"),
        "vec",
    )


def learn(store: BankStore, batch: str, turns: DataFrame, vectors: DataFrame, keep: int = 20, auto_register: bool = True, **options) -> DataFrame:
    """Identify a batch against the newest bank and keep what it teaches; returns the assignments.

    Every matched or newly registered cluster stores its vector (an episode heard again replaces its own), of which the
    ``keep`` newest stay per speaker; matched speakers' segment counters grow, new speakers get a profile.  Only the
    buckets of these speakers are written.  A batch id that is known changes nothing and is identified against the
    version before it, so a replay gives the same assignments.
    """
    known = store.log().where(F.col("batch") == batch).agg(F.max("version")).first()[0]
    before = store.version() if known is None else known - 1
    found = settle(identify_vectors(turns, vectors, store.bank(before), auto_register=auto_register, ids_are_keys=True, **options), "bank-found")
    if known is not None:
        return found.drop("vec")
    named = found.where("speaker_key is not null")
    touched = F.broadcast(named.select(store.bucket("speaker_key").alias("in_bucket")).distinct())  # at most ``buckets`` rows
    own = lambda df: df.join(touched, store.bucket() == F.col("in_bucket"), "left_semi")
    seen = F.col("episode_id").cast("string")
    new_vectors = named.select(
        F.col("speaker_key").alias("key"), seen.alias("source_episode"), "cluster_id", "vec", F.lit(None).cast("double").alias("quality"),
        F.lit(before + 1).cast("long").alias("created"),
    )
    old = own(store.vectors(before)).join(new_vectors.select("key", "source_episode", "cluster_id"), ["key", "source_episode", "cluster_id"], "left_anti")
    order = [F.desc("created"), F.desc("source_episode"), F.desc("cluster_id")]
    stored = top_n(old.unionByName(new_vectors), ["key"], order, keep).drop("rn")
    counted = segment_counter(named.where("not auto_registered"))
    grown = own(store.profiles(before)).join(counted, F.col("key") == F.col("speaker_key"), "left").withColumn(
        "total_segments", F.coalesce("total_segments", F.lit(0)) + F.coalesce("added", F.lit(0))
    ).drop("speaker_key", "added")
    # A key that is registered again (an episode heard twice) stays as it is.
    fresh = named.where("auto_registered").groupBy(F.col("speaker_key").alias("key")).agg(
        F.min("display_name").alias("display_name"), F.array(F.min("cluster_id")).alias("aliases"), F.min(seen).alias("first_episode"),
    ).withColumns({"total_segments": F.lit(0).cast("long"), "auto_registered": F.lit(True)}).join(grown.select("key"), "key", "left_anti")
    store.commit(batch, grown.unionByName(fresh), stored)
    return found.drop("vec")


# --- labels onto transcripts -------------------------------------------------


def _original(segments: DataFrame) -> Column:
    before = F.col("original_speaker") if "original_speaker" in segments.columns else F.lit(None).cast("string")
    return F.coalesce(blank_to_null(before), F.col("speaker"))


def _with_original(segments: DataFrame) -> DataFrame:
    if "original_speaker" in segments.columns:
        return segments
    return segments.withColumn("original_speaker", F.lit(None).cast("string"))


def apply_assignments(segments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Rewrite speakers by (episode, original label); similarity becomes the confidence."""
    base = _with_original(segments)
    a = assignments.filter(F.col("speaker_key").isNotNull()).select(
        F.col("episode_id").alias("__e"), F.col("cluster_id").alias("__c"),
        F.coalesce(blank_to_null(F.col("display_name")), F.col("speaker_key")).alias("__to"),
        F.col("similarity").alias("__sim"),
    )
    label = _original(base)
    joined = base.withColumn("__o", label).join(
        a, (F.col("episode_id") == F.col("__e")) & (F.col("__o") == F.col("__c")), "left"
    )
    hit = F.col("__to").isNotNull() & (F.col("speaker") != F.col("__to"))
    keep = [c for c in base.columns if c not in ("speaker", "original_speaker", "speaker_conf")]
    old = F.col("speaker_conf") if "speaker_conf" in base.columns else F.lit(None).cast("double")
    return joined.select(
        *keep,
        F.when(hit, F.col("__to")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(hit, F.col("__o")).otherwise(F.col("original_speaker")).alias("original_speaker"),
        F.when(hit, F.coalesce("__sim", old)).otherwise(old).alias("speaker_conf"),
    )


def apply_mapping(segments: DataFrame, mapping: DataFrame) -> DataFrame:
    """Manual (label, name) map on the original label; blanks are ignored.

    With an ``episode_id`` column the mapping touches that episode only.  A label given twice takes the entry
    with the highest ``ord``, or the greatest name where entries have no order.
    """
    base = _with_original(segments)
    scope = ["episode_id"] if "episode_id" in mapping.columns else []
    latest = F.struct("ord", F.trim("name")) if "ord" in mapping.columns else F.trim("name")
    m = (
        mapping.filter((F.trim("label") != "") & (F.trim("name") != ""))
        .groupBy(*[F.col(c).alias(f"__{c}") for c in scope], F.trim("label").alias("__l"))
        .agg(F.max_by(F.trim("name"), latest).alias("__to"))
    )
    same = F.col("__o") == F.col("__l")
    for c in scope:
        same = same & (F.col(c) == F.col(f"__{c}"))
    joined = base.withColumn("__o", _original(base)).join(m, same, "left")
    hit = F.col("__to").isNotNull() & (F.col("speaker") != F.col("__to"))
    keep = [c for c in base.columns if c not in ("speaker", "original_speaker")]
    return joined.select(
        *keep,
        F.when(hit, F.col("__to")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(hit, F.col("__o")).otherwise(F.col("original_speaker")).alias("original_speaker"),
        F.coalesce(hit, F.lit(False)).alias("manual_label"),
        F.when(hit, F.col("__o")).alias("mapping_from"),
        F.when(hit, F.col("__to")).alias("mapping_to"),
    )


def valid_assignments(raw: DataFrame) -> DataFrame:
    """Rows with numeric start/end (ms), end > start and a speaker."""
    s, e = F.col("start_ms").try_cast("bigint"), F.col("end_ms").try_cast("bigint")
    return (
        raw.withColumn("start_ms", s).withColumn("end_ms", e).withColumn("speaker", F.trim("speaker"))
        .filter(F.col("start_ms").isNotNull() & (F.col("end_ms") > F.col("start_ms")) & (F.col("speaker") != ""))
    )


def assign_segments(segments: DataFrame, assignments: DataFrame) -> DataFrame:
    """Reviewer spans -> best-overlapping segment gets the label; the later one wins.

    ``original_speaker`` keeps the first label; ``manual_count`` counts the label
    changes in assignment order, equal labels being skipped.
    """
    base = _with_original(segments)
    valid = valid_assignments(assignments)
    hits = best_overlap(valid, segments, ["seg_id"], "seg_id").select(
        "episode_id", F.col("best.seg_id").alias("seg_id"), "ord", F.col("speaker").alias("__to")
    ).filter(F.col("seg_id").isNotNull())
    # Changes along the assignment list of one segment: neighbours that differ.
    steps = prefix_scan(
        hits, ["episode_id", "seg_id"], ["ord"], floor_div(F.col("ord"), 4096),
        prevs={"__was": F.col("__to")},
    )
    agg = steps.groupBy("episode_id", "seg_id").agg(
        F.max_by("__to", "ord").alias("__to"),
        F.min_by("__to", "ord").alias("__first"),
        F.count_if(F.col("__was").isNotNull() & (F.col("__was") != F.col("__to"))).alias("__changes"),
    )
    joined = base.join(agg, ["episode_id", "seg_id"], "left")
    changes = F.coalesce(F.col("__changes"), F.lit(0)) + F.when(
        F.col("__first").isNotNull() & (F.col("__first") != F.col("speaker")), 1
    ).otherwise(0)
    touched = changes > 0
    keep = [c for c in base.columns if c not in ("speaker", "original_speaker")]
    return joined.select(
        *keep,
        F.coalesce("__to", "speaker").alias("speaker"),
        F.when(touched, F.coalesce(blank_to_null(F.col("original_speaker")), F.col("speaker")))
        .otherwise(F.col("original_speaker")).alias("original_speaker"),
        changes.cast("bigint").alias("manual_count"),
    )


def attach_cast(profiles: DataFrame, cast: DataFrame) -> DataFrame:
    """Aliases and misspellings of the cast entry with the same case-folded name."""
    c = cast.groupBy(F.lower("canonical").alias("__n")).agg(
        F.max_by(F.struct("aliases", "misspellings"), "ord").alias("__v")
    )
    empty = F.array().cast("array<string>")
    return profiles.join(c, F.lower("display_name") == F.col("__n"), "left").select(
        *profiles.columns,
        F.coalesce("__v.aliases", empty).alias("aliases"),
        F.coalesce("__v.misspellings", empty).alias("misspellings"),
    )


# --- profiles ------------------------------------------------------------------


def upsert_profiles(current: DataFrame, changes: DataFrame, stamp: Column | None = None) -> DataFrame:
    """New profile snapshot: changed keys overwritten in full, new keys inserted.

    ``changes`` may repeat a key; the highest ``ord`` wins.  Counters and other
    columns the change set lacks are kept.
    """
    key = F.coalesce(blank_to_null(F.col("key")), norm_key(F.col("display_name")))
    fields = [c for c in changes.columns if c not in ("key", "ord")]
    latest = changes.withColumn("key", key).groupBy("key").agg(
        F.max_by(F.struct(*fields), "ord").alias("n")
    )
    joined = current.alias("c").join(latest.alias("l"), "key", "full_outer")
    changed = F.col("l.n").isNotNull()
    cols = [F.col("key")]
    for c in current.columns:
        if c == "key":
            continue
        if c in fields:
            cols.append(F.when(changed, F.col(f"l.n.{c}")).otherwise(F.col(f"c.{c}")).alias(c))
        elif c == "last_updated" and stamp is not None:
            cols.append(F.when(changed, stamp).otherwise(F.col("c.last_updated")).alias(c))
        else:
            cols.append(F.col(f"c.{c}").alias(c))
    return joined.select(*cols)


# --- clips ----------------------------------------------------------------------


def clip_stats(samples: Column, rate: float) -> Column:
    """struct(duration_s, rms, peak_dbfs); an empty or silent clip has no peak (null = -inf)."""
    n = F.size(samples)
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))
    return F.struct(
        (n / F.lit(float(rate))).alias("duration_s"),
        F.when(n > 0, F.sqrt(square / n)).otherwise(F.lit(0.0)).alias("rms"),
        F.when(peak > 0, 20 * F.log10(peak)).alias("peak_dbfs"),
    )


def clip_gates(stats: Column, min_s: float = 1.0, min_peak: float = -50.0, min_rms: float = 1e-4) -> Column:
    return F.struct(
        (stats["duration_s"] >= min_s).alias("duration_ok"),
        F.coalesce(stats["peak_dbfs"] >= min_peak, F.lit(False)).alias("peak_ok"),
        (stats["rms"] >= min_rms).alias("rms_ok"),
    )


def clip_quality(samples: Column) -> Column:
    """0.4 level + 0.4 absence of clipping + 0.2 spread (population deviation)."""
    n = F.size(samples)
    sums = F.aggregate(
        samples,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).cast("bigint").alias("c")),
        lambda a, x: F.struct(
            (a["s"] + x.cast("double")).alias("s"),
            (a["q"] + x.cast("double") * x.cast("double")).alias("q"),
            (a["c"] + F.when(F.abs(x.cast("double")) >= 0.99, 1).otherwise(0)).cast("bigint").alias("c"),
        ),
    )

    def score(v: Column) -> Column:
        mean, mean_q = v["s"] / n, v["q"] / n
        std = F.sqrt(F.greatest(mean_q - mean * mean, F.lit(0.0)))
        total = (
            F.least(F.sqrt(mean_q) / 0.1, F.lit(1.0)) * 0.4
            + F.greatest(F.lit(0.0), 1.0 - v["c"] / n * 10) * 0.4
            + F.least(std / 0.1, F.lit(1.0)) * 0.2
        )
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))

    return F.when(n > 0, let(sums, score)).otherwise(F.lit(0.0))


def trim_silence(samples: Column, threshold_db: float = -40.0, min_samples: int = 0) -> Column:
    """First to last sample above the threshold; empty when none or the span is too short."""
    limit = F.lit(10 ** (threshold_db / 20.0))

    def span(loud: Column) -> Column:
        return F.struct(
            F.array_position(loud, True).alias("first"),
            (F.size(loud) + 1 - F.array_position(F.reverse(loud), True)).alias("last"),
        )

    def cut(at: Column) -> Column:
        length = at["last"] - at["first"]
        return F.when(
            F.coalesce((at["first"] > 0) & (length >= min_samples), F.lit(False)),
            F.slice(samples, F.greatest(at["first"], F.lit(1)).cast("int"), (F.greatest(length, F.lit(0)) + 1).cast("int")),
        ).otherwise(F.slice(samples, 1, 0))

    loud = F.transform(samples, lambda x: F.abs(x.cast("double")) > limit)
    return let(let(loud, span), cut)


def downsample(samples: Column, max_points: int = 5000) -> Column:
    """Mean per window of n // max_points samples; the tail that fills no window is dropped."""
    n = F.size(samples)
    step = F.greatest(F.lit(1), F.floor(n / max_points).cast("int"))
    count = F.floor(n / step).cast("int")
    mean = lambda i: F.aggregate(
        F.slice(samples, i * step + 1, step), F.lit(0.0), lambda s, x: s + x.cast("double")
    ) / step
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), mean)).otherwise(
        F.array().cast("array<double>")
    )


def default_vector(samples: Column) -> Column:
    """[mean, second moment]: the native stand-in for a trained encoder."""
    n = F.size(samples)
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double"))
    square = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.array(total / n, square / n)


def embed_clips(
    clips: DataFrame, fn: Callable[[np.ndarray], np.ndarray] | None = None, samples: str = "samples"
) -> DataFrame:
    """Add ``vec``.  ``fn`` maps one sample array to a vector and runs on Arrow batches."""
    if fn is None:
        return clips.withColumn("vec", F.when(F.size(samples) > 0, default_vector(F.col(samples))))

    def one(x):
        if x is None or not len(x):
            return None
        try:
            return np.asarray(fn(np.asarray(x)), dtype=float)
        except Exception:  # an encoder failure rejects its clip, not the job
            return None

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(vec=[one(x) for x in batch[samples]])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema.fields)
    return clips.mapInPandas(encode, f"{fields}, vec array<double>")


def ingest_clips(
    clips: DataFrame,
    rate: float,
    min_s: float = 1.0,
    min_quality: float = 0.2,
    fn: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """Accept or reject clips in order: too short, silent after trimming, low quality, no vector."""
    trimmed = clips.withColumn(
        "__t", trim_silence(F.col("samples"), -40.0, int(min_s * rate))
    ).withColumn("duration_s", F.size("samples") / F.lit(float(rate)))
    scored = trimmed.withColumn("quality", clip_quality(F.col("__t")))
    embedded = embed_clips(scored, fn, "__t")
    t_dur = F.size("__t") / F.lit(float(rate))
    reason = (
        F.when(F.col("duration_s") < min_s, F.lit("too short"))
        .when((F.size("__t") == 0) | (t_dur < min_s), F.lit("silent"))
        .when(F.col("quality") < min_quality, F.lit("low quality"))
        .when(F.col("vec").isNull(), F.lit("no vector"))
    )
    out = embedded.withColumn("rejection_reason", reason).withColumn("accepted", reason.isNull())
    return out.withColumn(
        "quality", F.when(F.coalesce(F.col("rejection_reason"), F.lit("")).isin("too short", "silent"), F.lit(None)).otherwise(F.col("quality"))
    ).drop("__t")


def grow_bank(bank: DataFrame, ingested: DataFrame, n: int = 20) -> DataFrame:
    """Bank plus accepted clips, cut to the n best per speaker."""
    cols = ["emb_id", "speaker_id", "vec", "quality", "created"]
    return retain_best(
        bank.select(*cols).unionByName(ingested.filter("accepted").select(*cols)), n
    )
