"""Name lookup, fuzzy matching and correction of speaker labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import top_n
from ..functions.text import LABEL_LINE, match_case, norm_name
from ..session import settle
from .name_index import close_matches, closest

# Confidence and rank of each lookup kind.
KIND_CONF = {"canonical": 1.0, "alias": 0.95, "misspelling": 0.9}
KIND_RANK = {"canonical": 0, "alias": 1, "misspelling": 2}


def _match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the matching row of ``right`` (unique keys; null is a key like any other) as a struct ``best``."""
    rest = [c for c in right.columns if c not in keys]
    side = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.struct(*rest).alias("best"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return left.join(side, same, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def cast_names(cast: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., ord, canonical, role, aliases[], misspellings[]) -> one row per registered name and kind."""
    names = F.concat(
        F.array(F.struct(F.lit("canonical").alias("kind"), F.lit(0).alias("pos"), F.col("canonical").alias("name"))),
        F.transform(F.coalesce("aliases", F.array().cast("array<string>")),
                    lambda a, i: F.struct(F.lit("alias").alias("kind"), i.alias("pos"), a.alias("name"))),
        F.transform(F.coalesce("misspellings", F.array().cast("array<string>")),
                    lambda a, i: F.struct(F.lit("misspelling").alias("kind"), i.alias("pos"), a.alias("name"))),
    )
    valid = cast.filter(norm_name(F.col("canonical")) != "")
    keep = [*by, *(c for c in ("src", "ord", "canonical", "role") if c in cast.columns)]
    return valid.select(*keep, F.inline(names)).filter(norm_name(F.col("name")) != "")


def name_lookup(cast: DataFrame, profiles: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Config names, then bank profiles; the first registration of a normalised form wins.

    Result: (by.., kind, norm, canonical, conf), unique per (by.., kind, norm).  ``by`` scopes names, by show for
    instance: a name of one show says nothing about another, and both tables carry the columns.
    """
    both = cast.withColumn("src", F.lit(0))
    if profiles is not None:
        both = both.unionByName(profiles.withColumn("src", F.lit(1)), allowMissingColumns=True)
    names = cast_names(both, by).withColumn("norm", norm_name(F.col("name")))
    firsts = names.groupBy(*by, "kind", "norm").agg(
        F.min_by("canonical", F.struct("src", "ord", "pos")).alias("canonical")
    )
    conf = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_CONF.items() for x in kv]), F.col("kind"))
    return firsts.withColumn("conf", conf)


def canonical_metadata(cast: DataFrame, profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Merged metadata per canonical name; values of the later source win, gaps are kept."""
    both = cast.withColumn("src", F.lit(0)).unionByName(
        profiles.withColumn("src", F.lit(1)), allowMissingColumns=True
    )
    when = F.struct("src", "ord")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c)
    return both.groupBy(*by, "canonical").agg(
        last("role"), last("speaker_key"),
        F.when(F.max("src") == 1, F.lit("bank")).otherwise(F.lit("config")).alias("source"),
    )


def canonical_names(lookup: DataFrame) -> DataFrame:
    return (
        lookup.filter(F.col("kind") == "canonical").select("canonical").distinct()
        .orderBy(F.lower("canonical"), "canonical")
    )


def lookup_name(names: DataFrame, lookup: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact lookup of distinct (by.., name, norm): canonical, then alias, then misspelling."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in KIND_RANK.items() for x in kv]), F.col("kind"))
    best = lookup.groupBy(*by, "norm").agg(
        F.min_by(F.struct("canonical", F.col("kind").alias("method"), "conf"), rank).alias("m")
    ).select(*by, "norm", "m.*")
    return _match(names, best, [*by, "norm"]).select(*names.columns, "best.canonical", "best.method", "best.conf")


def fuzzy_name(
    names: DataFrame, candidates: DataFrame, cutoff: float = 0.8, method: str = "ratio", by: Sequence[str] = ()
) -> DataFrame:
    """Best candidate per distinct name; ties go to the first registered.

    ``names`` hold unique (by.., norm), ``candidates`` are (by.., norm, canonical, ord).
    ``ratio`` is the matching-blocks ratio 2M/T; ``levenshtein`` is
    1 - distance/longest and stays in the JVM.  Below ``cutoff`` the canonical is
    null, the method ``no_match``, and the best score is kept.
    """
    best = closest(names, candidates, cutoff, method, by)
    hit = F.col("best.score") >= F.lit(cutoff)
    return _match(names, best, [*by, "norm"]).select(
        *names.columns,
        F.when(hit, F.col("best.canonical")).alias("canonical"),
        F.when(hit, F.lit("fuzzy")).otherwise("no_match").alias("method"),
        F.coalesce("best.score", F.lit(0.0)).alias("conf"),
    )


def correct_names(
    names: DataFrame,
    cast: DataFrame,
    profiles: DataFrame | None = None,
    cutoff: float = 0.8,
    method: str = "ratio",
    preserve_format: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Full correction of a (by.., name) table: (by.., name, cleaned, corrected, canonical, method, conf).

    Work runs on distinct normalised names: exact lookup first, fuzzy for the rest.
    """
    lookup = name_lookup(cast, profiles, by)
    heard = names.select(*by, "name").distinct().withColumn("cleaned", F.trim(F.coalesce("name", F.lit(""))))
    heard = heard.withColumn("norm", norm_name(F.col("cleaned")))
    distinct = heard.filter(F.col("norm") != "").select(*by, "norm").distinct()
    exact = settle(lookup_name(distinct, lookup, by), "names-exact")
    found = exact.filter(F.col("canonical").isNotNull())
    candidates = cast_candidates(cast, profiles, by)
    rest = exact.filter(F.col("canonical").isNull()).select(*by, "norm")
    resolved = found.unionByName(fuzzy_name(rest, candidates, cutoff, method, by))
    out = _match(heard, resolved, [*by, "norm"])
    canonical = F.col("best.canonical")
    target = match_case(F.col("cleaned"), canonical) if preserve_format else canonical
    return out.select(
        *by,
        "name",
        "cleaned",
        F.coalesce(target, F.col("cleaned")).alias("corrected"),
        canonical.alias("canonical"),
        F.when(F.col("cleaned") == "", F.lit("empty"))
        .when(F.col("norm") == "", F.lit("invalid"))
        .otherwise(F.col("best.method")).alias("method"),
        F.coalesce("best.conf", F.lit(0.0)).alias("conf"),
    )


def cast_candidates(cast: DataFrame, profiles: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Distinct canonical names in registration order, the candidates of a fuzzy search."""
    both = cast.select(*by, "canonical", F.struct(F.lit(0).alias("src"), F.col("ord").alias("o")).alias("at"))
    if profiles is not None:
        both = both.unionByName(
            profiles.select(*by, "canonical", F.struct(F.lit(1).alias("src"), F.col("ord").alias("o")).alias("at"))
        )
    return (
        both.groupBy(*by, "canonical").agg(F.min("at").alias("at"))
        .select(
            *by, norm_name(F.col("canonical")).alias("norm"), "canonical",
            (F.col("at.src") * (1 << 40) + F.col("at.o")).cast("bigint").alias("ord"),
        )
        .filter(F.col("norm") != "")
    )


def correct_speakers(
    segments: DataFrame, cast: DataFrame, profiles: DataFrame | None = None,
    auto_threshold: float = 0.9, cutoff: float = 0.8, method: str = "ratio", by: Sequence[str] = (),
) -> DataFrame:
    """Segments with corrected speakers; applied rows keep ``original_speaker``."""
    names = segments.select(*by, F.col("speaker").alias("name"))
    fixes = correct_names(names, cast, profiles, cutoff, method, by=by)
    # Distinct names on the right: the fact side is joined, not grouped.
    joined = _match(segments.withColumn("__name", F.col("speaker")), fixes.withColumnRenamed("name", "__name"), [*by, "__name"])
    best = lambda c: F.col(f"best.{c}")
    apply = best("canonical").isNotNull() & (best("corrected") != best("cleaned")) & (best("conf") >= auto_threshold)
    keep = [c for c in segments.columns if c not in ("speaker", "original_speaker")]
    before = F.col("original_speaker") if "original_speaker" in segments.columns else F.lit(None)
    return joined.select(
        *keep,
        F.when(apply, best("corrected")).otherwise(F.col("speaker")).alias("speaker"),
        F.coalesce(before, F.when(apply, F.col("speaker"))).alias("original_speaker"),
        F.when(apply, best("method")).alias("method"),
        F.when(apply, best("conf")).alias("correction_conf"),
    )


def correction_log(corrected: DataFrame) -> DataFrame:
    """One log row per applied segment."""
    return corrected.filter(F.col("method").isNotNull()).select(
        "episode_id", "seg_id", F.col("original_speaker").alias("original_text"),
        F.col("speaker").alias("corrected_text"), "method", F.col("correction_conf").alias("confidence"),
    )


def correct_text_labels(
    lines: DataFrame, cast: DataFrame, profiles: DataFrame | None = None,
    auto_threshold: float = 0.9, cutoff: float = 0.8, method: str = "ratio", key: Sequence[str] = ("doc_id", "line_no"),
    by: Sequence[str] = (),
) -> DataFrame:
    """Correct ``[prefix] name: `` labels of a (by.., key.., line) table, one row per line."""
    part = lambda i: F.regexp_extract("line", LABEL_LINE, i)
    split = lines.withColumn("__n", part(2)).withColumn("__p", part(1)).withColumn("__s", part(3))
    fixes = correct_names(split.filter(F.col("__n") != "").select(*by, F.col("__n").alias("name")), cast, profiles, cutoff, method, by=by)
    joined = _match(split, fixes.withColumnRenamed("name", "__n"), [*by, "__n"])
    best = lambda c: F.col(f"best.{c}")
    apply = best("canonical").isNotNull() & (best("corrected") != best("cleaned")) & (best("conf") >= auto_threshold)
    head = F.length("__p") + F.length("__n") + F.length("__s")
    rest = F.substring(F.col("line"), head + 1, F.length("line"))
    fixed = F.concat("__p", best("corrected"), "__s", rest)
    return joined.select(
        *by, *(k for k in key if k not in by), F.when(apply, fixed).otherwise(F.col("line")).alias("line"),
        F.coalesce(apply, F.lit(False)).alias("changed"),
    )


def text_to_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def name_search(names: DataFrame, query: str | None) -> DataFrame:
    """Case-insensitive substring filter of a canonical name list."""
    if not query:
        return names
    return names.filter(F.lower("canonical").contains(query.lower()))


def suggest(
    names: DataFrame, candidates: DataFrame, k: int = 3, cutoff: float = 0.65, method: str = "ratio", by: Sequence[str] = ()
) -> DataFrame:
    """Top-k close candidates per distinct (by.., norm), rank 1 best.

    ``ratio`` ranks as close matches are ranked: by the matching-blocks ratio of candidate and name, the larger
    candidate first among equals.  ``levenshtein`` puts the smaller one first.
    """
    met = close_matches(names.select(*by, "norm"), candidates, k, cutoff, method, by)
    tie = F.desc("canonical") if method == "ratio" else F.col("canonical")
    return top_n(met, [*by, "norm"], [F.desc("score"), tie], k).select(
        *by, "norm", "canonical", "score", F.col("rn").cast("bigint").alias("rank")
    )
