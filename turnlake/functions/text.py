"""Scalar text expressions: tokens, normalisation, formatting, identifiers.

All are built-in Spark functions, so they stay inside whole-stage codegen or at
least inside the JVM.  Character classes are spelled out because ``\\s``/``\\w``
differ between regex engines.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators, keep-classes and patterns of the text formats.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
NOT_WORD = r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"
NOT_ALNUM = r"[^\p{L}\p{N}]"
SENTENCE_END = r"[.!?]+"
EPISODE_CODE = r"(?i)S(\d{1,2})E(\d{1,2})"
LABEL_LINE = r"^(\s*(?:\[[^\]\n]+\]\s*)?)([^:\n]+?)(:\s)"
NOT_PREFIX_SAFE = r"[^A-Za-z0-9_-]+"
UNKNOWN = "Unknown"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def words_of(col: Column) -> Column:
    """Non-empty whitespace-separated tokens."""
    return F.filter(F.split(col, SPACE), lambda w: w != F.lit(""))


def norm_text(col: Column) -> Column:
    """Lower case, punctuation deleted, whitespace collapsed (scoring form)."""
    return F.array_join(words_of(F.regexp_replace(F.lower(col), NOT_WORD, "")), " ")


def norm_words(col: Column) -> Column:
    return words_of(F.regexp_replace(F.lower(col), NOT_WORD, ""))


# Unicode blocks with decomposable letters: Latin, Greek, Cyrillic, letter-like, ligatures, full width.
_FOLDED = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


@lru_cache(maxsize=2)
def _fold_table(case_sensitive: bool) -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility decomposition without marks, derived from Unicode data.

    Returns one-to-one pairs for ``translate`` and the few one-to-many expansions.
    """
    source, target, longer = [], [], []
    for code in (c for low, high in _FOLDED for c in range(low, high)):
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char)
        kept = "".join(c for c in (plain if case_sensitive else plain.casefold()) if c.isalnum())
        if kept == char or not kept or not char.isalnum():
            continue
        if len(kept) == 1:
            source.append(char)
            target.append(kept)
        else:
            longer.append((char, kept))
    return "".join(source), "".join(target), tuple(longer)


def norm_name(col: Column, case_sensitive: bool = False) -> Column:
    """Lookup form of a name: accents folded, letters and digits only, case folded unless it counts."""
    text = F.trim(F.coalesce(col, F.lit("")))
    if not case_sensitive:
        text = F.lower(text)
    source, target, longer = _fold_table(case_sensitive)
    text = F.translate(text, source, target)
    if not case_sensitive:
        # Sharp s is common; the other expansions are rare and tested for once.
        text = F.replace(text, F.lit("ß"), F.lit("ss"))
    rest = [(c, k) for c, k in longer if c != "ß"]
    table = F.expr("map(" + ", ".join(f"'{c}', '{k}'" for c, k in rest) + ")")

    def expand(t: Column) -> Column:
        chars = F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.when(t.rlike("[" + "".join(c for c, _ in rest) + "]"), F.array_join(chars, "")).otherwise(t)

    return F.regexp_replace(let(text, expand), NOT_ALNUM, "")


def title(col: Column) -> Column:
    """Upper case for letters that follow no letter, lower case for all others."""

    def shaped(chars: Column) -> Column:
        starts = lambda i: (i == 0) | ~F.coalesce(F.get(chars, i - 1).rlike(r"^\p{L}$"), F.lit(False))
        return F.array_join(F.transform(chars, lambda c, i: F.when(starts(i), F.upper(c)).otherwise(F.lower(c))), "")

    return let(F.split(col, ""), shaped)


def norm_key(col: Column) -> Column:
    """Storage key of a display name: lower case letters and digits."""
    return F.regexp_replace(F.lower(col), NOT_ALNUM, "")


def match_case(original: Column, canonical: Column) -> Column:
    """Give ``canonical`` the upper/lower/title shape of ``original``."""
    has_upper = original != F.lower(original)
    has_lower = original != F.upper(original)
    return (
        F.when(F.coalesce(original, F.lit("")) == "", canonical)
        .when(has_upper & ~has_lower, F.upper(canonical))
        .when(has_lower & ~has_upper, F.lower(canonical))
        .when(has_upper & (original == title(original)), title(canonical))
        .otherwise(canonical)
    )


def split_sentences(col: Column) -> Column:
    return F.filter(
        F.transform(
            F.split(col, SENTENCE_END),
            lambda s: F.regexp_replace(s, f"^{SPACE}|{SPACE}$", ""),
        ),
        lambda s: s != F.lit(""),
    )


def _pad(col: Column, width: int) -> Column:
    # lpad would cut a value wider than the field; format_string does not.
    return F.format_string(f"%0{width}d", col)


def fmt_timestamp(ms: Column, sep: str = ".") -> Column:
    """``HH:MM:SS<sep>mmm`` of BIGINT milliseconds; negatives clamp to zero.

    Rounded and truncated forms coincide on whole milliseconds.
    """
    v = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.format_string(
        f"%02d:%02d:%02d{sep}%03d",
        F.floor(v / 3600000),
        F.floor(v / 60000) % 60,
        F.floor(v / 1000) % 60,
        v % 1000,
    )


def timestamp_suffix(ms: Column) -> Column:
    """`` [HH:MM:SS]`` when the stamp has a millisecond part, else empty."""
    v = F.greatest(ms, F.lit(0)).cast("bigint")
    return F.when(
        v % 1000 != 0, F.concat(F.lit(" ["), F.substring_index(fmt_timestamp(v), ".", 1), F.lit("]"))
    ).otherwise(F.lit(""))


def fmt_duration(seconds: Column) -> Column:
    """``45.2s`` / ``1m 2.0s`` / ``1h 2m 3s``."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(minutes < 60, F.format_string("%dm %.1fs", minutes, rest))
        .otherwise(
            F.format_string("%dh %dm %.0fs", F.floor(minutes / 60), minutes % 60, rest)
        )
    )


def episode_code(col: Column) -> Column:
    """struct(prefix, season, episode, variant) of the first SxxEyy; null when absent."""
    found = F.regexp_extract(col, EPISODE_CODE, 0)
    start = F.instr(col, found)
    prefix = F.regexp_replace(F.substring(col, F.lit(1), start - 1), r"[_\- ]+$", "")
    rest = F.substring(col, start + F.length(found), F.length(col))
    variant = F.nullif(F.regexp_replace(rest, r"^[_\- ]+", ""), F.lit(""))
    return F.when(
        found != "",
        F.struct(
            prefix.alias("prefix"),
            F.regexp_extract(col, EPISODE_CODE, 1).cast("int").alias("season"),
            F.regexp_extract(col, EPISODE_CODE, 2).cast("int").alias("episode"),
            variant.alias("variant"),
        ),
    )


def show_slug(name: Column) -> Column:
    """Alphanumeric tokens, title-cased and joined."""
    tokens = F.regexp_extract_all(name, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    return F.nullif(F.array_join(F.transform(tokens, _title_token), ""), F.lit(""))


def _title_token(token: Column) -> Column:
    # A letter right after a digit starts a new capital: 3rd -> 3Rd.
    parts = F.regexp_extract_all(token, F.lit("([0-9]+|[A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def build_episode_id(name: Column, season: Column, episode: Column, variant: Column) -> Column:
    code = F.concat(F.lit("S"), _pad(season, 2), F.lit("E"), _pad(episode, 2))
    return F.concat_ws("_", show_slug(name), code, F.nullif(variant, F.lit("")))


def slugify(col: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.lower(col), "[^a-z0-9]+", "_"), "^_+|_+$", ""
    )


def artifact_prefix(slug: Column, episode: Column, created: Column) -> Column:
    """``show_episode_yyyymmdd`` with unsafe characters replaced."""

    def safe(col: Column, fallback: str) -> Column:
        text = F.regexp_replace(F.coalesce(col, F.lit("")), NOT_PREFIX_SAFE, "_")
        text = F.regexp_replace(text, "^_+|_+$", "")
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))

    return F.concat_ws(
        "_", safe(slug, "show"), safe(episode, "episode"), F.date_format(created, "yyyyMMdd")
    )


def json_list_canon(col: Column) -> Column:
    """JSON list text -> sorted distinct trimmed non-empty strings; bad JSON -> []."""
    parsed = F.coalesce(F.from_json(col, "array<string>"), F.array().cast("array<string>"))
    cleaned = F.filter(F.transform(parsed, lambda s: F.trim(s)), lambda s: s != F.lit(""))
    return F.array_sort(F.array_distinct(cleaned))


def season_code(col: Column) -> Column:
    n = col.try_cast("int")
    return F.when(n.isNotNull(), F.concat(F.lit("S"), _pad(n, 2)))


def parse_stamp(text: Column, epoch: Column | None = None) -> Column:
    """ISO text (``Z`` allowed) or epoch seconds -> timestamp; unreadable -> null."""
    parsed = F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
    if epoch is None:
        return parsed
    return F.coalesce(parsed, F.timestamp_seconds(epoch))


def _half_even(x: Column, digits: int) -> Column:
    """x * 10^digits rounded half-even on the exact binary value, as BIGINT.

    The product's rounding error is recovered by splitting x, so a value just off
    a tie goes to its true side: the rule of correctly rounded decimal output.
    """
    scale = float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    low = F.floor(product)
    half = product - low
    up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (low % 2 != 0))))
    return low.cast("bigint") + F.when(up, 1).otherwise(0)


def exact_round(x: Column, digits: int) -> Column:
    """Decimal rounding, half to even on the binary value; infinities pass through."""
    x = x.cast("double")
    return F.when(F.abs(x) < 1e11, _half_even(x, digits) / float(10**digits)).otherwise(x)


def fixed2(x: Column) -> Column:
    """Two decimals of a non-negative number."""
    v = _half_even(x.cast("double"), 2)
    return F.concat(F.floor(v / 100).cast("string"), F.lit("."), _pad(v % 100, 2))


def ms_fixed2(ms: Column) -> Column:
    """Milliseconds as seconds with two decimals."""
    return fixed2(ms / 1000)


def ms_fixed3(ms: Column) -> Column:
    """Milliseconds as seconds with three decimals (exact)."""
    v = ms.cast("bigint")
    return F.concat(F.floor(v / 1000).cast("string"), F.lit("."), _pad(v % 1000, 3))
