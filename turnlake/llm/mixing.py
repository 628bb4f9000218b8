"""Mix sources to target weights: certain whole copies, then Pareto order sampling of the rest.

A document's size is its number of words.  Every source gets a target share of words; a target stops at
``max_epochs`` times its source's size and the excess is shared out again by weight (water filling).  Within
a source each document has an expected number of copies, higher for shorter documents.  The whole part is
taken for certain.  The fraction p is drawn by order sampling: documents are ranked by the odds of a uniform
number divided by the odds p / (1 - p), and taken in that order until the source's target is reached; the
last place goes to the document whose size fits the open rest best.

The uniform number is a digest of seed, id and text, so reruns agree; equal rows tie and are told apart by
a row number that changes no result.  Null texts have size 0, a null source is a source of its own, ranked
last.  Empty tables give empty results.  Columns other than those named are carried by ``mix`` only.

Nothing is sorted per source: ranks are cut into ``BUCKETS`` ranges, words are summed per range, and only
the one range in which a target falls is ordered.  The source table (one row per source) is the only thing
that one task sees whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.session import settle

from .store import text_key

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096
WEIGHTS = (3, 1, 2)


def _weight(size: Column) -> Column:
    """Relative expected copies, as an integer so that sums are exact: (size + 64) ** -1/4."""
    return F.floor(F.lit(1048576.0) / F.sqrt(F.sqrt((size + 64).cast("double")))).cast("long")


def _uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) from the first 48 bits of a digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """Add ``target`` to (source, source_size, ...): shares of ``total`` (numerator, denominator) times all words.

    Sources weigh ``weights``, repeating, in code point order with null last.
    """
    up, down = total
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * max_epochs
    ranked = sources.withColumn("i", (F.row_number().over(by_name) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.col("i").cast("int") + 1).cast("long")
    )
    filled = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = F.coalesce(F.sum(cap).over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing))
    all_words = F.sum("source_size").over(everything)
    level = (up * all_words - down * before).cast("double") / (down * left).cast("double")
    # Filling the sources with the lowest caps first, the true level is the highest of all these.
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.col("level")))
        .drop("i", "weight", "level")
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
           max_epochs: int = 2, **shares) -> DataFrame:
    """One row per document: its id, source, size, text key, and ``copies`` (0 to ``max_epochs``)."""
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _uniform(seed, F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))).alias("u"),
        text_key(text_col).alias("key"),
    ).withColumn("weight", _weight(F.col("size"))).withColumn("row", F.monotonically_increasing_id())
    base = settle(base, "mix-documents")

    per_source = base.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("weight").cast("decimal(38,0)") * F.col("size")).alias("scaled")
    )
    plan = settle(targets(per_source, max_epochs=max_epochs, **shares), "mix-targets")

    drawn = base.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    expected = F.when(
        F.col("scaled") > 0,
        F.least(F.lit(float(max_epochs)), F.col("target") * F.col("weight") / F.col("scaled").cast("double")),
    ).otherwise(0.0)
    drawn = drawn.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    odds = F.col("u") / (1 - F.col("u")) / (p / (1 - p))
    # 0 to 1: drawn by rank; 2: never more than allowed.  A document with p = 0 comes after all others.
    rank = F.when(F.col("sure") >= max_epochs, 2.0).when(p <= 0, 1.0).otherwise(odds / (1 + odds))
    drawn = drawn.withColumn("rank", rank).withColumn(
        "bucket", F.when(F.col("rank") > 1, BUCKETS + 1).otherwise(F.floor(F.col("rank") * BUCKETS)).cast("int")
    )

    sums = drawn.groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.col("sure") * F.col("size")).alias("sure_words"), F.max("target").alias("target")
    )
    by_source = W.partitionBy("source")
    running = by_source.orderBy("bucket")
    cuts = (
        sums.withColumn("open", F.col("target") - F.sum("sure_words").over(by_source))
        .withColumn("through", F.sum("words").over(running))
        .withColumn("before", F.col("through") - F.col("words"))
        .where((F.col("bucket") <= BUCKETS) & (F.col("open") > 0) & (F.col("before") < F.col("open")))
        .groupBy("source")
        .agg(F.max("bucket").alias("cut"), F.max("before").alias("before"), F.max("open").alias("open"))
    )
    cuts = settle(cuts, "mix-cuts").withColumnRenamed("source", "s")
    placed = drawn.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    whole = placed.where(F.col("cut").isNull() | (F.col("bucket") != F.col("cut"))).withColumn(
        "more", F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0)
    )
    order = W.partitionBy("source").orderBy("rank", "id", "size", "row")
    partly = placed.where(F.col("bucket") == F.col("cut")).withColumn(
        "more", F.when(F.sum("size").over(order) <= F.col("open") - F.col("before"), 1).otherwise(0)
    )
    chosen = settle(whole.unionByName(partly), "mix-chosen")

    gaps = chosen.groupBy("source").agg(
        (F.max("open") - F.sum(F.col("more") * F.col("size"))).alias("gap")
    ).where(F.col("gap") > 0).withColumnRenamed("source", "s")
    miss = F.abs(F.col("gap") - F.col("size"))
    fits = (
        chosen.where((F.col("more") == 0) & (F.col("sure") < max_epochs) & (F.col("size") > 0))
        .join(gaps, F.col("source").eqNullSafe(F.col("s")))
        .where(miss < F.col("gap"))
        .groupBy("source")
        .agg(F.min(F.struct(miss.alias("miss"), "rank", "id", "size", "row")).alias("fit"))
        .select(F.col("fit.row").alias("fit_row"))
    )
    out = chosen.join(fits, chosen["row"] == fits["fit_row"], "left")
    return out.select(
        "id", "source", "size", "key", "source_size", "target",
        (F.col("sure") + F.col("more") + F.when(F.col("fit_row").isNotNull(), 1).otherwise(0)).alias("copies"),
    ).withColumnRenamed("id", id_col)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each repeated as often as the sample takes it."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    taken = sample(docs, **options).groupBy(F.col(id_col).alias("id"), "key", "source").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n_rows")
    ).where(F.col("copies") > 0)
    # The rows' own columns travel as one, whatever their names.
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("of"), text_key(text_col).alias("of_text"), F.col(source_col).alias("of_source"))
    joined = named.join(
        taken, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_text") == F.col("key")) & F.col("of_source").eqNullSafe(F.col("source"))
    )
    # Rows equal in id, source and text share their copies; they are numbered only where there are several.
    nth = F.row_number().over(W.partitionBy("id", "key", "source").orderBy(F.lit(0)))
    several = joined.where(F.col("n_rows") > 1).withColumn("nth", nth)
    single = joined.where(F.col("n_rows") == 1).withColumn("nth", F.lit(1))
    each = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("nth") <= F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    out = single.unionByName(several).withColumn("times", each.cast("int")).where(F.col("times") > 0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
