"""Versioned speaker bank on plain Parquet: profiles and vectors in buckets, a version log, replays without effect.

``<root>/profiles`` and ``<root>/vectors`` are partitioned by commit and bucket (a hash of the speaker's key).  A commit
writes only the buckets that a batch touched, with dynamic partition overwrite under its own name, so a retried write
replaces its own files and a failed one stays unseen; the rows of ``<root>/versions`` (version, batch, commit, bucket) make it
visible, written last and in one piece.  The state at a version is, per bucket, the newest commit logged up to it.  A batch whose id is in the log changes nothing, so a
replayed batch has no effect.  Readers of older versions see what they saw; one writer at a time is assumed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILES = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("display_name", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("first_episode", T.StringType()), T.StructField("total_segments", T.LongType()), T.StructField("auto_registered", T.BooleanType()),
])
VECTORS = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("source_episode", T.StringType()), T.StructField("cluster_id", T.StringType()),
    T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("quality", T.DoubleType()), T.StructField("created", T.LongType()),
])
_LOG = T.StructType([T.StructField("batch", T.StringType()), T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])


class BankStore:
    """Profiles and vectors of one bank below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _table(self, name: str, schema: T.StructType, *partitions: T.StructField) -> DataFrame:
        whole = T.StructType([*schema.fields, *partitions])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.root}/{name}")

    def log(self) -> DataFrame:
        """(version, batch, commit, bucket) of all commits."""
        return self._table("versions", _LOG, T.StructField("version", T.LongType()))

    def version(self) -> int:
        """Number of the newest version, 0 for an empty bank."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def _read(self, name: str, schema: T.StructType, version: int | None) -> DataFrame:
        log = self.log() if version is None else self.log().where(F.col("version") <= version)
        newest = log.where("bucket >= 0").groupBy("bucket").agg(F.max_by("commit", "version").alias("commit"))
        held = self._table(name, schema, T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType()))
        return held.join(F.broadcast(newest), ["commit", "bucket"]).select(*schema.names)  # at most ``buckets`` rows

    def profiles(self, version: int | None = None) -> DataFrame:
        return self._read("profiles", PROFILES, version)

    def vectors(self, version: int | None = None) -> DataFrame:
        return self._read("vectors", VECTORS, version)

    def bank(self, version: int | None = None) -> DataFrame:
        """The stored vectors as ``match_bank`` takes them; a speaker is its key."""
        named = self.profiles(version).select("key", "display_name")
        ident = F.xxhash64("key", "source_episode", "cluster_id")
        return self.vectors(version).join(named, "key").select(
            ident.alias("emb_id"), F.col("key").alias("speaker_id"), "display_name", "vec", "quality", "created"
        )

    def commit(self, batch: str, profiles: DataFrame, vectors: DataFrame) -> int:
        """Make the rows the state of their buckets; keys of other buckets stay.  Both hold all rows of the touched keys' buckets."""
        known = self.log().where(F.col("batch") == batch).agg(F.max("version")).first()[0]
        if known is not None:
            return known
        version = self.version() + 1
        commit = f"{version}-{hashlib.sha256(batch.encode()).hexdigest()[:16]}"
        for name, schema, rows in (("profiles", PROFILES, profiles), ("vectors", VECTORS, vectors)):
            dealt = rows.select(*(F.col(f.name).cast(f.dataType) for f in schema)).withColumns({"commit": F.lit(commit), "bucket": self.bucket()})
            dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("commit", "bucket").parquet(f"{self.root}/{name}")
        # A batch that touches nothing is logged too, under no bucket.
        touched = profiles.select(self.bucket().alias("bucket")).distinct().unionByName(self.spark.createDataFrame([(-1,)], "bucket int"))
        rows = touched.select(F.lit(batch).alias("batch"), F.lit(commit).alias("commit"), "bucket", F.lit(version).cast("long").alias("version"))
        rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{self.root}/versions")
        return version

    def bucket(self, key: str = "key") -> Column:
        """Bucket of a speaker."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
