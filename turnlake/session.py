"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Settings every job wants; sizes (partitions, memory) belong to the cluster.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split hot join keys even where the split costs one more exchange above it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "turnlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_FALLBACK: list[str] = []
_SHIPPED: set[str] = set()


def is_local(spark: SparkSession) -> bool:
    """True where the driver is the only executor, so that its own folders are shared by definition."""
    return spark.conf.get("spark.master", "").split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints (setting or context).

    A temporary folder stands in on a ``local`` master only; elsewhere a missing setting is an error,
    because executors would write to disks that nobody else sees.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not is_local(spark):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="turnlake-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/turnlake-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    return path


@contextmanager
def listing(spark: SparkSession, jobs: int) -> Iterator[None]:
    """Readers made inside list their folders in ``jobs`` tasks; Spark's own choice is one task a folder, up to 10,000."""
    before = spark.conf.get(LISTING_CONF, None)
    spark.conf.set(LISTING_CONF, str(jobs))
    try:
        yield
    finally:
        spark.conf.unset(LISTING_CONF) if before is None else spark.conf.set(LISTING_CONF, before)


def settle(df, label: str):
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application settled; call it once the results that read it are written."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/turnlake-{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="turnlake-ship-"), "turnlake.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
