"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


SPLIT_MB = 8         # a task that reads a table is given about so much of its files
SHUFFLED_MB = 16     # a task that reads a shuffle is given about so much of it
PARTITIONS = 600     # shuffles are cut into so many parts, which adaptive execution puts together again where they are small
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Adaptive execution with the skew split also where it needs another shuffle, and tasks whose share does not grow with the tables.

    Larger tables make more tasks, not larger ones, as aggregates of rare keys hold all that a task is given.  A session that has
    smaller parts already keeps them.
    """
    def at_most(name: str, mb: int) -> None:
        if _bytes(spark, spark.conf.get(name)) > mb << 20:
            spark.conf.set(name, f"{mb}m")
    at_most("spark.sql.files.maxPartitionBytes", SPLIT_MB)
    at_most("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHUFFLED_MB)
    at_most("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", 4 * SHUFFLED_MB)
    parts = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or 0) < parts:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def _bytes(spark: SparkSession, size: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(size))


def staging_base(checkpoints: str | None, warehouse: str, master: str) -> str:
    """The folder for staged tables: the one the cluster names, else the warehouse where that is no machine's own.

    A local folder will do where all tasks run on the driver's machine; on a cluster executors would not see one another's files."""
    if checkpoints:
        return checkpoints
    if not master.startswith("local") and (":" not in warehouse or warehouse.startswith("file:")):
        raise RuntimeError(f"the warehouse {warehouse} is a local folder; set spark.checkpoint.dir to one that all executors share")
    return f"{warehouse.rstrip('/')}/_staged"


def shared_dir(spark: SparkSession) -> str:
    """A new path for a table cut from its lineage, in a folder that all executors share.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; where that is unset, as in
    tests, the warehouse.  Each application has its own folder there, which goes when the application ends.
    """
    base = staging_base(spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"), spark.sparkContext.master)
    own = f"{base}/staged-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _OWN.add(own)
    return f"{own}/{uuid.uuid4().hex}"


_OWN: set[str] = set()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What a write in here shuffles is deleted once it is done, instead of lying on the disks until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write a frame to the shared folder now and read it back.

    For inputs that are read several times and are costly to work out again; the table
    outlives lost executors.  What was shuffled to work it out goes once it is written.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with swept(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
