"""Writing intermediate results to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only on a single machine there is a default of our own; on a cluster nobody else could read it."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts the lineage, fixes what non-deterministic expressions gave, and
    lets later joins see the true size. A lost executor costs nothing, as the
    files are in shared storage. They stay there: whoever sets the folder clears it.
    """
    path = f"{shared_dir(df.sparkSession)}/textloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` dealt out by columns to as many tasks as a shuffle has: for small rows that become much work, of which Spark would give one task as much as it reads at once."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Whether Spark deletes the shuffle files of a query when that ends; otherwise they stay until its driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, shuffles of a query are deleted once it is written, so that they don't lie on disk beside those of the next."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
