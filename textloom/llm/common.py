"""Helpers that the training-data operators share."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from textloom.functions.storage import materialize  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_path(path: str) -> str:
    """A folder's path on the file system of every machine."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path} can't be mapped into memory; give a folder that is mounted on all machines")
    return url.path


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() does the same, and faster, where every character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def running_totals(df: DataFrame, keys: list[str], stretch: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, for each `values` entry total -> column, the exclusive running sum within `keys`.

    Rows are ordered by `stretch`, then by `order`. A window runs inside each
    stretch and a second one over the stretches' sums, so that no task gets all
    rows of a key. Null values count as zero. `keys` must not be null: then the
    join below finds the rows where the window has put them.
    """
    cut = df.withColumn("_stretch", stretch.cast("long"))
    sums = cut.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(f"_sum_{t}") for t, c in values.items()])
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
        F.col("_stretch").alias("_key_stretch"),
        *[F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_base_{t}") for t in values],
    )
    same = F.col("_stretch") == F.col("_key_stretch")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_key_{i}"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{t}") for t, c in values.items()])
    return cut.join(sums, same).select(*df.columns, *[(F.col(f"_in_{t}") + F.col(f"_base_{t}")).alias(t) for t in values])
