"""Running totals and global numbering without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import materialize


def running_totals(df: DataFrame, keys: list[str], stretch: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, for each `values` entry total -> column, the exclusive running sum within `keys`.

    Rows are ordered by `stretch`, then by `order`. One window runs inside each
    stretch, another over the stretches' sums. Null values count as zero.
    """
    cut = df.withColumn("_stretch", stretch.cast("long"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*keys, "_stretch").agg(*[F.sum(c).alias(f"_sum_{t}") for t, c in values.items()])
    sums = sums.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], F.col("_stretch").alias("_key_stretch"),
        *[F.coalesce(F.sum(f"_sum_{t}").over(before), F.lit(0)).alias(f"_base_{t}") for t in values],
    )
    same = F.col("_stretch") == F.col("_key_stretch")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{t}") for t, c in values.items()])
    return cut.join(sums, same).select(*df.columns, *[(F.col(f"_in_{t}") + F.col(f"_base_{t}")).alias(t) for t in values])


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """`df` with a column that counts all rows in `order`, which must be unique, from `start`.

    Rows are range-partitioned and numbered within their partitions; the
    partitions' sizes, as many rows as there are partitions, give the offsets.
    The result is written, as the number of a row must not change afterwards.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_place", F.monotonically_increasing_id()))
    # an id is its partition's number times 2^33 and the row's place in it
    part, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    found = placed.withColumn("_part", part).join(offsets, "_part")
    return found.withColumn(name, F.col("_offset") + at + start).select(*df.columns, name)
