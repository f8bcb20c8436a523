"""Prefix sums and ranks over large ordered groups, in two levels.

A window over one huge group would run in one task. Here the group is cut into
ordered buckets: bucket totals (a small table) give each bucket its offset, and
a window inside the bucket does the rest. The result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list,
                  amount: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add ``name``: sum of ``amount`` over the rows up to (or before) this one.

    ``bucket`` must grow with ``order`` and split a group into parts of a size
    one task can sort.
    """
    df = df.withColumns({"_bucket": bucket, "_amount": amount})
    totals = df.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_total"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_offset", F.sum("_total").over(by_bucket))
               .where("_offset is not null")          # first buckets need none
               .select(*keys, "_bucket", "_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_inside", F.sum("_amount").over(inside)).join(
        offsets, [*keys, "_bucket"], "left")
    value = F.col("_inside") + F.coalesce("_offset", F.lit(0))
    if not inclusive:
        value = value - F.col("_amount")
    return out.withColumn(name, value).drop("_bucket", "_amount", "_inside", "_offset")


def hash_order(seed: int, key: Column) -> Column:
    """Order of a seeded shuffle: depends on seed and key only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def hash_bucket(order: Column) -> Column:
    """4,096 ordered buckets of a hexadecimal hash."""
    return F.left(order, F.lit(3))
