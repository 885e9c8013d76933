"""Running sums and positions within groups that may be very large."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def running_sums(df: DataFrame, keys: list[str], order: list[Column], **amounts: Column) -> DataFrame:
    """``df`` with, for each name, the sum of its amount over the rows of the same keys up to this one.

    The rows are sorted by range over all tasks, so a key's rows are blocks of consecutive
    rows. A block's running sums are its own plus the totals of the key's blocks before it;
    only those totals, one row for each key and block, meet in one task for a key. ``order``
    must leave no ties. The sorted rows are written to the shared folder.
    """
    placed = written(df.withColumns({f"__{n}": c.cast("long") for n, c in amounts.items()}).orderBy(*keys, *order).withColumn("__block", F.spark_partition_id()), "ordered")
    blocks = placed.groupBy(*keys, "__block").agg(*[F.sum(f"__{n}").alias(n) for n in amounts])
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"__{n}_before") for n in amounts])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__block") == F.col("__b"))
    inside = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({f"__{n}_inside": F.sum(f"__{n}").over(inside) for n in amounts}).join(before, on)
    return out.select(*df.columns, *[(F.col(f"__{n}_before") + F.col(f"__{n}_inside")).alias(n) for n in amounts])


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place, from 1, among the rows of its keys."""
    return running_sums(df, keys, order, **{name: F.lit(1)})
