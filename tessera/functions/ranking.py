"""Positions within a key that never need all rows of the key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that make one bucket.
WIDTH = 65_536


def running(df: DataFrame, key: str, order: str, amount: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with `name`: the sum of `amount` over the rows of the same key that come before (0 for the first).

    `order` is an integer without repeats within a key. Each key is cut into buckets of `width` order values; sums of buckets (one row
    each) give what comes before a bucket, a window inside the bucket the rest. A null key is a key like any other.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    sums = rows.groupBy(key, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    out = rows.join(starts, rows[key].eqNullSafe(starts["_key"]) & rows["_bucket"].eqNullSafe(starts["_of"]))
    return out.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_inside", "_key", "_of", "_start")


def positions(df: DataFrame, key: str, order: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with `name`: the row's 0-based place among the rows of its key, in the order of an integer column."""
    return running(df.withColumn("_one", F.lit(1)), key, order, "_one", name, width).drop("_one")
