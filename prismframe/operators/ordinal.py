"""Dense positions and prefix sums of tables of any size, without a task that sees all rows.

Rows fall into buckets by the sort key; buckets are counted; a window over the
bucket table (a few thousand rows) gives each bucket's offset; positions within a
bucket come from a window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _by_bucket(df: DataFrame, bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    rows = df.withColumn("_bucket", bucket.cast("long"))
    totals = rows.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each bucket: BUCKETS at most where the caller buckets by draws, ids // step elsewhere.
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.join(offsets, "_bucket").withColumn(name, (F.col(name) + F.col("_offset")).cast("long")).drop("_bucket", "_offset")


def shuffled(df: DataFrame, draw: Column, tie: str, name: str = "_pos") -> DataFrame:
    """Positions in the order of a draw in [0, 1), ties by the column `tie`."""
    rows = df.withColumn("_draw", draw)
    return _by_bucket(rows, F.floor(F.col("_draw") * BUCKETS), [F.col("_draw"), F.col(tie)], F.lit(1), name).drop("_draw")


def in_order(df: DataFrame, key: str, name: str = "_pos", step: int = 65536) -> DataFrame:
    """Positions in the order of an integer key."""
    return _by_bucket(df, F.floor(F.col(key) / step), [F.col(key)], F.lit(1), name)


def prefix_sum(df: DataFrame, key: str, value: str, name: str, step: int = 65536) -> DataFrame:
    """The sum of `value` over the rows before each, by an integer key: byte pointers of a store."""
    return _by_bucket(df, F.floor(F.col(key) / step), [F.col(key)], F.col(value).cast("long"), name)
