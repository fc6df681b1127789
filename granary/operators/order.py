"""Global numbering and neighbour links without sending all rows through one task.

The order is cut into buckets by a column that grows with it. Rows are numbered within their bucket; only one row a
bucket goes through the single task that sums the buckets up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, bucket: Column, order: list, out: str, start: int = 0) -> DataFrame:
    """``df`` with a column ``out``: the place of each row in the order (bucket, order), from ``start`` + 1 on. Null buckets come first."""
    t = df.withColumn("_bucket", bucket)
    sizes = t.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    t = t.withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    return t.join(before, t["_bucket"].eqNullSafe(before["_b"])).withColumn(out, (F.col("_before") + F.col("_place") + start).cast("long")).drop("_bucket", "_b", "_before", "_place")


def link_neighbours(df: DataFrame, bucket: Column, order: list[str], key: str, prev: str = "prev_id", next_: str = "next_id") -> DataFrame:
    """``df`` with the keys of the row before and the row after in the order (bucket, order); null at the ends."""
    t = df.withColumn("_bucket", bucket)
    w = Window.partitionBy("_bucket").orderBy(*order)
    sort_key = F.struct(*order, key)
    ends = t.groupBy("_bucket").agg(F.min_by(key, sort_key).alias("_first"), F.max_by(key, sort_key).alias("_last"))
    days = Window.orderBy("_bucket")
    ends = ends.select("_bucket", F.lag("_last").over(days).alias("_before"), F.lead("_first").over(days).alias("_after"))
    t = t.withColumn(prev, F.lag(key).over(w)).withColumn(next_, F.lead(key).over(w))
    return t.join(ends, "_bucket").withColumn(prev, F.coalesce(prev, "_before")).withColumn(next_, F.coalesce(next_, "_after")).drop("_bucket", "_before", "_after")
