"""Running totals over a whole table without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, key: str, value: Column, out: str, width: int = 4096) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows up to this one by ``key`` (a unique whole number).

    Rows are summed by ranges of ``width`` keys; only the ranges' sums, one row each, are totalled in one place, and within a range
    a window does the rest.
    """
    d = df.withColumn("_range", F.floor(F.col(key) / width)).withColumn("_value", value)
    sums = d.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    w = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inner = F.sum("_value").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_inner", inner).join(base, "_range").withColumn(out, (F.col("_base") + F.col("_inner")).cast("long")).drop("_range", "_value", "_base", "_inner")
