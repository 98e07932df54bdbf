"""Delta streams: each row against the row before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import prefix_length, suffix_length


def affixes(rows: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """Prefix and suffix shared with the row before in the group (the suffix within what the prefix leaves), and the middle."""
    prev = F.coalesce(F.lag(text).over(Window.partitionBy(group).orderBy(key)), F.lit(""))
    d = rows.select(group, key, F.col(text).alias("text"), prev.alias("prev")).withColumn("prefix", prefix_length(F.col("text"), F.col("prev")))
    rest = lambda c: F.substring(c, F.col("prefix") + 1, F.length(c))
    d = d.withColumn("suffix", suffix_length(rest(F.col("text")), rest(F.col("prev"))))
    middle = F.substring("text", F.col("prefix") + 1, F.length("text") - F.col("prefix") - F.col("suffix"))
    return d.withColumn("middle", middle)


def restore(prev, prefix, suffix, middle):
    """A row from the row before it and its delta."""
    return F.concat(F.substring(prev, F.lit(1), prefix), middle, F.substring(prev, F.length(prev) - suffix + 1, suffix))
