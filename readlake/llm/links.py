"""Connected components of links, by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``links`` (a, b: any orderable type) -> (node, root): each linked node but the least of its component, with that least node.

    Each step is a written table; nothing but a checksum of it comes to the driver. Null ends and loops link nothing.
    """
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = C.materialize(e, name)
    seen = None
    while True:
        # Sums a node are tables of their own: small ones are broadcast by their size, and a hub's rows can be split where not.
        both = e.union(e.select("b", "a"))
        least = C.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = C.materialize(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct(), name)
        low = C.materialize(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").select("b", "m").union(low.select("a", "m")).toDF("a", "b").where(F.col("a") != F.col("b")).distinct()
        old, e = e, C.materialize(small, name)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        C.drop_scratch(e.sparkSession, [x.scratch for x in (old, least, large, low)])
        if now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
