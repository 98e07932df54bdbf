"""Reads and a reference, derived from the driver's tables by formulas that both dialects share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases as B

HEX = "0123456789abcdef"
SEG, READ, BLOCK = 64, 100, 250


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read for each document: 40 to 64 bases, blocks of 250 ids, three kinds of comments by block."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("m"))
    s = F.col("doc_id").cast("string")
    n = (F.col("doc_id") % 25 + 40).cast("int")
    block = F.floor(F.col("doc_id") / BLOCK)
    ident = F.concat(F.lit("@"), F.col("source"), F.lit("."), s, F.lit(" "), F.col("lang"), F.lit("/"), F.col("n_chars").cast("string"))
    return d.select(
        block.alias("block_id"), F.col("doc_id").alias("rec"), ident.alias("id"),
        F.substring(F.translate(F.concat("m", F.md5(s)), HEX, "ACGTACGTACGTACGN"), F.lit(1), n).alias("bases"),
        F.when(block % 3 == 0, F.lit("+")).when(block % 3 == 1, F.concat(F.lit("+"), F.expr("substring(source, 1)"), F.lit("."), s, F.lit(" "), F.col("lang"), F.lit("/"), F.col("n_chars").cast("string"))).otherwise(F.concat(F.lit("+x"), s)).alias("comment"),
        F.substring(F.translate(F.concat(F.md5(F.concat(F.lit("q"), s)), F.md5(F.concat(F.lit("p"), s))), HEX, "FFFFFFFFFFF:::,,"), F.lit(1), n).alias("qual"), "n_chars",
    )


def broken(reads: DataFrame) -> DataFrame:
    """Reads of which some have a bad header, quality length or base."""
    return reads.select(
        "block_id", "rec", F.when(F.col("rec") % 17 == 0, F.expr("substring(id, 2)")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("rec") % 23 == 0, F.concat("bases", F.lit("X"))).otherwise(F.col("bases")).alias("bases"), "comment",
        F.when(F.col("rec") % 19 == 0, F.expr("substring(qual, 2)")).when(F.col("rec") % 23 == 0, F.concat("qual", F.lit("F"))).otherwise(F.col("qual")).alias("qual"),
    )


def _digits(key: Column) -> tuple[Column, Column]:
    k = key.cast("string")
    return F.md5(F.concat(F.lit("r"), k)), F.md5(F.concat(F.lit("s"), k))


def seg(key: Column) -> Column:
    return F.translate(F.concat(*_digits(key)), HEX, "ACGTACGTACGTACGT")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference: 64 bases a part (keys run from 0 without gaps)."""
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.select((F.col("p_partkey") * SEG).alias("base0"), seg(F.col("p_partkey")).alias("seq"))


def _dealt(d: DataFrame, key: str, rows: int) -> DataFrame:
    """Bare keys dealt to tasks of some ``rows`` each, before wide rows are made of them: how the table's files are cut doesn't matter."""
    return d.repartition(max(1, -(-d.count() // rows)), key)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 100 bases for each order: its place by key, one substitution, odd keys on the other strand."""
    total = table(spark, sf_dir, "part").count() * SEG
    o = _dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rid")), "rid", 1 << 15)
    at = (F.col("rid") * 37) % (total - READ)
    d = o.select("rid", at.alias("at"), F.floor(at / SEG).alias("k"))
    # A read reaches into three segments at most: they are made here from their keys, as the table's rows are.
    w = F.substring(F.concat(*[x for i in range(3) for x in _digits(F.col("k") + i)]), (F.col("at") % SEG + 1).cast("int"), F.lit(READ))
    d = d.select("rid", "at", F.translate(w, HEX, "ACGTACGTACGTACGT").alias("w"))
    p = (F.col("rid") % READ + 1).cast("int")
    swapped = F.concat(F.substring("w", F.lit(1), p - 1), F.translate(F.substring("w", p, F.lit(1)), "ACGT", "CATG"), F.substring("w", p + 1, F.lit(READ)))
    return d.select("rid", "at", F.when(F.col("rid") % 2 == 1, B.revcomp(swapped)).otherwise(swapped).alias("bases"))


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of 100 to 12,000 bases (at most half of the reference) for each supplier, odd keys on the other strand."""
    total = table(spark, sf_dir, "part").count() * SEG
    d = _dealt(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid")), "rid", 1 << 8)
    size = F.least(F.col("rid") * 1201 % 11901 + 100, F.lit(total // 2))
    d = d.select("rid", size.cast("int").alias("n")).withColumn("at", F.col("rid") * 997 % (total - F.col("n")))
    keys = F.sequence(F.floor(F.col("at") / SEG), F.floor((F.col("at") + F.col("n") - 1) / SEG))
    w = F.substring(F.array_join(F.transform(keys, lambda k: F.concat(*_digits(k))), ""), (F.col("at") % SEG + 1).cast("int"), F.col("n"))
    d = d.select("rid", F.translate(w, HEX, "ACGTACGTACGTACGT").alias("w"))
    return d.select("rid", F.when(F.col("rid") % 2 == 1, B.revcomp("w")).otherwise(F.col("w")).alias("bases"))
