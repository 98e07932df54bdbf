"""Archives: a folder of tables that holds reads as columns.

``reads`` has a row a record, partitioned by file, sorted within files by block and record, so that block numbers and mapped
positions prune row groups; ``blocks`` has each block's type, size, MD5 and position range; ``meta`` one JSON row. What a block
doesn't need is null: comments that are a plus or repeat the id, bases of mapped reads (their difference is kept).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import mapping, reads as R

VERSION = (1, 0, 0)
TEXT = "concat_ws('\n', id, bases, comment, qual, '')"


def block_md5(reads: DataFrame) -> DataFrame:
    """MD5 of each block's text, by way of its records' MD5 in order (32 characters a record)."""
    d = reads.groupBy("file_idx", "block_id").agg(F.sort_array(F.collect_list(F.struct("rec", F.md5(F.expr(TEXT)).alias("m")))).alias("r"), F.count("*").alias("n_rec"), F.sum(R.record_bytes()).alias("n_bytes"))
    return d.select("file_idx", "block_id", "n_rec", "n_bytes", F.md5(F.array_join(F.transform("r", lambda x: x["m"]), "")).alias("md5"))


def write(reads: DataFrame, path: str, segments: DataFrame | None = None, mode: str = "errorifexists", meta: dict | None = None, pack: bool = False, held: mapping.Held | None = None) -> None:
    """Write an archive; ``reads`` as the fastq source gives them. With reference segments, bases are kept as place and difference; ``pack``
    puts the parts of the reference that reads map to into the archive. ``held``: the segments, if tasks have them already."""
    spark = reads.sparkSession
    kind = F.when(F.col("comment") == "+", "PLUS").when(F.expr("substring(comment, 2) = substring(id, 2)"), "ID").otherwise("OTHER")
    d = reads.withColumn("comment_kind", kind).withColumn("comment", F.when(kind == "OTHER", F.col("comment")))
    d = d.withColumn("n_at", R.n_places(F.col("bases"))).withColumn("lower_at", lower_places())
    if segments is not None:
        d = d.withColumn("rid", F.col("file_idx").cast("long") * (1 << 44) + F.col("rec"))
        m = mapping.map_reads(d.select("rid", "bases"), segments, held)
        d = d.hint("shuffle_merge").join(m, "rid").withColumn("bases", F.lit(None).cast("string")).drop("rid", "mm")
    else:
        d = d.withColumn("mpos", F.lit(None).cast("long")).withColumn("mdir", F.lit(None).cast("int")).withColumn("diff", F.lit(None).cast("string"))
    d.repartition("file_idx", "block_id").sortWithinPartitions("file_idx", "block_id", "rec").write.mode(mode).option("compression", "zstd").partitionBy("file_idx").parquet(f"{path}/reads")
    pos = spark.read.parquet(f"{path}/reads").groupBy("file_idx", "block_id").agg(F.min("mpos").alias("min_pos"), F.max("mpos").alias("max_pos"))
    types = R.classify(reads.withColumn("block_id", F.struct("file_idx", "block_id"))).select(F.col("block_id.file_idx").alias("file_idx"), F.col("block_id.block_id").alias("block_id"), "block_type")
    block_md5(reads).join(pos, ["file_idx", "block_id"]).join(types, ["file_idx", "block_id"]).write.mode(mode).parquet(f"{path}/blocks")
    if pack and segments is not None:
        packed(segments, spark.read.parquet(f"{path}/reads")).write.mode(mode).option("compression", "zstd").parquet(f"{path}/reference")
    head = {"writer": "readlake", "version": VERSION, "hashmethod": "md5", "mapped": segments is not None, "packed": pack and segments is not None} | (meta or {})
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")



def packed(segments: DataFrame, mapped: DataFrame, cell: int = 4096) -> DataFrame:
    """The reference with A's for the segments that no read maps to: positions stay, and what isn't needed takes no room."""
    ends = F.floor(F.col("mpos") / cell), F.floor((F.col("mpos") + F.length("diff") - 1) / cell)
    hit = mapped.where(F.col("mdir") < 2).select(F.explode(F.sequence(*ends)).alias("c")).distinct()
    own = segments.select("base0", "seq", F.explode(F.sequence(F.floor(F.col("base0") / cell), F.floor((F.col("base0") + F.length("seq") - 1) / cell))).alias("c"))
    used = own.join(hit, "c", "left_semi").select("base0").distinct().withColumn("used", F.lit(1))
    return segments.join(used, "base0", "left").select("base0", F.when(F.col("used") == 1, F.col("seq")).otherwise(F.repeat(F.lit("A"), F.length("seq"))).alias("seq"))


def lower_places():
    return F.filter(F.transform(F.split("bases", ""), lambda x, i: F.when(x != F.upper(x), i)), lambda x: x.isNotNull())


def meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])


def read(spark: SparkSession, path: str, segments: DataFrame | None = None, positions: tuple[int, int] | None = None, held: mapping.Held | None = None) -> DataFrame:
    """The reads of an archive; a position range prunes to reads that begin in [lo, hi). ``held``: the segments, if tasks have them already."""
    d = spark.read.parquet(f"{path}/reads")
    if positions is not None:
        d = d.where((F.col("mpos") >= positions[0]) & (F.col("mpos") < positions[1]) & (F.col("mdir") < 2))
    if meta(spark, path).get("mapped"):
        if meta(spark, path).get("packed"):
            segments, held = spark.read.parquet(f"{path}/reference"), None
        if segments is None:
            raise ValueError("this archive needs its reference")
        d = d.withColumn("rid", F.col("file_idx").cast("long") * (1 << 44) + F.col("rec"))
        plain = mapping.restored(d.select("rid", "mpos", "mdir", "diff"), d, segments, held).withColumnRenamed("bases", "_b")
        d = d.hint("shuffle_merge").join(plain, "rid").withColumn("bases", F.col("_b"))
        at = F.filter(F.split("bases", ""), lambda x: x != "")
        fixed = F.transform(at, lambda x, i: F.when(F.array_contains("n_at", i), F.lit("N")).otherwise(x))
        fixed = F.transform(fixed, lambda x, i: F.when(F.array_contains("lower_at", i), F.lower(x)).otherwise(x))
        d = d.withColumn("bases", F.array_join(fixed, ""))
    comment = F.when(F.col("comment_kind") == "PLUS", F.lit("+")).when(F.col("comment_kind") == "ID", F.concat(F.lit("+"), F.expr("substring(id, 2)"))).otherwise(F.col("comment"))
    return d.withColumn("comment", comment).select("file_idx", "block_id", "rec", "id", "bases", "comment", "qual")


def damaged(spark: SparkSession, path: str, segments: DataFrame | None = None, held: mapping.Held | None = None) -> DataFrame:
    """Blocks whose restored text has another MD5 than when it was written."""
    now = block_md5(read(spark, path, segments, held=held)).select("file_idx", "block_id", F.col("md5").alias("now"))
    old = spark.read.parquet(f"{path}/blocks")
    return old.join(now, ["file_idx", "block_id"], "left").where(~F.col("md5").eqNullSafe(F.col("now")))


def text(reads: DataFrame) -> DataFrame:
    """Reads as text in order, over sorted ranges. Characters stand for bytes, as the fastq source reads them."""
    d = reads.repartitionByRange("file_idx", "block_id", "rec").sortWithinPartitions("file_idx", "block_id", "rec")
    turned = F.expr("concat(concat_ws('\r\n', substring(id, 1, length(id) - 1), bases, comment, qual), '\r')")  # all lines of the record had one
    return d.select(F.when(F.col("id").endswith("\r"), turned).otherwise(F.expr("concat_ws('\n', id, bases, comment, qual)")).alias("value"))


def write_text(reads: DataFrame, path: str, zipped: bool = False, mode: str = "errorifexists") -> None:
    """Reads as text files in order."""
    w = text(reads).select(F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.mode(mode)
    (w.option("compression", "gzip") if zipped else w).text(path)
