"""Structured streaming: reads as files arrive, and windowed counts with a watermark."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Reads of FASTQ files that come into a folder; a file is read whole, in one batch."""
    from ..api import register

    register(spark)
    return spark.readStream.format("fastq").option("mode", mode).load(path)


def stream_to_blocks(reads: DataFrame, out: str, checkpoint: str):
    """Each micro-batch's reads, as columns, under the batch's number: written once, also if the batch is run again."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(spark: SparkSession, path: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type. The table is read as a stream in one go; its last state is a table of the session."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path)
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    g = s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    view = f"counts_{os.urandom(6).hex()}"
    q = g.select(F.col("w.start").alias("start"), "event_type", "n").writeStream.outputMode("complete").format("memory").queryName(view).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(view)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
