"""The ``blocks`` data source: any files as blocks of bytes, and archives of them.

``file_idx, name, block_id, start, data``: ranges of each file, read in parallel. An archive of such files has each block compressed, with its
size and MD5. Blocks are restored in parallel too, each to its place in a file that has its whole length from the start.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import codecs
from .files import local_paths

SIZE = 8 << 20


class Part(InputPartition):
    def __init__(self, file_idx: int, path: str, block_id: int, start: int, size: int):
        self.file_idx, self.path, self.block_id, self.start, self.size = file_idx, path, block_id, start, size


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("blockbytes", options.get("blockBytes", SIZE)))

    def partitions(self) -> list[Part]:
        return [Part(i, p, k, a, self.size) for i, p in enumerate(local_paths(self.path)) for k, a in enumerate(range(0, max(1, os.path.getsize(p)), self.size))]

    def read(self, partition: Part) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            yield partition.file_idx, os.path.basename(partition.path), partition.block_id, partition.start, f.read(partition.size)


class BlockSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blocks"

    def schema(self) -> str:
        return "file_idx int, name string, block_id bigint, start bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return BlockReader(self.options)


def cut(rows: DataFrame, data: str, size: int) -> DataFrame:
    """``rows`` once for each block of ``size`` bytes of a binary column: ``block_id, start, data``. Nothing is one empty block."""
    n = F.octet_length(data)
    return rows.withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / size) - 1, F.lit(0)).cast("long")))).withColumn("start", F.col("block_id") * size).withColumn(data, F.substring(data, (F.col("start") + 1).cast("int"), F.lit(size)))


def packed(blocks: DataFrame, level: int = 3) -> DataFrame:
    """Blocks compressed, with ``n_bytes`` and ``md5`` of what they were."""
    return codecs.compress(blocks.withColumn("n_bytes", F.octet_length("data").cast("long")).withColumn("md5", F.md5("data")), "data", level)


def unpacked(blocks: DataFrame) -> DataFrame:
    """The blocks as they were, with ``ok``."""
    d = codecs.decompress(blocks, "data")
    return d.withColumn("ok", (F.md5("data") == F.col("md5")) & (F.octet_length("data") == F.col("n_bytes")))


def write(blocks: DataFrame, path: str, mode: str = "errorifexists", level: int = 3) -> None:
    spark = blocks.sparkSession
    packed(blocks, level).write.mode(mode).parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps({"writer": "readlake", "kind": "binary", "hashmethod": "md5"}, sort_keys=True),)], "meta string").coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def restore(spark: SparkSession, path: str, out: str, force: bool = False, mode: str = "FAILFAST") -> list[str]:
    """The archive's files in the folder ``out``. Damaged blocks fail it, or (DROPMALFORMED, PERMISSIVE) leave zeros in their place."""
    if os.path.exists(out) and not force:
        raise FileExistsError(out)
    blocks = spark.read.parquet(f"{path}/data")
    files = blocks.groupBy("file_idx", "name").agg(F.max(F.col("start") + F.col("n_bytes")).alias("size")).collect()  # a row a file
    back = unpacked(blocks)
    if mode == "FAILFAST" and (bad := back.where("not coalesce(ok, false)").count()):
        raise ValueError(f"{bad} damaged blocks in {path}")
    os.makedirs(out, exist_ok=True)
    for r in files:
        with open(os.path.join(out, r["name"]), "wb") as f:
            f.truncate(r["size"])

    def place(rows) -> None:
        for r in rows:
            with open(os.path.join(out, r["name"]), "r+b") as f:
                f.seek(r["start"])
                f.write(r["data"])

    back.where("ok").select("name", "start", "data").foreachPartition(place)
    return sorted(os.path.join(out, r["name"]) for r in files)
