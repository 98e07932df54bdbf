"""Shared pieces of the training-data operators: tables, scratch tables in the shared folder, word patterns."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Scratch tables that are still there: (session, path).
_LIVE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions of an explicit exchange: the session's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        own = tempfile.mkdtemp(prefix="readlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = "file://" + own
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/readlake/{name}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as a table in the shared folder and read again; cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def live_scratch() -> list[str]:
    return list(_LIVE)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables whose readers are done."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        h.getFileSystem(conf).delete(h, True)
        if p in _LIVE:
            _LIVE.remove(p)


def free(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of steps that are done: it does so when its driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    cut = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(GAP_CHARS)), GAP)
    return F.filter(cut, lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, also inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
