"""Checksums, damaged blocks, ordered merge, archives' union, fingerprints."""

from __future__ import annotations

import hashlib
from typing import BinaryIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


def with_checks(rows: DataFrame, data: str) -> DataFrame:
    raw = F.encode(F.col(data), "UTF-8") if dict(rows.dtypes)[data] == "string" else F.col(data)
    return rows.withColumn("md5", F.md5(raw)).withColumn("crc", F.crc32(raw))


def verify(rows: DataFrame, data: str, stored: str = "md5", mode: str = "PERMISSIVE") -> DataFrame:
    """Blocks against their stored MD5: a damaged one is emptied, dropped, or fails the query."""
    if mode not in MODES:
        raise ValueError(mode)
    ok = F.md5(F.col(data)).eqNullSafe(F.col(stored))
    if mode == "DROPMALFORMED":
        return rows.where(ok)
    if mode == "FAILFAST":
        return rows.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("damaged block, stored md5 "), F.coalesce(F.col(stored), F.lit("none")))).cast("boolean")))
    return rows.withColumn(data, F.when(ok, F.col(data))).withColumn("damaged", (~ok).cast("int"))


def union_archives(*archives: DataFrame) -> DataFrame:
    """Blocks of several archives: numbers start anew in each, so the file's number comes first in their order."""
    out = None
    for i, a in enumerate(archives):
        a = a.withColumn("file_idx", F.lit(i))
        out = a if out is None else out.unionByName(a, allowMissingColumns=True)
    return out


def sampled_fingerprint(text: Column) -> Column:
    """MD5 over four samples of 1024 characters at 0, 1/4, 1/2 and 3/4 (the whole text if a quarter is shorter) and the length; 8 digits."""
    n = F.length(text)
    q = F.floor(n / 4)
    some = F.concat(*[F.substring(text, (q * i + 1).cast("int"), F.lit(1024)) for i in range(4)])
    return F.substring(F.md5(F.concat(F.when(q < 1024, text).otherwise(some), F.lit(":"), n.cast("string"))), 1, 8)


def file_fingerprint(file: BinaryIO) -> str:
    """The same of a file's bytes, with the length as 8 little-endian bytes: the name of its cached index. Four short reads."""
    n = file.seek(0, 2)
    q, parts = n >> 2, []
    for at, size in [(0, n)] if q < 1024 else [(q * i, 1024) for i in range(4)]:
        file.seek(at)
        parts.append(file.read(size))
    return hashlib.md5(b"".join(parts) + n.to_bytes(8, "little")).hexdigest()[:8]


def sequence_facts(segments: DataFrame) -> dict:
    """Length and checksum of a sequence in segments (``base0, seq``), however it is cut: pieces between the multiples of 4096 bases count."""
    cell = 4096
    own, end = F.col("base0"), F.col("base0") + F.length("seq")
    d = segments.where(F.length("seq") > 0).select("base0", "seq", F.explode(F.sequence(F.floor(own / cell), F.floor((end - 1) / cell))).alias("c"))
    lo = F.greatest(F.col("c") * cell, own)
    d = d.select("c", lo.alias("lo"), F.substring("seq", (lo - own + 1).cast("int"), (F.least((F.col("c") + 1) * cell, end) - lo).cast("int")).alias("s"))
    cells = d.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "s"))), lambda x: x["s"]), "").alias("s"))  # one cell's bases
    r = cells.agg(F.sum(F.length("s")).alias("len"), F.sum(F.xxhash64("c", F.upper("s")).cast("decimal(38,0)")).alias("sum")).first()
    return {"len": int(r["len"] or 0), "sum": str(int(r["sum"] or 0))}


def compare_facts(stored: dict, found: dict) -> str:
    """``same``, or what differs first: ``length``, ``content``."""
    return "length" if stored["len"] != found["len"] else "content" if stored["sum"] != found["sum"] else "same"
