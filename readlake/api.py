"""compress, decompress, index, query: the engine's entry points."""

from __future__ import annotations

import hashlib
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reads as rd
from .operators import reference as ref
from .operators.integrity import MODES, file_fingerprint
from .operators.mapping import Held
from .sources import archive, blocks
from .sources.fasta import FastaSource, contigs
from .sources.fastq import FastqSource
from .sources.files import local_paths

log = logging.getLogger("readlake")


def register(spark: SparkSession) -> None:
    for s in (FastqSource, FastaSource, blocks.BlockSource):
        spark.dataSource.register(s)


def open_reads(spark: SparkSession, path: str, mode: str = "PERMISSIVE", split_bytes: int = 32 << 20, keep_cr: bool = False) -> DataFrame:
    """Reads of FASTQ files, plain or gzip by their content. ``keep_cr``: a record whose lines end in a carriage return has one after its id."""
    register(spark)
    return spark.read.format("fastq").option("mode", mode).option("splitBytes", split_bytes).option("keepCR", str(keep_cr)).load(path)


def open_reference(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a reference; the files of a folder lie one after the other, in the order of their names."""
    register(spark)
    d = spark.read.format("fasta").load(path)
    if len(local_paths(path)) == 1:
        return d
    before, at = {}, 0
    for r in d.groupBy("file_idx").agg(F.sum(F.length("seq")).alias("n")).orderBy("file_idx").collect():  # a row a file
        before[r["file_idx"]], at = at, at + r["n"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("file_idx")) if before else F.lit(0)
    return d.withColumn("base0", F.col("base0") + offset.cast("long"))


def fingerprint(path: str) -> str:
    """Of a file; of several, of their fingerprints in order."""
    found = []
    for p in local_paths(path):
        with open(p, "rb") as f:
            found.append(file_fingerprint(f))
    return found[0] if len(found) == 1 else hashlib.md5("".join(found).encode()).hexdigest()[:8]


def kind_of(spark: SparkSession, path: str) -> str:
    """``fastq`` where every record of every file is valid, else ``binary``."""
    ok = F.lit(True)
    for v in rd.checks().values():
        ok = ok & v
    id_ = F.when(F.col("id").endswith("\r"), F.expr("substring(id, 1, length(id) - 1)")).otherwise(F.col("id"))
    least = open_reads(spark, path, keep_cr=True).withColumn("id", id_).select(F.coalesce(ok, F.lit(False)).cast("int").alias("ok")).agg(F.min("ok")).first()[0]
    return "fastq" if least == 1 else "binary"


def compress(spark: SparkSession, path: str, out: str, reference: str | None = None, force: bool = False, remove: bool = False, pack: bool = False, level: int = 5) -> None:
    """Files to an archive: FASTQ as columns, anything else as blocks of bytes. ``level`` sets the size of blocks. ``remove`` deletes the input, after the
    archive was read back and found whole; ``pack`` keeps what is needed of the reference in the archive."""
    mode, size = "overwrite" if force else "errorifexists", rd.LEVELS[level]
    if kind_of(spark, path) == "binary":
        blocks.write(spark.read.format("blocks").option("blockBytes", min(size, blocks.SIZE)).load(path), out, mode)
        if remove:
            if blocks.unpacked(spark.read.parquet(f"{out}/data")).where("not coalesce(ok, false)").limit(1).count():
                raise ValueError(f"{out} is damaged; the input stays")
            for p in local_paths(path):
                os.remove(p)
        return
    segments = open_reference(spark, reference) if reference else None
    facts = {} if segments is None else {"reference": os.path.basename(reference), "reference_len": int(segments.agg(F.sum(F.length("seq"))).first()[0] or 0), "reference_fp": fingerprint(reference)}
    archive.write(open_reads(spark, path, "FAILFAST", size, keep_cr=True), out, segments, mode, facts | {"level": level}, pack)
    if remove:
        if archive.damaged(spark, out, segments).limit(1).count():
            raise ValueError(f"{out} is damaged; the input stays")
        for p in local_paths(path):
            os.remove(p)


def decompress(spark: SparkSession, path: str, out: str, reference: str | None = None, zipped: bool = False, force: bool = False, mode: str = "FAILFAST") -> None:
    """An archive back to FASTQ text, or to the files that it was made of. Blocks are held against their MD5 first: damaged ones fail it
    (FAILFAST), are left out (DROPMALFORMED), or are written with a warning (PERMISSIVE)."""
    if mode not in MODES:
        raise ValueError(mode)
    if archive.meta(spark, path).get("kind") == "binary":
        blocks.restore(spark, path, out, force, mode)
        return
    segments = check_reference(spark, path, reference)
    held = None if segments is None else Held(segments)  # for both
    reads = archive.read(spark, path, segments, held=held)
    bad = archive.damaged(spark, path, segments, held)
    if mode == "DROPMALFORMED":
        reads = reads.join(bad.select("file_idx", "block_id"), ["file_idx", "block_id"], "left_anti")
    elif n := bad.count():
        if mode == "FAILFAST":
            raise ValueError(f"{n} damaged blocks in {path}")
        log.warning("%d damaged blocks in %s", n, path)
    archive.write_text(reads, out, zipped, "overwrite" if force else "errorifexists")


def check_reference(spark: SparkSession, path: str, reference: str | None) -> DataFrame | None:
    facts = archive.meta(spark, path)
    if not facts.get("mapped") or facts.get("packed"):
        return None
    if reference is None:
        raise ValueError("this archive needs its reference")
    segments = open_reference(spark, reference)
    n = int(segments.agg(F.sum(F.length("seq"))).first()[0] or 0)
    if n != facts["reference_len"]:
        raise ValueError(f"the archive's reference has {facts['reference_len']} bases, this one {n}")
    if fingerprint(reference) != facts["reference_fp"]:
        log.warning("another file than %s, of the same length: blocks' checksums will tell", facts["reference"])
    return segments


def index(spark: SparkSession, reference: str, out: str, force: bool = False) -> None:
    """The seed index of a reference as tables: ``postings``, ``contigs``."""
    segments = open_reference(spark, reference)
    mode = "overwrite" if force else "errorifexists"
    ref.postings(ref.seeds(segments)).repartitionByRange("key").sortWithinPartitions("key").write.mode(mode).parquet(f"{out}/postings")
    contigs(segments).write.mode(mode).parquet(f"{out}/contigs")


def cached_index(spark: SparkSession, reference: str, cache: str) -> DataFrame:
    """The postings of a reference from a cache folder: built where there are none for this file by name, fingerprint, time and size.

    An index is written beside its place and then renamed, and the manifest after it, so a reader never sees half of one.
    """
    os.makedirs(cache, exist_ok=True)
    manifest, name = os.path.join(cache, "manifest.json"), os.path.basename(reference)
    known = json.load(open(manifest)) if os.path.exists(manifest) else {}
    stat = os.stat(reference)
    facts = {"index": f"{name}.{fingerprint(reference)}", "mtime": int(stat.st_mtime), "size": stat.st_size}
    place = os.path.join(cache, facts["index"])
    if known.get(name) != facts or not os.path.isdir(place):
        fresh = f"{place}.{os.getpid()}"
        index(spark, reference, fresh, force=True)
        if os.path.isdir(place):
            os.rename(place, f"{fresh}.old")
        os.rename(fresh, place)
        with open(f"{manifest}.{os.getpid()}", "w") as f:
            json.dump(known | {name: facts}, f, indent=1, sort_keys=True)
        os.replace(f"{manifest}.{os.getpid()}", manifest)
    return spark.read.parquet(f"{place}/postings")


def query(spark: SparkSession, path: str, region: str, reference: str) -> DataFrame:
    """The reads of an archive that map to ``contig:from-to`` (from 1, ends included)."""
    if not archive.meta(spark, path).get("mapped"):
        raise ValueError("this archive was written without a reference")
    segments = check_reference(spark, path, reference) or open_reference(spark, reference)
    name, _, span = region.partition(":")
    at = contigs(segments).where(F.col("contig") == name).first()
    if at is None:
        raise ValueError(f"no contig {name}")
    lo, _, hi = (span or f"1-{at['len']}").partition("-")
    first, last = int(lo), int(hi or lo)
    return archive.read(spark, path, segments, (at["base0"] + first - 1, at["base0"] + min(last, at["len"])))
