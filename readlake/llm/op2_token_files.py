"""Token-id files with a shared zstandard dictionary.

Documents are range-partitioned by id (and the beginning of the text, so that an id that very many rows share is more than one
range) and sorted. Each partition encodes its documents, serializes the ids as little-endian unsigned 32-bit integers and compresses every document
on its own with one shared dictionary, which was trained on serialized id arrays. A file set has three Parquet tables, so that Spark's
committer, retries and any store that Spark writes to serve it:

    segments    part, seg    place of the segment in the order of the ids
                doc_ids, n_ids, offsets    ids, counts of ids and where each document's frame begins in the payload, and its end
                payload      the frames, of about ``SEGMENT`` bytes of ids
                dict_hash    SHA-256 of the dictionary that the frames need ('' for none)
    index       doc_id, part, seg, offset, length, n_ids    a row for each document, in order
    dictionary  one row

To read one document, its row of the index is found by the row groups' and pages' least and greatest ids, then its segment alone by part
and number: a row group of segments is ``GROUP`` bytes, so a short document costs no more than that, whatever the size of the corpus.

Only the dictionary is fitted on a bounded sample (``SAMPLE`` documents by least hash of the id, ``SAMPLE_BYTES`` of each): it bears on
size alone, never on what is read back. It is encoded in tasks.

Edge cases: null text is an empty document, which still has its end id; a null id comes first; repeated ids stand in
the order of their texts; too few documents for a dictionary: none is used; an empty table gives no segments and no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Documents that the dictionary is trained on at most, bytes of ids of each; its bytes; compression level.
SAMPLE, SAMPLE_BYTES, DICT_BYTES, LEVEL = 2000, 16 << 10, 64 << 10, 3
#: Bytes of a segment before compression, of a row group of segments, and of a page.
SEGMENT, GROUP, PAGE = 1 << 20, 4 << 20, 64 << 10
#: Characters of a text by which rows of one id are dealt out.
HEAD = 32
END_ID = 1
SCHEMA = "part int, seg int, doc_ids array<bigint>, n_ids array<int>, offsets array<int>, payload binary, dict_hash string, n_docs bigint, n_tokens bigint"
END = END_ID.to_bytes(4, "little")


def train(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str) -> bytes:
    """The shared dictionary, of a bounded sample of documents; b'' where there are too few."""
    import zstandard

    from .tokens import encoder

    h = F.xxhash64(F.col(id_col))
    least = docs.select(h.alias("h")).distinct().orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]  # hashes alone are sorted
    if least is None:
        return b""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(enc.encode(t.as_py()) + END)[:SAMPLE_BYTES] for t in b.column(1)], pa.binary())], names=["h", "ids"])

    rows = docs.where(h <= least).select(h.alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.length("t") > 0)
    got = rows.mapInArrow(encode, "h bigint, ids binary").orderBy("h", "ids").limit(SAMPLE).select("ids").collect()  # at most SAMPLE * SAMPLE_BYTES
    samples = [bytes(r["ids"]) for r in got]
    if len(samples) < 20:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of ``docs`` under ``path``: ``segments``, ``index`` and ``dictionary``."""
    spark = docs.sparkSession
    words = train(docs, id_col, text_col, tokenizer_path)
    digest = hashlib.sha256(words).hexdigest() if words else ""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        from .tokens import encoder

        enc, part, seg = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=LEVEL)
        if words:
            shared = zstandard.ZstdCompressionDict(words)
            shared.precompute_compress(level=LEVEL)  # else every document would digest it again
            pack = zstandard.ZstdCompressor(dict_data=shared)
        ids, counts, offsets, frames, raw = [], [], [0], [], 0
        kind = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("dict_hash", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "doc_ids": ids, "n_ids": counts, "offsets": offsets, "payload": b"".join(frames), "dict_hash": digest, "n_docs": len(ids), "n_tokens": sum(counts)}], schema=kind)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = enc.encode(text.as_py()) + END
                frame = pack.compress(got)
                ids.append(doc)
                counts.append(len(got) // 4)
                frames.append(frame)
                offsets.append(offsets[-1] + len(frame))
                raw += len(got)
                if raw >= SEGMENT:
                    yield row()
                    ids, counts, offsets, frames, raw, seg = [], [], [0], [], 0, seg + 1
        if ids:
            yield row()

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("head", F.substring("text", 1, HEAD)).repartitionByRange(C.parts(spark), "id", "head").sortWithinPartitions("id", "text").drop("head")
    d.mapInArrow(encode, SCHEMA).write.option("parquet.block.size", GROUP).option("parquet.page.size", PAGE).parquet(f"{path}/segments")
    seg = spark.read.schema(SCHEMA).parquet(f"{path}/segments").select("part", "seg", "doc_ids", "n_ids", "offsets")
    each = F.arrays_zip("doc_ids", "n_ids", F.slice("offsets", F.lit(1), F.size("doc_ids")).alias("lo"), F.slice("offsets", F.lit(2), F.size("doc_ids")).alias("hi"))
    row = seg.select("part", "seg", F.explode(each).alias("z"))
    row.select(F.col("z.doc_ids").alias("doc_id"), "part", "seg", F.col("z.lo").alias("offset"), (F.col("z.hi") - F.col("z.lo")).alias("length"), F.col("z.n_ids").alias("n_ids")).write.option("parquet.page.size", PAGE).parquet(f"{path}/index")
    spark.createDataFrame([(digest, bytearray(words))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def dictionary(spark: SparkSession, path: str) -> bytes:
    """The dictionary of the files at ``path``, held against its hash."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    words = bytes(row["dictionary"])
    if words and hashlib.sha256(words).hexdigest() != row["dict_hash"]:
        raise ValueError("the dictionary does not fit its hash")
    return words


def read(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """A row for each document of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids`` (binary)."""
    words, digest = (w := dictionary(spark, path)), hashlib.sha256(w).hexdigest() if w else ""
    seg = spark.read.parquet(f"{path}/segments")
    totals = seg.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each range partition
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = seg.select("part", "seg", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inner"))
    # Written, so that Spark sees how small it is beside the frames, and doesn't deal those out if it needn't.
    starts = C.materialize(inner.join(base, "part").select("part", "seg", (F.col("base") + F.col("inner")).alias("first")), "segment-starts")
    out = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
        for b in batches:
            for r in b.to_pylist():
                if r["dict_hash"] != digest:
                    raise ValueError(f"segment {r['part']}/{r['seg']} needs another dictionary")
                at, start, got = r["first"], [], []
                for k, n in enumerate(r["n_ids"]):
                    raw = pack.decompress(r["payload"][r["offsets"][k] : r["offsets"][k + 1]])
                    if len(raw) != 4 * n:
                        raise ValueError(f"document {r['doc_ids'][k]}: {len(raw)} bytes for {n} ids")
                    start.append(at)
                    got.append(raw)
                    at += n
                cols = [pa.array(r["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(r["n_ids"], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(got, pa.binary())] * ids, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    return seg.select("part", "seg", "doc_ids", "n_ids", "offsets", "payload", "dict_hash").join(starts, ["part", "seg"]).mapInArrow(decode, out)


def fetch(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each, if its id is repeated): its rows of the index by pushed id, then the segments that they name by
    pushed part and number; of other segments nothing but statistics is read."""
    import zstandard

    words = dictionary(spark, path)
    pack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    found = spark.read.parquet(f"{path}/index").where(F.col("doc_id") == F.lit(doc_id).cast("long")).orderBy("part", "seg", "offset").toLocalIterator()
    out, at, payload = [], None, b""
    for r in found:
        if at != (r["part"], r["seg"]):
            at = r["part"], r["seg"]
            payload = bytes(spark.read.parquet(f"{path}/segments").where((F.col("part") == at[0]) & (F.col("seg") == at[1])).select("payload").first()["payload"])
        out.append(list(memoryview(pack.decompress(payload[r["offset"] : r["offset"] + r["length"]])).cast("I")))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.new_path(spark, "tokens")
    write(C.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)
