"""Bounded-space online best-fit packing.

Every partition packs its own documents as they come, with at most ``OPEN`` open bins: each piece is put, for good, as soon as it is
read. Bins are kept by free space, and a bitset has bit f set while any open bin has f tokens free: the tightest bin that still takes a piece
is the lowest set bit at or above its length. A full bin closes; where one more than ``OPEN`` would be open, the fullest closes first.
A document longer than a sequence is cut so that all its pieces but the first fill a sequence each.

State is the bitset and the free lists, whatever the number of documents, and nothing is shuffled; partitions share no
bins, so a lost executor's partition is packed again to the same numbers.

Edge cases: a null or empty text is one end id; repeated rows are packed each; an empty table gives no rows; null ids
stay null. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, OPEN, END_ID = 1024, 2048, 2
#: Pieces of a batch of results.
ROWS = 1 << 14
SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


class Bins:
    """Open bins by free space. ``put(n)`` gives (sequence, offset) for a piece of n tokens."""

    def __init__(self, size: int = LENGTH, most: int = OPEN, first: int = 0):
        self.size, self.most, self.next = size, most, first
        self.bits, self.by_free, self.open = 0, [[] for _ in range(size + 1)], 0

    def _pop(self, free: int) -> int:
        held = self.by_free[free]
        seq = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.open -= 1
        return seq

    def put(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.size:
            raise ValueError(n)
        if fits := self.bits >> n:
            free = n + (fits & -fits).bit_length() - 1
            seq = self._pop(free)
        else:
            seq, free = self.next, self.size
            self.next += 1
        if left := free - n:
            if self.open == self.most:
                self._pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.by_free[left].append(seq)
            self.bits |= 1 << left
            self.open += 1
        return seq, self.size - free


def cut(n: int, size: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens."""
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece, with its ids (binary, little-endian unsigned 32-bit) if asked for."""
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import encoder

        enc, bins = encoder(tokenizer_path), Bins(first=TaskContext.get().partitionId() << 36)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
        out: list[list] = [[] for _ in names]
        held: list[bytes] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array(v, t) for v, t in zip(out, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.binary())] * ids, names=names + ["ids"] * ids)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = enc.encode(text.as_py()) + end
                for k, (start, n) in enumerate(cut(len(got) // 4)):
                    part = got[4 * start : 4 * (start + n)]
                    for col, v in zip(out, (doc, k, start, n, zlib.crc32(part), *bins.put(n)), strict=True):
                        col.append(v)
                    if ids:
                        held.append(part)
                if len(out[0]) >= ROWS:
                    yield batch()
                    out, held = [[] for _ in names], []
        if out[0]:
            yield batch()

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return d.mapInArrow(run, SCHEMA + ", ids binary" * ids)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
