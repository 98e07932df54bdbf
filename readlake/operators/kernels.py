"""Sequences as arrays, for ``mapInArrow``: codes of a column's lines, keys of their 31-mers, a packed reference and its seeds.

A code is a base's number in ``bases.CODES``; the complement of a code is the code XOR 2. N counts as G, case doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bases as B
from .reference import K, POSTINGS, STRIDE

SHORT, CLOSE = 35, 2
#: Bases that are worked on at once, so that their arrays stay in a core's cache.
SOME = 1 << 17
CODE = np.zeros(256, np.uint8)
for _i, _c in enumerate(B.CODES):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i
CODE[ord("N")] = CODE[ord("n")] = 3
LETTER = np.frombuffer(B.CODES.encode(), np.uint8)
#: The four codes of each byte, first base highest.
UNPACK = np.stack([np.arange(256) >> s & 3 for s in (6, 4, 2, 0)], 1).astype(np.uint8).view(np.uint32).ravel()
MIX = np.uint64(0x9E3779B97F4A7C15)


class Lines:
    """The bytes of a string column's rows."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.string()) if column.type != pa.string() else column
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.start, self.size = o[:-1], np.diff(o)
        self.null = np.asarray(column.is_null()) if column.null_count else None
        if self.null is not None:
            self.size = np.where(self.null, 0, self.size)

    def take(self, rows: np.ndarray, n: int) -> np.ndarray:
        """Rows of ``n`` bytes each, as a matrix."""
        s = self.start[rows]
        if (np.diff(s) == n).all():
            return self.data[s[0] : s[0] + len(rows) * n].reshape(len(rows), n)
        return self.data[s[:, None] + np.arange(n)]

    def by_length(self) -> Iterator[tuple[int, np.ndarray]]:
        """Rows of one length, some at once."""
        order = np.argsort(self.size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.size[order])) + 1) if len(order) else ():
            n = int(self.size[rows[0]])
            some = max(1, SOME // max(1, n))
            for a in range(0, len(rows), some):
                yield n, rows[a : a + some]


class Text:
    """A string column of known lengths, filled row by row."""

    def __init__(self, size: np.ndarray, null: np.ndarray | None = None):
        self.offsets = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        if self.offsets[-1] >= 1 << 31:
            raise ValueError("more than 2 GB of text in a batch")
        self.data, self.null = np.zeros(self.offsets[-1], np.uint8), null

    def put(self, rows: np.ndarray, text: np.ndarray) -> None:
        if text.size == 0:
            return
        s, n = self.offsets[rows], text.shape[1]
        if (np.diff(s) == n).all():
            self.data[s[0] : s[0] + text.size] = text.ravel()
        else:
            self.data[s[:, None] + np.arange(n)] = text

    def column(self) -> pa.Array:
        valid = None if self.null is None else pa.py_buffer(np.packbits(~self.null, bitorder="little"))
        return pa.StringArray.from_buffers(len(self.offsets) - 1, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.data), valid)


def keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical key of each 31-mer of reads of one length (n, length), and whether it is the other strand's."""
    offs = codes.shape[1] - K + 1

    def sixteen(c: np.ndarray, turn: bool) -> np.ndarray:
        """Each 16 bases in 32 bits; of the other strand's if turned."""
        for step, kind in ((1, np.uint8), (2, np.uint8), (4, np.uint16), (8, np.uint32)):
            a, b = c[:, :-step], c[:, step:]
            c = (b if turn else a).astype(kind) << kind(2 * step) | (a if turn else b)
        return c

    f, r = sixteen(codes, False), sixteen(codes ^ np.uint8(2), True)
    fwd = (f[:, :offs] >> np.uint32(2)).astype(np.uint64) << np.uint64(32) | f[:, 15 : 15 + offs]
    rev = r[:, 15 : 15 + offs].astype(np.uint64) << np.uint64(30) | r[:, :offs] & np.uint32((1 << 30) - 1)
    flip = codes[:, K // 2 : K // 2 + offs] < 2
    return np.where(flip, rev, fwd), flip


def slots(key: np.ndarray, bits: int) -> np.ndarray:
    return key * MIX >> np.uint64(64 - bits)


def filter_bits(n_keys: int) -> int:
    """A filter's size: 16 to 32 bits a key, so that one key in 16 to 32 passes that isn't there."""
    return max(10, (16 * n_keys).bit_length())


def filled(slot: np.ndarray, bits: int) -> np.ndarray:
    held = np.zeros(1 << bits, np.uint8)
    held[slot] = 1
    return np.packbits(held)


def passes(held: np.ndarray, bits: int, key: np.ndarray) -> np.ndarray:
    """Which of the keys may be there."""
    s = slots(key, bits).astype(np.int64)
    return np.take(held, s >> 3) >> (7 - (s & 7)).astype(np.uint8) & 1 == 1


class Reference:
    """A sequence of ``size`` bases, packed four to a byte."""

    def __init__(self, packed: np.ndarray, size: int):
        self.packed, self.size = packed, size

    def windows(self, at: np.ndarray, n: int) -> np.ndarray:
        """The codes of ``n`` bases at each place."""
        wide = (n + 6) // 4
        rows = np.lib.stride_tricks.sliding_window_view(self.packed, wide)[at >> 2]
        codes, shift = UNPACK[rows].view(np.uint8), at & 3
        out = np.empty((len(at), n), np.uint8)
        for s in range(4):
            r = np.flatnonzero(shift == s)
            out[r] = codes[r, s : s + n]
        return out

    def restored(self, at: np.ndarray, strand: np.ndarray, diff: np.ndarray) -> np.ndarray:
        """Reads of one length from their places and differences, as codes."""
        own, on = diff.copy(), np.flatnonzero(strand < 2)
        own[on] ^= self.windows(at[on], diff.shape[1])
        back = strand == 1
        own[back] = (own[back] ^ 2)[:, ::-1]
        return own


class Index(Reference):
    """A reference with its seeds: distinct keys in order, their postings (place and strand in one number), and a filter."""

    def __init__(self, packed: np.ndarray, size: int):
        super().__init__(packed, size)
        n = (size - K) // STRIDE + 1 if size >= K else 0
        word = packed[: n * 8].view(">u8").astype(np.uint64)  # 32 bases each
        flip = (word >> np.uint64(32) & np.uint64(3)) < 2
        key = word >> np.uint64(2)
        x = key[flip] ^ np.uint64(0xAAAAAAAAAAAAAAAA)
        for step, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
            x = x >> np.uint64(step) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(step)
        key[flip] = x.byteswap() >> np.uint64(2)
        at = np.concatenate((np.flatnonzero(~flip), np.flatnonzero(flip)))  # by strand, then place
        at = at[np.argsort(key[at], kind="stable")]
        key = key[at]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, np.int64)
        rank = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        self.key = key[first]
        self.start = np.concatenate(([0], np.cumsum(np.minimum(np.diff(np.append(first, n)), POSTINGS)))).astype(np.uint32)
        at = at[rank < POSTINGS]
        self.post = (at << 1 | flip[at]).astype(np.uint32)
        self.bits = filter_bits(len(self.key))
        self.held = filled(slots(self.key, self.bits), self.bits)

    def candidates(self, reads: np.ndarray) -> tuple[np.ndarray, ...]:
        """(read, off, rn, at, strand) of all seed hits in bounds, by read, offset and posting; reads of one length, as codes."""
        n, size = reads.shape
        if size <= SHORT or not len(self.key) or not n:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        key, flip = keys(reads)
        probe = np.flatnonzero(passes(self.held, self.bits, key.ravel()))
        key = key.ravel()[probe]
        slot = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[slot] == key
        probe, slot = probe[there], slot[there]
        lo = self.start[slot].astype(np.int64)
        many = self.start[slot + 1] - lo
        rn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        post = self.post[np.repeat(lo, many) + rn].astype(np.int64)
        probe = np.repeat(probe, many)
        read, off = np.divmod(probe, size - K + 1)
        strand = flip.ravel()[probe] ^ (post & 1)
        at = (post >> 1) * STRIDE - np.where(strand == 0, off, size - K - off)
        ok = (at >= 0) & (at + size <= self.size)
        return read[ok], off[ok], rn[ok] + 1, at[ok], strand[ok]

    def own(self, reads: np.ndarray, strand: np.ndarray) -> np.ndarray:
        out, back = reads.copy(), strand == 1
        out[back] = (reads[back] ^ 2)[:, ::-1]
        return out

    def places(self, reads: np.ndarray) -> tuple[np.ndarray, ...]:
        """(read, first, at, strand, hits, wrong): each place of a read once, with its first candidate's number, candidates and mismatches."""
        read, _, _, at, strand = self.candidates(reads)
        _, first, hits = np.unique((read * self.size + at) * 2 + strand, return_index=True, return_counts=True)
        read, at, strand = read[first], at[first], strand[first]
        wrong, size = np.zeros(len(read), np.int32), reads.shape[1]
        some = max(1, 4 * SOME // max(1, size))
        for a in range(0, len(read), some):
            s = slice(a, a + some)
            wrong[s] = np.count_nonzero(self.own(reads[read[s]], strand[s]) != self.windows(at[s], size), 1)
        return read, first, at, strand, hits, wrong

    def map(self, reads: np.ndarray) -> tuple[np.ndarray, ...]:
        """(mpos, mdir, mm, diff) of reads of one length, given as codes (n, length)."""
        n = len(reads)
        mpos, mdir, mm, diff = np.zeros(n, np.int64), np.full(n, 2, np.int32), np.full(n, -1, np.int32), reads.copy()
        read, first, at, strand, _, wrong = self.places(reads)
        if len(read):
            # A read's places come in the order of their first offset and posting.
            order = np.lexsort((first, np.where(wrong <= CLOSE, 0, wrong), read))
            won = order[np.concatenate(([True], read[order][1:] != read[order][:-1]))]
            r = read[won]
            mpos[r], mdir[r], mm[r] = at[won], strand[won], wrong[won]
            diff[r] = self.own(reads[r], strand[won]) ^ self.windows(at[won], reads.shape[1])
        return mpos, mdir, mm, diff


def reference(segments: DataFrame) -> tuple[np.ndarray, int]:
    """A reference's packed codes and its size, on the driver: two bits a base come there."""
    cell = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's segments as runs that begin where a byte does, but for what is left over at their ends."""
        for b in batches:
            lines, base0 = Lines(b.column(1)), b.column(0).to_numpy()
            some = np.flatnonzero(lines.size > 0)
            some = some[np.argsort(base0[some], kind="stable")]
            if not len(some):
                continue
            at, size = base0[some], lines.size[some]
            gap = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
            out: list[tuple[int, int, bytes]] = []
            for rows in np.split(some, gap):
                whole = (np.diff(lines.start[rows]) == lines.size[rows][:-1]).all()
                first, last = rows[0], rows[-1]
                text = lines.data[lines.start[first] : lines.start[last] + lines.size[last]] if whole else np.concatenate([lines.data[lines.start[r] : lines.start[r] + lines.size[r]] for r in rows])
                codes, begin = CODE[text], int(base0[first])
                a = 0
                while a < len(codes):
                    c = codes[a : a + (-(begin + a) % 4 or cell)]
                    out.append((begin + a, len(c), pack(c).tobytes()))
                    a += len(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["at", "n", "packed"])

    t = segments.select("base0", "seq").mapInArrow(run, "at bigint, n bigint, packed binary").toArrow()
    at, n = t["at"].to_numpy(), t["n"].to_numpy()
    size = int((at + n).max()) if len(at) else 0
    packed = np.zeros((size + 31) // 32 * 8 + 8, np.uint8)
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for a, k, piece in zip(at.tolist(), n.tolist(), (x for c in t["packed"].chunks for x in c), strict=True):
        held = np.frombuffer(piece.as_buffer(), np.uint8)
        if a % 4 == 0:  # whole bytes are taken as they are
            packed[a // 4 : a // 4 + k // 4] = held[: k // 4]
            done = k // 4 * 4
        else:
            done = 0
        if done < k:
            rest.append((np.arange(a + done, a + k), UNPACK[held[done // 4 :]].view(np.uint8)[: k - done]))
    for place, codes in rest:
        np.bitwise_or.at(packed, place >> 2, codes << (6 - 2 * (place & 3)).astype(np.uint8))
    return packed, size


def pack(codes: np.ndarray) -> np.ndarray:
    q = np.zeros((len(codes) + 3) // 4 * 4, np.uint8)
    q[: len(codes)] = codes
    q = q.reshape(-1, 4)
    return q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]
