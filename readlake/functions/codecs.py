"""Block codecs for ``mapInArrow``: zstandard, and the Burrows-Wheeler transform itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Blocks within these bounds may take the whole-block coder.
WHOLE = (32, 2146435072)
#: Characters that are transformed together at most; a matter of memory.
BLOCK = 1 << 20
#: Bytes of a batch's rows that are held as objects at once, and steps of the inverse transform that are made together.
SOME, STEP = 1 << 20, 256


def compress(df: DataFrame, data: str, level: int = 3) -> DataFrame:
    return _mapped(df, data, lambda z, x: z.ZstdCompressor(level=level).compress(x))


def decompress(df: DataFrame, data: str) -> DataFrame:
    return _mapped(df, data, lambda z, x: z.ZstdDecompressor().decompress(x))


def _mapped(df: DataFrame, data: str, work) -> DataFrame:
    at = df.columns.index(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for whole in batches:
            for b in slices(whole, at):
                cols = list(b.columns)
                cols[at] = pa.array([None if x is None else work(zstandard, x) for x in b.column(at).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, at: int, most: int = SOME) -> Iterator[pa.RecordBatch]:
    """A batch in slices of ``most`` bytes of a text or binary column, and of one row at least."""
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def _codes(text: str, end: str) -> np.ndarray:
    """Characters as dense ranks from 1; the end mark, which is less than all of them, is 0."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(c.max()) + 1, np.int32)
    used[c] = 1
    used[ord(end)] = 0
    rank = np.cumsum(used)
    rank[ord(end)] = 0
    return rank[c]


def _rotations(codes: np.ndarray) -> np.ndarray:
    """Where the sorted rotations begin: prefix doubling from packed characters, of which each round sorts what is still equal."""
    n = len(codes)
    bits = int(codes.max()).bit_length() or 1
    width, key = 1, codes.astype(np.int64)
    while 2 * width * bits <= 62 and width < n:  # characters by twos, fours and so on, all round
        key = key << bits * width | np.concatenate((key[width:], key[:width]))
        width *= 2
    at = np.argsort(key)
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ranks of sorted ``slots`` by their keys; the slots that aren't alone."""
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        rank[at[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        return slots[~(new & np.append(new[1:], True))]

    left = regroup(np.arange(n), key[at])
    while len(left):
        own = at[left]
        key = rank[own] * n + rank[(own + width) % n]
        o = np.argsort(key)
        at[left] = own[o]
        left, width = regroup(left, key[o]), width * 2
    return at


def bwt(text: str, end: str = "\0") -> str:
    """Last column of the sorted rotations of ``text`` and an end mark."""
    s = text + end
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return c[_rotations(_codes(s, end)) - 1].tobytes().decode("utf-32-le", "surrogatepass")


def unbwt(last: str, end: str = "\0") -> str:
    """The text whose transform this is, by the last-to-first mapping."""
    n, codes = len(last) - 1, _codes(last, end)
    if n < 1:
        return ""
    for kind in (np.uint8, np.uint16):  # these are sorted by their digits
        if codes.max() <= np.iinfo(kind).max:
            codes = codes.astype(kind)
            break
    jump = np.argsort(codes, kind="stable")
    out, have = np.empty(n, np.intp), 1
    out[0] = jump[jump[0]]
    while have < min(n, STEP):  # the jump is as many steps as are known
        m = min(have, n - have)
        out[have : have + m] = jump[out[:m]]
        jump, have = jump[jump], 2 * have
    for a in range(have, n, have):
        m = min(have, n - a)
        out[a : a + m] = jump[out[a - have : a - have + m]]
    c = np.frombuffer(last.encode("utf-32-le", "surrogatepass"), np.uint32)
    return c[out].tobytes().decode("utf-32-le", "surrogatepass")


def bwt_blocks(text: str, size: int = BLOCK) -> str:
    """The transforms of a text's blocks of ``size`` characters, one after the other; each has one character more than its block."""
    return "".join(bwt(text[a : a + size]) for a in range(0, max(1, len(text)), size))


def unbwt_blocks(last: str, size: int = BLOCK) -> str:
    return "".join(unbwt(last[a : a + size + 1]) for a in range(0, len(last), size + 1))
