"""Suffix-array dedup: bytes covered by a ``length``-byte string that also starts anywhere else go.

All places where equal strings start must meet in one suffix array, and shards of suffixes must be small. So each
window of ``length`` bytes gets a mark, the least hash of the ``gram``-byte strings in it: equal windows have equal marks. Consecutive
windows of one mark are a run, and a run's bytes its context. Runs meet by mark:

* a mark with one context that is at one place (and doesn't repeat itself) has no repeated window, and goes;
* the contexts of any other mark go to the shard of their mark, each from two of its places if it has so many, read from their texts. Windows
  whose first, middle and last ``gram`` bytes no other window of the shard has are left out, as they can't be repeated; of all others the suffix array
  is built by external induced sorting (``suffix``), with the lengths of common prefixes, and windows that share ``length`` bytes with another in
  suffix order are repeated.

Contexts of distinct symbols between them keep matches from running on. Repeated windows go back to all runs with their context, and
each text's spans are merged and cut out. Texts that are there more than once (by 128 bits of hash) are read once by each
partition, and removed whole if they are long enough.

A mark that very many different contexts share (above ``HOT``) is split by a second and third mark, from other hashes of the same
windows, so shards don't grow with the corpus; one that is large all the same is spooled, and sorted in files: in the shared folder where tasks
can open it, else where Spark spills.

Matches never cross documents; strings are judged on the input. Edge cases: null text is empty; texts shorter than ``length`` keep all;
repeated rows count as other places; an empty table gives no rows. Extra columns are not read by ``spans`` and are kept by ``cut``, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LENGTH, GRAM = 400, 32
#: Windows of a run at most; bytes of a shard, about; contexts of a mark above which it is split, and marks a window has at most.
RUN, SHARD, HOT, MARKS = 1024, 4 << 20, 1000, 3
BASE = 0x9E3779B97F4A7C15 | 1


def text_key(text: Column) -> list[Column]:
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("tkey"), F.xxhash64(F.lit("again"), t).alias("tkey2"), F.octet_length(t).cast("long").alias("n_bytes")]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on: a polynomial modulo 2^64 by prefix sums, then mixed."""
    n = len(data)
    back = pow(BASE, -1, 1 << 64)
    up, down = powers(BASE, n), powers(back, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down, out=total[1:])
    x = (total[gram:] - total[:-gram]) * up[: n - gram + 1]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


#: Powers that are kept; longer runs are worked out when needed.
KEPT_POWERS = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if n > KEPT_POWERS:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))
    if base not in _POWERS:
        _POWERS[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(KEPT_POWERS, base, np.uint64)]))
    return _POWERS[base][:n]


def sliding(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Least (or greatest) of each w values in a row, by prefix and suffix minima of blocks of w."""
    n = len(x)
    pad = -(-n // w) * w - n
    fill = np.iinfo(np.uint64).max if least is np.minimum else 0
    y = np.concatenate([x, np.full(pad, fill, np.uint64)]).reshape(-1, w)
    ahead = least.accumulate(y, 1).ravel()
    behind = least.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return least(behind[: n - w + 1], ahead[w - 1 : n])


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another order of the same strings' hashes."""
    if not k:
        return h
    x = (h ^ np.uint64((BASE * (2 * k + 1)) & (2**64 - 1))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, mark and whether the mark is there at several places, for each run of a text."""
    h = gram_hashes(data, gram)
    w = length - gram + 1
    mark = sliding(h, w)
    edge = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1])))
    size = np.diff(np.append(edge, len(mark)))
    if (size > RUN).any():
        edge = np.concatenate([np.arange(a, a + n, RUN) for a, n in zip(edge.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(edge, len(mark)))
    # Places whose hash is the mark of some window that holds them.
    wide = np.concatenate([np.zeros(w - 1, np.uint64), mark, np.zeros(w - 1, np.uint64)])
    here = h[sliding(wide, w, np.maximum) == h]
    u, n = np.unique(here, return_counts=True)
    many = u[n > 1]
    m = mark[edge]
    return edge, size, m, np.isin(m, many) if len(many) else np.zeros(len(m), bool)


RUNS = "tkey bigint, tkey2 bigint, first int, windows int, mark bigint, ctx bigint, twice int"


def runs(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """The runs of all texts; a text that a partition has seen is not read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen = set()
        names = ["tkey", "tkey2", "first", "windows", "mark", "ctx", "twice"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        for b in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for key, key2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (key, key2) in seen:
                    continue
                seen.add((key, key2))
                raw = text.as_buffer()
                data = np.frombuffer(raw, np.uint8)
                first, size, mark, twice = runs_of(data, length, gram)
                view = memoryview(raw)
                ctx = np.fromiter((xxh3_64_intdigest(view[a : a + m + length - 1]) for a, m in zip(first.tolist(), size.tolist(), strict=True)), np.uint64, len(first))
                for col, v in zip(out, (np.full(len(first), key), np.full(len(first), key2), first, size, mark.view(np.int64), ctx.view(np.int64), twice), strict=True):
                    col.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)).cast(t) for v, t in zip(out, kinds, strict=True)], names=names)

    return texts(docs, text_col, length).select("tkey", "tkey2", "text").mapInArrow(work, RUNS)


def texts(docs: DataFrame, text_col: str, length: int) -> DataFrame:
    """Texts of ``length`` bytes and more, with their keys."""
    text = F.col(text_col).cast("string")
    return docs.select(*text_key(text), F.coalesce(text, F.lit("")).alias("text")).where(F.col("n_bytes") >= length)


def contexts(all_runs: DataFrame) -> DataFrame:
    """The contexts of all marks that may have repeated windows, each once, with the places where it can be read: the first and last of its texts,
    or of its places in the one text that has it."""
    lo, hi, key, first = F.min("tkey"), F.max("tkey"), F.col("tkey"), F.col("first")
    c = all_runs.groupBy("mark", "ctx").agg(lo.alias("lo"), hi.alias("hi"), F.min_by(first, key).alias("at_lo"), F.max_by(first, key).alias("at_hi"), F.min(first).alias("a"), F.max(first).alias("z"), F.max("twice").alias("twice"), F.first("windows").alias("windows"))
    one = F.col("lo") == F.col("hi")
    c = c.select("mark", "ctx", "lo", "hi", F.when(one, F.col("a")).otherwise(F.col("at_lo")).alias("a"), F.when(one, F.col("z")).otherwise(F.col("at_hi")).alias("z"), "windows", ((~one | (F.col("a") != F.col("z"))).cast("int")).alias("more"), "twice")
    # Most marks are at one place: they go before contexts meet by mark.
    many = c.groupBy("mark").agg(F.count("*").alias("kinds"), F.max(F.greatest("more", "twice")).alias("any")).where((F.col("kinds") > 1) | (F.col("any") > 0))
    return c.drop("twice").join(many.select("mark", "kinds"), "mark")


SHARDED = "mark bigint, part bigint, ctx bigint, skip int, copy int, windows int, data binary"


def windows_of(ctx: DataFrame, docs: DataFrame, text_col: str, length: int, gram: int, hot: int) -> DataFrame:
    """(mark, ctx, a, b): the windows a to b of each context that are repeated, by the suffix arrays of the marks' shards."""
    spark = docs.sparkSession
    folder = spill_folder(spark)
    place = lambda key, first, copy: F.struct(F.col(key).alias("tkey"), F.col(first).alias("first"), F.lit(copy).alias("copy"))
    places = F.when(F.col("more") > 0, F.array(place("lo", "a", 0), place("hi", "z", 1))).otherwise(F.array(place("lo", "a", 0)))
    each = ctx.select("mark", "ctx", "windows", "kinds", F.inline(places))
    want = each.groupBy("tkey").agg(F.collect_list(F.struct("mark", "ctx", "first", "windows", "kinds", "copy")).alias("want"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        seen = set()
        kind = pa.schema([("mark", pa.int64()), ("part", pa.int64()), ("ctx", pa.int64()), ("skip", pa.int32()), ("copy", pa.int32()), ("windows", pa.int32()), ("data", pa.binary())])
        for b in batches:
            out = []
            for key, key2, t, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if (key, key2) in seen:
                    continue
                seen.add((key, key2))
                raw = t.as_buffer().to_pybytes()
                for x in wanted:
                    a, m = x["first"], x["windows"]
                    data = raw[a : a + m + length - 1]
                    if xxh3_64_intdigest(data) != x["ctx"] & (2**64 - 1):
                        continue  # another text of this key
                    for part, skip, size in pieces(data, m, x["kinds"], length, gram, hot):
                        out.append({"mark": x["mark"], "part": part, "ctx": x["ctx"], "skip": skip, "copy": x["copy"], "windows": size, "data": data[skip : skip + size + length - 1]})
                if len(out) > 20000:
                    yield pa.RecordBatch.from_pylist(out, schema=kind)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    got = texts(docs, text_col, length).drop("n_bytes").join(want, "tkey").select("tkey", "tkey2", "text", "want").mapInArrow(take, SHARDED)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shard(folder)
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if held.rows and row[:5] == held.last:
                    continue  # one place that two copies of its text brought
                if held.size >= SHARD and row[:2] != held.last[:2]:
                    yield held.repeats(length, gram)
                    held = Shard(folder)
                held.add(row)
        if held.rows:
            yield held.repeats(length, gram)

    by = ["mark", "part"]
    return got.repartition(C.parts(spark), *by).sortWithinPartitions(*by, "ctx", "skip", "copy").mapInArrow(sort, "mark bigint, ctx bigint, a int, b int").distinct()


def pieces(data: bytes, windows: int, kinds: int, length: int, gram: int, hot: int = HOT) -> Iterator[tuple[int, int, int]]:
    """A context whole, or, where its mark has very many contexts, cut into runs of windows that agree in further marks too."""
    if kinds <= hot:
        yield 0, 0, windows
        return
    h = gram_hashes(np.frombuffer(data, np.uint8), gram)
    more = [sliding(remixed(h, k), length - gram + 1) for k in range(1, MARKS)]
    key = more[0]
    for m in more[1:]:
        key = remixed(key ^ (m * np.uint64(BASE)), MARKS)
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True):
        yield int(key[a : a + 1].view(np.int64)[0]), a, b - a


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] of them), at[1], ..."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())


def anchored(data: np.ndarray, place: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Of the windows at ``place`` those that begin, go through their middle and end as another one does: only these can be repeated."""
    h = gram_hashes(data, gram)
    key = h[place]
    for k, at in enumerate(((length - gram) // 2, length - gram), 1):
        key = remixed(key, k) ^ h[place + at]
    o = np.argsort(key)
    same = key[o][1:] == key[o][:-1]
    out = np.zeros(len(place), bool)
    out[o[1:]] = same
    out[o[:-1]] |= same
    return out


class Shard:
    """Contexts whose windows are looked for among each other. Their bytes are spooled to a file above ``SPOOL`` of them."""

    def __init__(self, folder: str | None = None, spool: int = 4 * SHARD, memory: int | None = None):
        from .suffix import MEMORY

        self.folder, self.spool, self.memory = folder, spool, memory or MEMORY
        self.rows: list[tuple[int, int, int, int, int]] = []  # mark, ctx, skip, windows, bytes
        self.parts: list[bytes] = []
        self.last, self.size, self.waiting, self.file = None, 0, 0, None

    def add(self, row: tuple) -> None:
        mark, _, ctx, skip, _, windows, data = row
        self.last = row[:5]
        self.rows.append((mark, ctx, skip, windows, len(data)))
        self.parts += (data, b"\0")
        self.size += len(data) + 1
        self.waiting += len(data) + 1
        if self.folder and self.waiting > self.spool:
            self._flush()

    def _flush(self) -> None:
        self.file = self.file or tempfile.TemporaryFile(prefix="contexts-", dir=self.folder)
        self.file.writelines(self.parts)
        self.parts, self.waiting = [], 0

    def _bytes(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.parts), np.uint8)
        self._flush()
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r")

    def repeats(self, length: int, gram: int) -> pa.RecordBatch:
        """mark, ctx, a, b: the windows of the contexts that are there again."""
        from .suffix import Space

        data, space = self._bytes(), Space(self.folder, self.memory)
        size = np.array([r[4] for r in self.rows], np.int64)
        windows = np.array([r[3] for r in self.rows], np.int64)
        at = np.cumsum(size + 1) - (size + 1)
        hit = space.array(len(data), bool)
        for a, b in space.blocks(len(data)):
            hit[a:b] = False
        if len(data) <= space.memory:
            place = spread(at, windows)
            some = place[anchored(data, place, length, gram)]
            if len(some):  # pieces of such windows: those whose bytes meet are in one
                cut = np.flatnonzero(np.concatenate(([True], np.diff(some) > length)))
                last = np.append(cut[1:], len(some)) - 1
                long = some[last] - some[cut] + length
                to = np.cumsum(long + 1) - (long + 1)
                short = np.zeros(int(long.sum() + len(long)), np.uint8)
                short[spread(to, long)] = data[spread(some[cut], long)]
                moved = some + np.repeat(to - some[cut], last - cut + 1)
                starts = np.zeros(len(short), bool)
                starts[moved] = True
                hit[some] = found(short, to, long, starts, length, space)[moved]
        else:
            starts = space.array(len(data), bool)
            for a, b in space.blocks(len(data)):
                starts[a:b] = False
            for a, n in zip(at.tolist(), windows.tolist(), strict=True):
                starts[a : a + n] = True
            hit = found(data, at, size, starts, length, space)
        out: list[list[int]] = [[], [], [], []]
        for (mark, ctx, skip, n, _), a in zip(self.rows, at.tolist(), strict=True):
            x = np.diff(np.concatenate(([0], hit[a : a + n].view(np.int8), [0])))
            lo, hi = np.flatnonzero(x == 1), np.flatnonzero(x == -1)
            out[0] += [mark] * len(lo)
            out[1] += [ctx] * len(lo)
            out[2] += (lo + skip).tolist()
            out[3] += (hi + skip).tolist()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["mark", "ctx", "a", "b"])


def found(data: np.ndarray, at: np.ndarray, size: np.ndarray, starts: np.ndarray, length: int, space) -> np.ndarray:
    """True at the windows (``starts``, a mask) that are there again in ``data``: pieces at ``at`` of ``size`` bytes, and one byte after each."""
    from .suffix import repeated, suffix_array

    text = space.array(len(data), np.int32)
    for a, b in space.blocks(len(data)):
        text[a:b] = data[a:b].astype(np.int32) + len(at)
    text[at + size] = np.arange(len(at) - 1, -1, -1)  # each piece has a symbol of its own after it, least at the end
    return repeated(*suffix_array(text, length, space), starts, length, space)


def spill_folder(spark) -> str | None:
    """Where large shards are sorted: the shared folder, if tasks can open it as files; else where Spark spills, as that is a task's own; else
    nowhere (in memory)."""
    base = C.shared_dir(spark)
    if base.startswith(("file:", "/")):
        return base.removeprefix("file://").removeprefix("file:")
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``tkey, tkey2, spans`` (array of a, b; may overlap) of each text with anything to remove."""
    spark = docs.sparkSession
    all_runs = C.materialize(runs(docs, text_col, length, gram), "runs")
    ctx = C.materialize(contexts(all_runs), "contexts")
    C.free(spark)
    hit = C.materialize(windows_of(ctx, docs, text_col, length, gram, hot), "windows")
    C.free(spark)
    copies = texts(docs, text_col, length).groupBy("tkey", "tkey2").agg(F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes")).where(F.col("n") > 1)
    whole = copies.select("tkey", "tkey2", F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b"))
    part = all_runs.join(hit, ["mark", "ctx"]).select("tkey", "tkey2", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b") + length - 1).alias("b"))
    each = part.union(whole).groupBy("tkey", "tkey2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    out = C.materialize(each, "spans")
    C.free(spark)
    return out


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, many, sha = [], [], [], []
            for text, found in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                cut = merged(found)
                n.append(len(raw))
                gone.append(sum(y - x for x, y in cut))
                many.append(len(cut))
                sha.append(hashlib.sha256(kept(raw, cut)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    text = F.col(text_col).cast("string")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *text_key(text))
    return d.join(spans(docs, text_col, length, hot=hot), ["tkey", "tkey2"], "left").select("doc_id", "text", "spans").mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def kept(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    if not cut:
        return raw
    out, at = [], 0
    for a, b in cut:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def cut(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from the texts (and what is left of a character that a cut goes through); texts that
    nothing is left of go. ``n_chars``, if there is one, is counted anew."""
    names = docs.columns
    at = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, found = b.column(0), b.column(1).to_pylist()
            cols = [row.field(i) for i in range(len(names))]
            texts_ = [kept(t.as_buffer().to_pybytes(), merged(s)).decode("utf-8", "ignore") if s else t.as_py() for t, s in zip(cols[at], found, strict=True)]
            cols[at] = pa.array(texts_, pa.string())
            whole = pa.array([not s or bool(t.strip()) for t, s in zip(texts_, found, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(whole)

    text = F.col(text_col).cast("string")
    keyed = docs.select(F.struct("*").alias("row"), *text_key(text))
    out = keyed.join(spans(docs, text_col, length), ["tkey", "tkey2"], "left").select("row", "spans").mapInArrow(work, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return digest(C.table(spark, sf_dir, "documents"))
