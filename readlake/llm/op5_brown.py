"""LM scoring by a Brown class-based bigram model.

P(w | before) = P(class(w) | class(before)) * P(w | class(w)), over words and one end mark for each text.

Classes come from exchange clustering. The ``TOP`` most frequent words are moved, one at a time, to the class where the class bigrams'
likelihood is greatest, until nothing moves (or ``ROUNDS`` times). Every other word is then placed by the classes of the top words around all its places, and
after that exchanged in ``PASSES`` passes over the whole corpus, each of which moves every such word to its best class by the classes that all
words had before the pass (a pass that moves none is the last). A sequential exchange of all words can't be spread over tasks; passes in which words
move at once can. Words that training holds once form a class of their own with the unknown word, which has the
share of it that Good-Turing counts give it. Class transitions are smoothed towards class frequencies.

Texts are read once, into blocks (``BLOCK`` bytes of text): a row with the block's distinct words (by 64-bit hash), their training counts
and all tokens as places in that list. Everything else works on blocks. Words meet by hash, which is where counts and
contexts of a word add up (a row a block, so a frequent word is pre-added), and go back to their blocks, so no vocabulary is ever
broadcast. The ``TOP`` words, which every block holds, don't meet: their counts and classes are known to all tasks. Where there are more than
``WIDE`` blocks, the rows of a word are added up by runs of blocks first, as histograms of classes. The driver holds the pair counts of
``TOP`` words (at most TOP squared) and class tables alone.

A row of ``score`` has: base_score, the log10 probability by single words with one added to each count, and score, the
model's. Edge cases: null and blank texts are an end mark alone; a null id trains; repeated rows are scored each; with nothing to
train on both scores are 0; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TOP, CLASSES, ROUNDS, BLOCK = 1024, 64, 30, 8 << 20
#: Passes over the other words; blocks whose rows of a word may meet at once.
PASSES, WIDE = 1, 4096
FOLDS, HELD = 7, 2
#: Classes: 0 the end mark, 1 words seen once and unknown ones, the others by exchange. Pseudo-count of the smoothing.
END, RARE, KAPPA = 0, 1, 50.0
END_WORD = b"\n"
#: Tables between steps are packed well, as several are there at a time.
CODEC = "zstd"
#: Bits of a word's number in its block, and of a block's in its partition.
PLACE, MADE = 26, 16
BLOCKS = "block bigint, words array<bigint>, counts array<bigint>, doc_ids array<bigint>, held array<boolean>, sizes array<int>, tokens binary"


class Numbers(dict):
    """Numbers for words in the order they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % FOLDS == HELD


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        part, made = TaskContext.get().partitionId(), 0
        kind = pa.schema([("block", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary())])
        number, ids, held, sizes, tokens, train, size = Numbers({END_WORD: 0}), [], [], [], [], [], 0

        def row() -> pa.RecordBatch:
            n = len(number)
            if made >> MADE or n >> PLACE:
                raise ValueError("too many blocks in a partition, or words in a block, for their numbers")
            words = np.fromiter(map(xxh3_64_intdigest, number), np.uint64, n).view(np.int64)
            counts = np.bincount(np.concatenate(train), minlength=n) if train else np.zeros(n, np.int64)
            one = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            return pa.RecordBatch.from_arrays([pa.array([part << MADE | made], pa.int64()), one(words, pa.int64()), one(counts, pa.int64()), one(ids, pa.int64()), one(held, pa.bool_()), one(sizes, pa.int32()), pa.array([packed(np.concatenate(tokens))], pa.binary())], schema=kind)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                w = raw.lower().split()  # of bytes: A-Z and ASCII white space alone
                w.append(END_WORD)
                t = np.fromiter(map(number.__getitem__, w), np.uint32, len(w))
                ids.append(doc)
                held.append(held_out(doc))
                sizes.append(len(w))
                tokens.append(t)
                if not held[-1]:
                    train.append(t)
                size += len(raw) + 1
                if size >= BLOCK:
                    yield row()
                    number, ids, held, sizes, tokens, train, size, made = Numbers({END_WORD: 0}), [], [], [], [], [], 0, made + 1
        if ids:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, BLOCKS)


def packed(tokens: np.ndarray) -> bytes:
    """Tokens as they are kept and shuffled: small numbers, packed by zstandard."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(tokens.astype("<u4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4")


def block_arrays(b: pa.RecordBatch, i: int, *names: str) -> list[np.ndarray]:
    out = []
    for n in names:
        v = b.column(b.schema.get_field_index(n))[i]
        out.append(unpacked(v.as_buffer()) if n == "tokens" else v.values.to_numpy(zero_copy_only=False))
    return out


def before_of(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each; before a text's first is the end mark."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = 0
    return out


def after_of(tokens: np.ndarray) -> np.ndarray:
    """The token after each; after an end mark comes none (0)."""
    out = np.zeros_like(tokens)
    out[:-1] = tokens[1:]
    out[tokens == 0] = 0
    return out


def exchange(pairs: np.ndarray, start: np.ndarray, movable: np.ndarray, free: np.ndarray, classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of words by exchange. ``pairs[a, b]``: times that b follows a. The ``movable`` words are moved in their order, to the ``free``
    classes; a word may start in a class that isn't free, where it waits for its first move."""
    c = start.copy()
    one = np.zeros((len(pairs), classes))
    one[np.arange(len(pairs)), c] = 1
    left, right = pairs.T @ one, pairs @ one  # classes before and after each word
    n = one.T @ right
    xlx = lambda x: x * np.log(np.maximum(x, 1e-300))
    self_pairs = np.diag(pairs)
    for _ in range(rounds):
        moved = 0
        for w in movable:
            a, lw, rw, s = c[w], left[w].copy(), right[w].copy(), self_pairs[w]
            n[:, a] -= lw
            n[a, :] -= rw
            n[a, a] += s
            lw[a] -= s
            rw[a] -= s
            out_n, in_n = n.sum(1), n.sum(0)
            tot_out, tot_in = rw.sum() + s, lw.sum() + s
            gain = (xlx(n[:, free] + lw[:, None]) - xlx(n[:, free])).sum(0) + (xlx(n[free] + rw) - xlx(n[free])).sum(1) - (xlx(out_n[free] + tot_out) - xlx(out_n[free])) - (xlx(in_n[free] + tot_in) - xlx(in_n[free]))
            gain += xlx(n[free, free] + s + lw[free] + rw[free]) - xlx(n[free, free] + lw[free]) - xlx(n[free, free] + rw[free]) + xlx(n[free, free])
            b = free[int(np.argmax(gain))]
            lw[b] += s
            rw[b] += s
            n[:, b] += lw
            n[b, :] += rw
            n[b, b] -= s
            if b != a:
                moved += 1
                c[w] = b
                after, prior = pairs[w], pairs[:, w]
                left[:, a] -= after  # w stands before those that follow it
                left[:, b] += after
                right[:, a] -= prior
                right[:, b] += prior
        if not moved:
            break
    return c


class Top:
    """The most frequent words: hashes in order, counts and classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, end_count: int):
        self.words, self.counts, self.end_count = words, counts, end_count
        self.classes = np.zeros(len(words), np.int64)

    def of_block(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a block's words: whether they are known here, counts, classes (the end mark is a block's first word)."""
        k = numbers_of(words, self.words)
        own = np.maximum(k - 2, 0)
        known = k != 1
        n = np.where(k > 1, self.counts[own] if len(self.words) else 0, 0)
        cls = np.where(k > 1, self.classes[own] if len(self.words) else 0, RARE)
        n[0], cls[0] = self.end_count, END
        return known, n, cls


def top_classes(held: DataFrame) -> tuple[Top, np.ndarray]:
    """The most frequent words with their classes, and the class bigrams of the corpus in these terms."""
    words = held.select(F.explode(F.arrays_zip("words", "counts")).alias("z")).select(F.col("z.words").alias("w"), F.col("z.counts").alias("n")).where(F.col("n") > 0)
    found = words.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(TOP + 1).collect()
    end = end_hash()
    top = {r["w"]: r["n"] for r in [r for r in found if r["w"] != end][:TOP]}
    rank = list(top)
    at = np.array(sorted(rank), np.int64)
    known = Top(at, np.array([top[w] for w in at.tolist()], np.int64), held.agg(F.sum(F.get("counts", F.lit(0)))).first()[0] or 0)
    size = len(at) + 2  # the end mark, then any other word, then the top words in the order of their hashes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            for i in range(len(b)):
                w, out, sizes, tokens = block_arrays(b, i, "words", "held", "sizes", "tokens")
                mine = numbers_of(w, at)
                train = ~np.repeat(out, sizes)
                pair = mine[before_of(tokens, sizes)][train] * size + mine[tokens][train]
                k, n = np.unique(pair, return_counts=True)
                keys, back = np.unique(np.concatenate([keys, k]), return_inverse=True)
                times = np.bincount(back, np.concatenate([times, n]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], names=["pair", "n"])

    got = held.select("words", "held", "sizes", "tokens").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most size squared
    pairs = np.zeros(size * size)
    pairs[got["pair"].to_numpy()] = got["n"].to_numpy()
    pairs = pairs.reshape(size, size)
    # The most frequent words have a class each at first; the others wait with the rare ones and come in by frequency.
    order = {w: k for k, w in enumerate(rank)}
    start = np.array([END, RARE] + [2 + order[w] if order[w] < CLASSES - 2 else RARE for w in at.tolist()])
    turn = np.argsort([order[w] for w in at.tolist()], kind="stable") + 2
    c = exchange(pairs, start, turn, np.arange(2, CLASSES), CLASSES) if len(at) else start
    one = np.eye(CLASSES)[c]
    known.classes = c[2:]
    return known, one.T @ pairs @ one


def end_hash() -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.array([xxh3_64_intdigest(END_WORD)], np.uint64).view(np.int64)[0])


def numbers_of(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """0 for the end mark (a block's first word), 2 + place for words in ``at``, else 1."""
    out = np.ones(len(words), np.int64)
    if len(at):
        k = np.minimum(np.searchsorted(at, words), len(at) - 1)
        out[at[k] == words] = k[at[k] == words] + 2
    out[0] = 0
    return out


ROWS = "w bigint, place bigint, ctx binary"
#: Numbers of words in a block, with their values: count over all training texts and class. Block -1: sums, see ``values_of``.
WORDS = "block bigint, once boolean, numbers array<int>, values array<bigint>"
STATS = -1


def values_of(place: np.ndarray, value: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """Words by block, those that training holds once (or never) in rows of their own; and of each distinct word (``first``) the sums: tokens of
    each class, then distinct words in training, and those with one and two tokens."""
    once = value >> 8 <= 1
    key = (place >> PLACE << 1) | once
    o = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], key[o][1:] != key[o][:-1]))) if len(o) else np.zeros(0, np.int64)
    rows = [(int(k) >> 1, bool(k & 1)) for k in key[o][edge]]
    numbers, values, ends = [(place & ((1 << PLACE) - 1))[o]], [value[o]], [*edge.tolist(), len(o)]
    for flag in (False, True):
        n, cls = value[first & (once == flag)] >> 8, value[first & (once == flag)] & 255
        sums = np.append(np.bincount(cls, n, CLASSES), [(n > 0).sum(), (n == 1).sum(), (n == 2).sum()]).astype(np.int64)
        rows.append((STATS, flag))
        numbers.append(np.arange(len(sums)))
        values.append(sums)
        ends.append(ends[-1] + len(sums))
    at = pa.array(ends, pa.int32())
    lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x).astype(t.to_pandas_dtype()), t)) for x, t in ((numbers, pa.int32()), (values, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.bool_()), *lists], names=["block", "once", "numbers", "values"])


def context_rows(block: int, words: np.ndarray, out: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, cls: np.ndarray, move: np.ndarray) -> list[pa.Array]:
    """For the words of ``move`` (a mask): hash, place, and the classes before and after (those from ``CLASSES`` on) all their places in training texts."""
    train = ~np.repeat(out, sizes) & move[tokens]
    left, right, t = cls[before_of(tokens, sizes)][train], cls[after_of(tokens)][train], tokens[train]
    o = np.argsort(t, kind="stable")
    both = np.stack([left[o], right[o] + CLASSES], 1).ravel().astype(np.uint8)
    some = np.flatnonzero(move)
    edge = np.append(np.searchsorted(t[o], some), len(o)) * 2
    ctx = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(both)])
    return [pa.array(words[some]), pa.array((block << PLACE) + some), ctx]


def places(ctx: pa.Array) -> np.ndarray:
    """How many places the contexts of each row are of."""
    return np.diff(np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1]) // 2


def first_rows(held: DataFrame, top: Top) -> DataFrame:
    """Rows of all words but the top ones, in whose contexts the top words have their classes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                w, out, sizes, tokens = block_arrays(b, i, "words", "held", "sizes", "tokens")
                known, _, cls = top.of_block(w)
                yield pa.RecordBatch.from_arrays(context_rows(b.column(0)[i].as_py(), w, out, sizes, tokens, cls, ~known), names=["w", "place", "ctx"])

    return held.select("block", "words", "held", "sizes", "tokens").mapInArrow(work, ROWS)


def next_rows(held: DataFrame, words: DataFrame, top: Top) -> tuple[DataFrame, np.ndarray]:
    """Rows of the words that training holds more than once, by the classes that all words have now; and the class bigrams of these."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["w", "place", "ctx", "pairs"]
        kind = pa.schema([("w", pa.int64()), ("place", pa.int64()), ("ctx", pa.binary()), ("pairs", pa.binary())])
        if not left.num_rows:
            return kind.empty_table()
        b = left.combine_chunks().to_batches()[0]
        w, out, sizes, tokens = block_arrays(b, 0, "words", "held", "sizes", "tokens")
        n, cls = filled(w, right, top)
        train = ~np.repeat(out, sizes)
        pairs = np.bincount(cls[before_of(tokens, sizes)][train] * CLASSES + cls[tokens][train], minlength=CLASSES * CLASSES)
        move = ~top.of_block(w)[0] & (n > 1)
        rows = context_rows(b.column(0)[0].as_py(), w, out, sizes, tokens, cls, move)
        rows = [pa.concat_arrays([r.cast(t.type), pa.array([None], t.type)]) for r, t in zip(rows, kind, strict=False)]
        return pa.table([*rows, pa.array([None] * int(move.sum()) + [pairs.astype(np.int64).tobytes()], pa.binary())], names=names)

    both = held.select("block", "words", "held", "sizes", "tokens").groupBy("block").cogroup(words.where(F.col("block") != STATS).groupBy("block"))
    rows = C.materialize(both.applyInArrow(work, ROWS + ", pairs binary"), "lm-rows", CODEC)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["pair", "n"])

    return rows, _matrix(rows.where(F.col("pairs").isNotNull()).select("pairs").mapInArrow(sparse, "pair bigint, n bigint"))


def _matrix(pairs: DataFrame) -> np.ndarray:
    got = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES squared
    out = np.zeros(CLASSES * CLASSES)
    out[got["pair"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def histograms(group: np.ndarray, ctx: pa.Array, some: slice) -> np.ndarray:
    """Counts of context classes of the groups ``some``; rows are in the order of their groups."""
    edge = np.frombuffer(ctx.buffers()[1], np.int32)[ctx.offset : ctx.offset + len(ctx) + 1]
    raw = np.frombuffer(ctx.buffers()[2], np.uint8) if ctx.buffers()[2] else np.zeros(0, np.uint8)
    a, z = np.searchsorted(group, some.start), np.searchsorted(group, some.stop)
    of = np.repeat(group[a:z] - some.start, np.diff(edge[a : z + 1]))
    return np.bincount(of * 2 * CLASSES + raw[edge[a] : edge[z]], minlength=(some.stop - some.start) * 2 * CLASSES).reshape(-1, 2 * CLASSES)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], done) -> Iterator[pa.RecordBatch]:
    """``done`` of tables of whole groups, from batches that are sorted by ``keys``."""
    late: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        late.append(b)
        if sum(map(len, late)) >= 1 << 15:
            t = pa.Table.from_batches(late)
            last = np.logical_and.reduce([t[k].to_numpy() == t[k][-1].as_py() for k in keys])
            cut = int(np.argmax(last))  # all but the last group's rows, which may go on
            if cut:
                yield done(t.slice(0, cut))
                late = t.slice(cut).combine_chunks().to_batches()
    if late:
        yield done(pa.Table.from_batches(late))


def best_classes(hist: np.ndarray, bigrams: np.ndarray) -> np.ndarray:
    """The class of each row of context counts that the class bigrams' likelihood gains most by."""
    pull, size = np.log(bigrams + 0.1), np.log(bigrams.sum(0) + 1) + np.log(bigrams.sum(1) + 1)
    fit = hist[:, :CLASSES] @ pull + hist[:, CLASSES:] @ pull.T - hist.sum(1)[:, None] / 2 * size
    return 2 + fit[:, 2:].argmax(1)


def place_words(rows: DataFrame, bigrams: np.ndarray, n_blocks: int) -> DataFrame:
    """The classes of the words of ``rows``, as ``WORDS``."""
    spark = rows.sparkSession
    rows = rows.select("w", "place", "ctx").where(F.col("w").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            w, ctx = t["w"].to_numpy(), t["ctx"].combine_chunks()
            first = np.concatenate(([True], w[1:] != w[:-1]))
            group = np.cumsum(first) - 1
            total = np.bincount(group, places(ctx)).astype(np.int64)
            cls = np.full(len(total), RARE, np.int64)
            for lo in range(0, len(total), 4096):  # a bounded table of words by contexts
                hi = min(lo + 4096, len(total))
                cls[lo:hi] = best_classes(histograms(group, ctx, slice(lo, hi)), bigrams)
            cls[total <= 1] = RARE
            return values_of(t["place"].to_numpy(), (total << 8 | cls)[group], first)

        yield from grouped(batches, ["w"], done)

    if n_blocks <= WIDE:
        return rows.repartition(C.parts(spark), "w").sortWithinPartitions("w").mapInArrow(meet, WORDS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the rows of a word in a run of blocks: counts, and (class, count) of its contexts."""

        def done(t: pa.Table) -> pa.RecordBatch:
            w, run = t["w"].to_numpy(), t["run"].to_numpy()
            first = np.concatenate(([True], (w[1:] != w[:-1]) | (run[1:] != run[:-1])))
            group = np.cumsum(first) - 1
            ctx, out = t["ctx"].combine_chunks(), []
            for lo in range(0, int(group[-1]) + 1, 4096):
                for h in histograms(group, ctx, slice(lo, min(lo + 4096, int(group[-1]) + 1))):
                    k = np.flatnonzero(h)
                    out.append(np.stack([k, h[k]]).astype(np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(np.bincount(group, places(ctx)).astype(np.int64)), pa.array(out, pa.binary())], names=["w", "n", "hist"])

        yield from grouped(batches, ["w", "run"], done)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            w, n = t["w"].to_numpy(), t["n"].to_numpy()
            first = np.concatenate(([True], w[1:] != w[:-1]))
            group = np.cumsum(first) - 1
            total, cls = np.bincount(group, n).astype(np.int64), np.full(int(group[-1]) + 1, RARE, np.int64)
            pairs = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in t["hist"].combine_chunks()]
            of = np.repeat(group, [p.shape[1] for p in pairs])
            k, m = np.concatenate(pairs, 1)
            for lo in range(0, len(total), 4096):
                hi = min(lo + 4096, len(total))
                a, z = np.searchsorted(of, lo), np.searchsorted(of, hi)
                hist = np.bincount((of[a:z] - lo) * 2 * CLASSES + k[a:z], m[a:z], (hi - lo) * 2 * CLASSES).reshape(-1, 2 * CLASSES)
                cls[lo:hi] = best_classes(hist, bigrams)
            cls[total <= 1] = RARE
            return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.array(total << 8 | cls)], names=["w", "value"])

        yield from grouped(batches, ["w"], done)

    runs = rows.withColumn("run", F.pmod(F.shiftright("place", PLACE), F.lit(-(-n_blocks // WIDE)))).repartition(C.parts(spark), "w", "run").sortWithinPartitions("w", "run")
    sums = runs.select("w", "run", "ctx").mapInArrow(part, "w bigint, n bigint, hist binary").repartition(C.parts(spark), "w").sortWithinPartitions("w").mapInArrow(whole, "w bigint, value bigint")
    sums = C.materialize(sums, "lm-values", CODEC)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).to_numpy()
            yield values_of(np.zeros(len(v), np.int64), v, np.ones(len(v), bool))

    value = F.col("value")
    d = rows.select("w", "place").join(sums, "w").select(F.shiftright("place", PLACE).alias("block"), (F.shiftright("value", 8) <= 1).alias("once"), F.struct(F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("k"), value.alias("v")).alias("z"))
    each = d.groupBy("block", "once").agg(F.collect_list("z").alias("z")).select("block", "once", F.col("z.k").alias("numbers"), F.col("z.v").alias("values"))  # a block's words
    return each.unionByName(sums.select("value").mapInArrow(stats, WORDS).where(F.col("block") == STATS))


def filled(words: np.ndarray, right: pa.Table, top: Top) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all training texts and classes of a block's words: of the top words, and of those in ``right``."""
    _, n, cls = top.of_block(words)
    if right.num_rows:
        k, value = (right[c].combine_chunks().flatten().to_numpy() for c in ("numbers", "values"))
        n[k], cls[k] = value >> 8, value & 255
    return n, cls


def join_blocks(left: pa.Table, right: pa.Table, top: Top) -> pa.Table:
    """A block with its words' counts and classes instead of their hashes."""
    if not left.num_rows:
        return pa.table({"doc_ids": pa.array([], pa.list_(pa.int64())), "held": pa.array([], pa.list_(pa.bool_())), "sizes": pa.array([], pa.list_(pa.int32())), "tokens": pa.array([], pa.binary()), "n": pa.array([], pa.binary()), "cls": pa.array([], pa.binary())})
    n, cls = filled(left["words"].combine_chunks()[0].values.to_numpy(), right, top)
    return left.select(["doc_ids", "held", "sizes", "tokens"]).append_column("n", pa.array([n.astype(np.int64).tobytes()], pa.binary())).append_column("cls", pa.array([cls.astype(np.uint8).tobytes()], pa.binary()))


def transitions(ready: DataFrame) -> np.ndarray:
    """Class bigrams of the training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for b in batches:
            for i in range(len(b)):
                out, sizes, tokens = block_arrays(b, i, "held", "sizes", "tokens")
                cls = np.frombuffer(b.column(b.schema.get_field_index("cls"))[i].as_buffer(), np.uint8).astype(np.int64)
                train = ~np.repeat(out, sizes)
                total += np.bincount(cls[before_of(tokens, sizes)][train] * CLASSES + cls[tokens][train], minlength=CLASSES * CLASSES)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["pair", "n"])

    return _matrix(ready.select("held", "sizes", "tokens", "cls").mapInArrow(count, "pair bigint, n bigint"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each document."""
    held = C.materialize(blocks(docs, id_col, text_col), "lm-blocks", CODEC)
    spark, n_blocks = docs.sparkSession, held.count()
    top, bigrams = top_classes(held)
    C.free(spark)
    # In two folders, as only the words that training holds once are needed in the end.
    path = C.new_path(spark, "lm-words")
    place_words(first_rows(held, top), bigrams, n_blocks).write.option("compression", CODEC).partitionBy("once").parquet(path)
    words = first = spark.read.schema(WORDS).parquet(path).select("block", "once", "numbers", "values")
    done = [held.scratch, path]
    C.free(spark)
    for _ in range(PASSES):
        rows, bigrams = next_rows(held, words, top)
        C.drop_scratch(spark, [f"{path}/once=false"])
        C.free(spark)
        # Words that training holds once are in no row: they stay as they are, in their class.
        anew = C.materialize(place_words(rows, bigrams, n_blocks), "lm-words", CODEC)
        C.drop_scratch(spark, [rows.scratch, *done[2:]])
        done[2:] = [anew.scratch]
        words = first.where("once").unionByName(anew)
        C.free(spark)
    got = words.where(F.col("block") == STATS).select(F.posexplode("values").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = [0] * (CLASSES + 3)
    for r in got:
        sums[r["k"]] = int(r["n"])
    per, (v, n1, n2) = dict(enumerate(sums[:CLASSES])), sums[CLASSES:]
    total = sum(per.values())
    v, total, n1, n2 = v + len(top.words) + (top.end_count > 0), total + int(top.counts.sum()) + top.end_count, n1 + int((top.counts == 1).sum()), n2 + int((top.counts == 2).sum())
    for c, n in [(END, top.end_count), *zip(top.classes.tolist(), top.counts.tolist(), strict=True)]:
        per[c] = per.get(c, 0) + n
    C.free(spark)
    sides = held.select("block", "words", "doc_ids", "held", "sizes", "tokens").groupBy("block").cogroup(words.where(F.col("block") != STATS).groupBy("block"))
    ready = C.materialize(sides.applyInArrow(lambda a, b: join_blocks(a, b, top), "doc_ids array<bigint>, held array<boolean>, sizes array<int>, tokens binary, n binary, cls binary"), "lm-ready", CODEC)
    C.drop_scratch(spark, done)
    C.free(spark)
    pairs = transitions(ready)
    share = np.zeros(CLASSES)
    for k, n in per.items():
        share[k] = n
    share[RARE] += 1 if total else 0
    lot = share / max(1.0, share.sum())
    step = np.log10(np.maximum((pairs + KAPPA * lot) / (pairs.sum(1, keepdims=True) + KAPPA), 1e-300))
    unknown = (n1 + 1) / (n1 + 2 * n2 + 2)  # of the rare class's tokens, by Good-Turing counts
    size = np.log10(np.maximum(share, 1))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                ids, out, sizes, tokens = block_arrays(b, i, "doc_ids", "held", "sizes", "tokens")
                n = np.frombuffer(b.column(b.schema.get_field_index("n"))[i].as_buffer(), np.int64)
                cls = np.frombuffer(b.column(b.schema.get_field_index("cls"))[i].as_buffer(), np.uint8).astype(np.int64)
                base = np.log10((n + 1) / (total + v + 1))
                emit = np.log10(np.maximum(n, 1)) - size[cls]
                rare = cls == RARE
                emit[rare] = np.where(n[rare] > 0, np.log10(1 - unknown) - np.log10(max(1, n1)), np.log10(unknown))
                own = step[cls[before_of(tokens, sizes)], cls[tokens]] + emit[tokens]
                edge = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                known = np.add.reduceat((n[tokens] > 0).astype(np.int64), edge)
                base_sum, own_sum = np.add.reduceat(base[tokens], edge), np.add.reduceat(own, edge)
                if not total:
                    own_sum = base_sum
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_ids"))[i].values, pa.array(out), pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base_sum), pa.array(own_sum)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ready.mapInArrow(rate, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
