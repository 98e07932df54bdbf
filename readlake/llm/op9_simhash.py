"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Distinct fingerprints are grouped by keys
such that fingerprints to be linked share a key, and groups are compared bit-sliced: bit planes of a run of fingerprints are
stored vertically (a word holds one bit of 64 fingerprints); the planes are XORed with themselves shifted by d places, which
compares each fingerprint with the d-th after it, 64 at a time; carry-save adders count the differing bits in ones, twos, fours
..., and a word is abandoned once all its lanes have overflowed the radius. Of the pairs found only those that join two trees
of a group are kept, so a group of n gives fewer than n links.

Keys: with ``keys="blocks"`` the bits are cut into b blocks and each choice of b - radius blocks is a key; two
fingerprints that differ in at most radius bits agree in at least b - radius blocks, so no link is lost. b grows with the number
of fingerprints, so groups of chance agreement stay small. With ``keys="minhash"`` (for wider radii, where blocks would be
too short) the keys are bands of min-wise hashes of the shingles: at a similarity of 0.8, bands of 3 miss a pair in one
of 10^8 cases over 26 bands, and fewer above.

A group of more than ``BLOCK`` fingerprints is cut into blocks that are compared pair by pair of blocks, in tasks of their own.

Edge cases: null and blank texts have no shingles and the fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence is one. Copies share a fingerprint and are linked by it alone. Null ids are never a component's
id unless all of it are null. An empty table gives no rows. Extra columns aren't read by ``cluster`` and are kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .links import components

SEED, SHINGLE, RADIUS = 42, 3, 3
BLOCK = 8192
BANDS, ROWS = 26, 3
#: Members of a component whose sets are compared in one task.
VERIFY = 1024
#: Five words and a similarity of 0.8: of 256 bits as many may differ as at that similarity on average (39), and more than five
#: deviations (of 5.7) more; the links are then held against the sets themselves.
WIDE_BITS, WIDE_RADIUS, WIDE_SHINGLE, WIDE_SHARE = 256, 70, 5, 0.8


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; a shorter text is one shingle; no words, none."""
    from xxhash import xxh64_intdigest

    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space alone
    if not w:
        return np.zeros(0, np.uint64)
    line = b" ".join(w)
    if len(w) <= k:
        return np.array([xxh64_intdigest(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - k + 1
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of each hash."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """Little-endian bytes of the fingerprint; bits above 64 come from further hashes of the same shingles."""
    if not len(h):
        return bytes(bits // 8)
    out = []
    for part in range(bits // 64):
        x = h if part == 0 else mixed(h, part)
        total = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            total += np.unpackbits(x[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(np.packbits(2 * total > len(x), bitorder="little").tobytes())
    return b"".join(out)


def min_keys(h: np.ndarray) -> list[int]:
    """Bands of min-wise hashes of a set."""
    if not len(h):
        return [0]
    least = [int(mixed(h, 100 + j).min()) for j in range(BANDS * ROWS)]
    return [hash((b, *least[b * ROWS : (b + 1) * ROWS])) for b in range(BANDS)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int, keys: str) -> DataFrame:
    """``doc_id, fp`` (binary) and for minhash keys ``keys``."""
    with_keys = keys == "minhash"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ks = [], []
            for t in b.column(1):
                h = shingle_hashes(t.as_py(), shingle)
                if with_keys:  # the similarity is that of sets
                    h = np.unique(h)
                    ks.append(min_keys(h))
                fps.append(fingerprint(h, bits))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())] + [pa.array(ks, pa.list_(pa.int64()))] * with_keys, names=["doc_id", "fp"] + ["keys"] * with_keys)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, fp binary" + ", keys array<bigint>" * with_keys)


def block_count(n: int, radius: int, bits: int = 64) -> int:
    """Blocks such that keys have about as many bits as it takes to tell n fingerprints apart."""
    b = radius + 1
    while bits * (b - radius) // b < max(1, n).bit_length() - 2 and b < radius + 4:
        b += 1
    return b


def block_keys(fps: np.ndarray, radius: int, b: int) -> np.ndarray:
    """(n, keys) of 64-bit fingerprints: each choice of b - radius blocks, mixed with the number of the choice."""
    edge = [round(i * 64 / b) for i in range(b + 1)]
    mask = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(b)]
    return np.stack([mixed(fps & np.uint64(sum(mask[i] for i in c)), j) for j, c in enumerate(combinations(range(b), b - radius))], 1).view(np.int64)


def planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words) of fingerprints given as (n, bytes): word w of plane p has bit p of fingerprints 64w to 64w + 63."""
    n = len(fps)
    wide = np.zeros((fps.shape[1] * 8, -(-n // 64) * 64 + 64), np.uint8)
    wide[:, :n] = np.unpackbits(fps, axis=1, bitorder="little").T
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def shifted(p: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """Planes p moved down by d lanes, at ``words``."""
    q, r = divmod(d, 64)
    top = p.shape[1] - 1
    low = p[:, np.minimum(words + q, top)]
    if not r:
        return low
    return (low >> np.uint64(r)) | (p[:, np.minimum(words + q + 1, top)] << np.uint64(64 - r))


def close(p: np.ndarray, words: np.ndarray, live: np.ndarray, d: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and the lanes in them that may be within the radius of the lane d further on: counted carry-save, abandoned early."""
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius  # so that the counter overflows just above the radius
    count = [np.full(len(words), (2**64 - 1) * (start >> c & 1), np.uint64) for c in range(width)]
    step = 8 if width < 4 else 32
    for at in range(0, len(p), step):
        x = p[at : at + step, words] ^ shifted(p[at : at + step], words, d)
        k = 0
        while k < len(x):  # two planes at a time: a full adder into the ones, its carry on to the twos, and so on
            a, b = x[k], x[k + 1]
            half = count[0] ^ a
            carry = (count[0] & a) | (half & b)
            count[0] = half ^ b
            for c in range(1, width):
                count[c], carry = count[c] ^ carry, count[c] & carry
            live = live & ~carry
            k += 2
        some = np.flatnonzero(live)
        if not len(some):
            return words[:0], live[:0]
        if len(some) < 0.6 * len(words):
            words, live, count = words[some], live[some], [c[some] for c in count]
    some = np.flatnonzero(live)
    return words[some], live[some]


def group_links(fps: np.ndarray, end: np.ndarray, radius: int) -> np.ndarray:
    """Links (i, root) of a run of rows sorted by group; ``end[i]`` is where row i's group ends."""
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    p, as_words = planes(fps), fps.view("<u8")
    rest, most = end - np.arange(n), int((end - np.arange(n)).max())
    for d in range(1, most):
        ok = np.zeros(p.shape[1] * 64, np.uint8)
        ok[:n] = rest > d
        live = np.packbits(ok, bitorder="little").view("<u8")
        words = np.flatnonzero(live)
        words, lanes = close(p, words, live[words], d, radius)
        if not len(words):
            continue
        w, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = words[w] * 64 + bit
        i = i[np.bitwise_count(as_words[i] ^ as_words[i + d]).sum(1) <= radius]
        if not len(i):
            continue
        while True:  # trees are kept flat
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        for x in i[parent[i] != parent[i + d]].tolist():
            a, b = x, x + d
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            parent[max(a, b)] = min(a, b)
    while not ((up := parent[parent]) == parent).all():
        parent = up
    at = np.flatnonzero(parent != np.arange(n))
    return np.stack([at, parent[at]], 1)


def in_blocks(keyed: DataFrame, most: int) -> DataFrame:
    """``keyed`` (key, fp, ...) with ``lo, hi``: a key of more than ``most`` rows in blocks, each row once for each block it is to meet."""
    hot = keyed.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") / most).cast("int").alias("cuts"))
    cut = keyed.join(hot, "key", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    met = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    return met.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("cuts", "mine", "other")


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """``distinct`` (fp, keys) -> links (a, b) of fingerprints within the radius, fewer than rows for each group of a key."""
    spark = distinct.sparkSession
    task = in_blocks(distinct.select("fp", F.explode("keys").alias("key")), BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(part: pa.Table) -> pa.RecordBatch:
            at = np.stack([part["key"].to_numpy(), part["lo"].to_numpy(), part["hi"].to_numpy()])
            fps = np.frombuffer(b"".join(part["fp"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
            first = np.concatenate(([True], (at[:, 1:] != at[:, :-1]).any(0)))
            start = np.flatnonzero(first)
            size = np.diff([*start, len(first)])
            a, b = [], []
            for lo in range(1, int(size.max()).bit_length() + 1):  # groups of like size together, so that lanes are used
                g = np.flatnonzero((size >= 2) & (np.frexp(size)[1] == lo))
                if len(g):
                    s = size[g]
                    rows = np.repeat(start[g] - np.concatenate(([0], np.cumsum(s)[:-1])), s) + np.arange(s.sum())
                    got = group_links(np.ascontiguousarray(fps[rows]), np.repeat(np.cumsum(s), s), radius)
                    a += [fps[i].tobytes() for i in rows[got[:, 0]]]
                    b += [fps[i].tobytes() for i in rows[got[:, 1]]]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= 1 << 15:
                t = pa.Table.from_batches(held)
                k, lo, hi = (t[c].to_numpy() for c in ("key", "lo", "hi"))
                inner = np.flatnonzero((k != k[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
                if len(inner):  # all but the last group, which may go on
                    yield found(t.slice(0, int(inner[-1]) + 1))
                    held = t.slice(int(inner[-1]) + 1).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    return task.select("key", "lo", "hi", "fp").repartition(C.parts(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a binary, b binary")


def alike(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``share``."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return not len(large)
    if len(small) < share * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= share * (len(a) + len(b) - both)


def group_verified(fps: np.ndarray, sets: list[np.ndarray], radius: int, share: float) -> list[tuple[int, int]]:
    """Links that join trees of rows that are within the radius and have the similarity; nearest fingerprints are tried first."""
    parent, out = list(range(len(sets))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(1, len(sets)):
        far = np.bitwise_count(fps[:i] ^ fps[i]).sum(1)
        near = np.flatnonzero(far <= radius)
        for j in near[np.argsort(far[near], kind="stable")].tolist():
            if root(i) != root(j) and alike(sets[i], sets[j], share):
                parent[root(i)] = root(j)
                out.append((i, j))
    return out


def verified(docs: DataFrame, id_col: str, text_col: str, members: DataFrame, shingle: int, radius: int, share: float) -> DataFrame:
    """Links (a, b) within components (``members``: fp, least, root) that hold by the sets of shingles themselves.

    One text stands for each fingerprint. A component of more than ``VERIFY`` members is compared by pairs of blocks.
    """
    spark = docs.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["key", "fp", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fps, data = None, [], []

        def found() -> pa.RecordBatch:
            words = np.frombuffer(b"".join(fps), "<u8").reshape(len(fps), -1)
            got = group_verified(words, data, radius, share)
            return pa.RecordBatch.from_arrays([pa.array([fps[i] for i, _ in got], pa.binary()), pa.array([fps[j] for _, j in got], pa.binary())], names=["a", "b"])

        for b in batches:
            for key, lo, hi, fp, d in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (key, lo, hi) != at:
                    if fps:
                        yield found()
                    at, fps, data = (key, lo, hi), [], []
                fps.append(fp)
                data.append(np.frombuffer(d, np.uint64))
        if fps:
            yield found()

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(members, texts["_id"] == members["least"]).select(F.col("root").alias("key"), "fp", "text")
    by = ["key", "lo", "hi"]
    task = in_blocks(C.materialize(one.mapInArrow(sets, "key binary, fp binary, data binary"), "shingle-sets"), VERIFY)
    return task.select(*by, "fp", "data").repartition(C.parts(spark), *by).sortWithinPartitions(*by, "fp").mapInArrow(run, "a binary, b binary")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = 64, radius: int = RADIUS, keys: str = "blocks", share: float | None = None) -> DataFrame:
    """``doc_id, fp, component_id``: a row for each document. With ``share``, a link also takes that Jaccard similarity of shingles."""
    rows = C.materialize(fingerprints(docs, id_col, text_col, shingle, bits, keys), "fingerprints")
    by = ["fp"] + ["keys"] * (keys == "minhash")
    distinct = rows.groupBy(*by).agg(F.min("doc_id").alias("least"))
    if keys == "blocks":
        if bits != 64:
            raise ValueError("block keys are for 64 bits")
        b = block_count(rows.select(F.approx_count_distinct("fp")).first()[0], radius)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                if len(x):
                    k = block_keys(np.frombuffer(b"".join(x.column(0).to_pylist()), "<u8"), radius, b)
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), pa.array(k.ravel()))], names=["fp", "least", "keys"])

        distinct = distinct.mapInArrow(key, "fp binary, least bigint, keys array<bigint>")
    distinct = C.materialize(distinct, "distinct-fingerprints")
    tree = components(links(distinct, radius), "fingerprint-links")
    joined = distinct.groupBy("fp").agg(F.min("least").alias("least")).join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = C.materialize(joined, "fingerprint-roots")
    if share is not None:
        members = joined.join(tree.select("root").distinct(), "root")
        tree = components(verified(docs, id_col, text_col, members, shingle, radius, share), "verified-links")
        joined = C.materialize(joined.drop("root").join(tree, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "verified-roots")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp").join(joined.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str):
    """A 64-bit fingerprint as a number in hex."""
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda i: F.hex(F.substring(F.col(fp), i, F.lit(1)))), ""))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near-duplicates: that of the least id; of rows that agree in id and text, one. Rows without id stay."""
    c = cluster(docs, id_col, text_col, WIDE_SHINGLE, WIDE_BITS, WIDE_RADIUS, "minhash", WIDE_SHARE)
    heads = c.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_head")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"))
    one = rows.join(heads, F.col("id") == F.col("_head"), "left_semi").dropDuplicates(["id", "x"])
    return one.unionByName(rows.where(F.col("id").isNull())).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    c = cluster(C.table(spark, sf_dir, "documents"))
    return c.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
