"""Approximate nearest neighbours: a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE`` vectors by least hash of the id); every vector is indexed, by going down
to the nearest centre at each node. A query traverses the tree best bin first: a priority queue holds nodes by the inner
product of their centre with the query, the best is opened, and leaves come out in the order in which they are to be visited.
How many leaves are visited is calibrated: ``CALIBRATE`` rows that are no queries are answered by brute force over all vectors, and visits widen
until the share of true neighbours in visited leaves reaches ``RECALL``. A query visits more leaves as long as those hold too
few candidates.

Leaves are packed into groups of about ``GROUP`` vectors; a leaf with more is spread over groups of its own. Queries and
vectors meet by group and run of queries (``QUERIES`` of them, about), so no task's rows grow with the corpus; queries of a run are scored against a
group as matrices, with the leaves that a query doesn't visit masked out, and a group gives at most k rows a query.

How much of an index a search has to visit lies in the vectors: where they have clusters, a few leaves; where they are alike in all
directions, as many dimensions leave no near places, a share of all leaves that shrinks only slowly with their number.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components, and rows with
a null id, take no part. Repeated rows of an id are candidates each; as a query an id counts once, by its least vector. Fewer
than k candidates: all of them. Equal scores go by smaller id. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

K, EVERY = 20, 20
SAMPLE, BRANCH, LEAF, ROUNDS = 1 << 16, 64, 32, 6
CALIBRATE, RECALL, GROUP, QUERIES = 200, 0.95, 4096, 1 << 14
#: Queries that are scored against a group at once.
AT_ONCE = 256
NEAR = "query_id bigint, leaf int, vec_id bigint, score double"


class Tree:
    """Nodes by number; ``kids[n]`` is empty at a leaf, ``leaf[n]`` its number."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.centres, self.kids, self.leaf, self.n_leaves = [], [], [], 0
        self._grow(points, np.random.default_rng(seed), points.mean(0) if len(points) else None)
        self.centre_of = [self._stack(k) for k in self.kids]

    def _stack(self, kids: list[int]) -> np.ndarray | None:
        return np.stack([self.centres[k] for k in kids]) if kids else None

    def _grow(self, points: np.ndarray, rng: np.random.Generator, centre) -> int:
        me = len(self.kids)
        self.centres.append(centre)
        self.kids.append([])
        self.leaf.append(-1)
        if len(points) > LEAF:
            own = kmeans(points, min(BRANCH, len(points) // (LEAF // 2)), rng)
            label = nearest(points, own)
            parts = [(own[j], points[label == j]) for j in range(len(own))]
            parts = [(c, p) for c, p in parts if len(p)]
            if len(parts) > 1:
                self.kids[me] = [self._grow(p, rng, c) for c, p in parts]
                return me
        self.leaf[me], self.n_leaves = self.n_leaves, self.n_leaves + 1
        return me

    def assign(self, points: np.ndarray) -> np.ndarray:
        out, work = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while work:
            node, rows = work.pop()
            if not self.kids[node]:
                out[rows] = self.leaf[node]
                continue
            to = nearest(points[rows], self.centre_of[node])
            work += [(kid, rows[to == j]) for j, kid in enumerate(self.kids[node]) if (to == j).any()]
        return out

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.kids[node]:
                yield self.leaf[node]
                continue
            for score, kid in zip(self.centre_of[node] @ query, self.kids[node], strict=True):
                heapq.heappush(queue, (-score, kid))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        label = nearest(points, centres)
        centres = np.stack([points[label == j].mean(0) if (label == j).any() else centres[j] for j in range(k)])
    return centres


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("vector")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    d = d.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, ok) & F.exists(v, lambda x: x != 0))
    sizes = d.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return d.where(F.size(v) == (sizes[0]["n"] if sizes else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score and then by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def groups_of(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each leaf: consecutive leaves share a group up to ``GROUP`` vectors, larger ones have several of their own."""
    first, spans = np.zeros(len(count), np.int64), np.ones(len(count), np.int64)
    last, used = -1, GROUP
    for leaf, n in enumerate(count.tolist()):
        if n > GROUP or used + n > GROUP:
            last, used = last + 1, 0
        first[leaf], spans[leaf] = last, max(1, -(-n // GROUP))
        last, used = last + int(spans[leaf]) - 1, used + n if spans[leaf] == 1 else GROUP
    return first, spans


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow()
    if not held.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = Tree(matrix(held["vector"]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(matrix(b.column(1))), pa.int32())], names=["vec_id", "vector", "leaf"])

    idx = C.materialize(rows.select("vec_id", "vector").mapInArrow(index, "vec_id bigint, vector array<double>, leaf int"), "ann-index")
    # Dealt out by number, so that few queries are many tasks too.
    queries = idx.where(F.col("vec_id") % every == 0).repartition(C.parts(spark), "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    count = np.zeros(tree.n_leaves, np.int64)
    for r in idx.groupBy("leaf").count().collect():  # a row a leaf; the tree is bounded by its sample
        count[r["leaf"]] = r["count"]
    widest = calibrate(idx, tree, k, every)
    first, spans = groups_of(count)
    # Groups whose vectors a leaf's visit reads, and the leaves of a group: consecutive ones.
    lo = {}
    for leaf in range(tree.n_leaves):
        for g in range(first[leaf], first[leaf] + spans[leaf]):
            lo.setdefault(g, [leaf, leaf])[1] = leaf
    runs = max(1, -(-queries.count() // QUERIES))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("group", pa.int32()), ("query_id", pa.int64()), ("query", pa.list_(pa.float64())), ("visits", pa.binary())])
        for b in batches:
            out: list[list] = [[], [], [], []]
            for q, v in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                seen, found, mask = 0, 0, np.zeros(tree.n_leaves, bool)
                for leaf in tree.visits(v):
                    if seen >= widest and found > k:
                        break
                    seen, found, mask[leaf] = seen + 1, found + count[leaf], True
                line = pa.scalar(v.tolist(), pa.list_(pa.float64()))
                for g, (a, z) in lo.items():
                    if mask[a : z + 1].any():
                        for col, x in zip(out, (g, q, line, mask[a : z + 1].tobytes()), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    n, meet = C.parts(spark), ["group", "run"]
    run = F.pmod(F.xxhash64("query_id"), F.lit(runs)).cast("int")
    at = F.lit(first.tolist())[F.col("leaf")] + F.pmod(F.xxhash64("vec_id"), F.lit(spans.tolist())[F.col("leaf")]).cast("int")
    asked = queries.select("vec_id", "vector").mapInArrow(ask, "group int, query_id bigint, query array<double>, visits binary").withColumn("run", run)
    lowest = F.lit([lo[g][0] for g in range(len(lo))])[F.col("group")]
    index_ = idx.withColumn("group", at.cast("int")).withColumn("lowest", lowest).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    # Dealt out by number, so that small tables are searched by as many tasks too.
    both = asked.repartition(n, *meet).groupBy(*meet).cogroup(index_.repartition(n, *meet).groupBy(*meet))
    near = both.applyInArrow(lambda q, v: in_group(q, v, k), "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def in_group(q: pa.Table, v: pa.Table, k: int) -> pa.Table:
    """The k best of a group's vectors for each query, in the leaves that the query visits."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if q.num_rows and v.num_rows:
        leaf, ids, x = v["leaf"].to_numpy(), v["vec_id"].to_numpy(), matrix(v["vector"])
        who, y = q["query_id"].to_numpy(), matrix(q["query"])
        masks = np.frombuffer(b"".join(q["visits"].to_pylist()), bool).reshape(len(who), -1)
        lowest = v["lowest"][0].as_py()
        for a in range(0, len(who), AT_ONCE):
            s = slice(a, a + AT_ONCE)
            score = y[s] @ x.T
            score[~masks[s][:, leaf - lowest]] = -np.inf
            score[who[s][:, None] == ids[None, :]] = -np.inf
            if score.shape[1] > k:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                row, col = np.nonzero((score >= (least - 1e-9)[:, None]) & (score > -np.inf))
            else:
                row, col = np.nonzero(score > -np.inf)
            exact = np.einsum("ij,ij->i", x[col], y[s][row])  # in one order of additions, so that equal vectors have equal scores
            o = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[o], col[o], exact[o]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            ok = place < k
            out[0].append(who[s][row[ok]])
            out[1].append(ids[col[ok]])
            out[2].append(exact[ok])
    return pa.table({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})


def calibrate(idx: DataFrame, tree: Tree, k: int, every: int) -> int:
    """Leaves to visit: the fewest that hold ``RECALL`` of the true neighbours of ``CALIBRATE`` rows that are no queries, found by brute force."""
    some = idx.where(F.col("vec_id") % every != 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = some.orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATE).toArrow()
    if not asked.num_rows:
        return tree.n_leaves
    who, y = asked["vec_id"].to_numpy(), matrix(asked["vector"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            ids, leaf, score = b.column(0).to_numpy(), b.column(2).to_numpy(), matrix(b.column(1)) @ y.T
            rows = [(j, np.flatnonzero(ids != q)) for j, q in enumerate(who)]
            top = [(j, r[best(score[r, j], ids[r], k)]) for j, r in rows]
            place = np.concatenate([t for _, t in top])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(t), who[j]) for j, t in top])), pa.array(leaf[place], pa.int32()), pa.array(ids[place]), pa.array(np.concatenate([score[t, j] for j, t in top]))], names=["query_id", "leaf", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = idx.select("vec_id", "vector", "leaf").mapInArrow(scan, NEAR).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "leaf").collect()
    turn = {int(q): {leaf: n for n, leaf in enumerate(tree.visits(v))} for q, v in zip(who, y, strict=True)}
    needed = np.sort([turn[r["query_id"]][r["leaf"]] + 1 for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) if len(needed) else 1


def query(spark, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"))
