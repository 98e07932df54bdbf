"""Minimum-cost-flow resharding.

A layout is a folder of shards, a shard a folder of files; a row lies in its file at its place. Documents belong to blocks (hashes of id and
text; a bounded number, so an id that very many rows share is in many of them), and a file holds whole blocks, or a part of one
that is larger than a file. ``reshard`` reads the sizes of the old shards and files, and solves a flow network for the
transfers that move the fewest bytes to the new shards' capacities: an arc from each old to each new shard, free where the shard stays and
one a byte where it moves. Old shards keep their first files up to what the flow keeps; the blocks after those go along the flow's arcs,
largest first. Files all of whose blocks stay are not touched; only the others are read again and written, and the manifest of the new layout names
both. ``Move`` tells the bytes that went to another shard, the fewest possible, and the bytes that were rewritten.

Only sums by block come to the driver, at most ``BLOCKS`` rows at any size of the input; files' places in their shards
are derived from counts in a window over files.

Law: ``bytes`` (shards' sizes are near equal; they differ by no more than about the largest block).

Edge cases: null text counts no bytes and has the checksum of the empty string; null ids are like any other; repeated rows
have slots of their own; an empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

OLD, NEW, BLOCKS, FILE_BYTES = 16, 24, 16384, 64 << 20
ROW_BYTES = 8
#: Files that a shard has at least, so that few rows lie in a file that stays only in part.
FILES = 4
FILE = "block int, bytes long, doc_id long, text string, pos long, shard int, file int, part int"


def _bytes(text_col: str) -> Column:
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES


def _crc(text_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def block_of(id_col: str, text_col: str, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("block")), F.lit(blocks)).cast("int")


def min_cost_flow(old: list[int], cap: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard: successive shortest paths (Bellman-Ford, as residual arcs cost less than 0)."""
    a, b = len(old), len(cap)
    s, t, n = a + b, a + b + 1, a + b + 2
    to, left, cost, at = [], [], [], [[] for _ in range(n)]

    def arc(u: int, v: int, c: int, w: int) -> None:
        for x, y, room, price in ((u, v, c, w), (v, u, 0, -w)):
            at[x].append(len(to))
            to.append(y)
            left.append(room)
            cost.append(price)

    for i, x in enumerate(old):
        arc(s, i, x, 0)
    for j, x in enumerate(cap):
        arc(a + j, t, x, 0)
    total = sum(old)
    for i in range(a):
        for j in range(b):
            arc(i, a + j, total, int(i != j))
    while True:
        far, via = [float("inf")] * n, [-1] * n
        far[s], queue = 0, [s]
        while queue:
            seen, queue = queue, []
            for u in seen:
                for e in at[u]:
                    if left[e] and far[u] + cost[e] < far[to[e]]:
                        far[to[e]], via[to[e]] = far[u] + cost[e], e
                        queue.append(to[e])
        if via[t] < 0:
            break
        path, v = [], t
        while v != s:
            path.append(via[v])
            v = to[via[v] ^ 1]
        most = min(left[e] for e in path)
        for e in path:
            left[e] -= most
            left[e ^ 1] += most
    first = 2 * (a + b)
    return {(i, j): f for i in range(a) for j in range(b) if (f := left[(first + 2 * (i * b + j)) ^ 1])}


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def assign(blocks: dict[int, int], old_of: dict[int, int], old: int = OLD, new: int = NEW, order: dict[int, int] | None = None) -> dict[int, int]:
    """The new shard of each block (by its bytes): kept, in ``order``, up to what the flow keeps; others sent along the flow's arcs, largest first."""
    sums = [0] * old
    for k, n in blocks.items():
        sums[old_of[k]] += n
    flow = min_cost_flow(sums, capacities(sum(sums), new))
    keep = [flow.get((i, i), 0) for i in range(old)]
    out, go = {}, []
    for k, n in sorted(blocks.items(), key=lambda x: ((order or {}).get(x[0], 0), x[0])):
        i = old_of[k]
        if n <= keep[i]:
            keep[i] -= n
            out[k] = i
        else:
            go.append((k, n))
    arcs = defaultdict(dict)
    for (i, j), f in flow.items():
        arcs[i][j] = keep[i] if i == j else f
    for k, n in sorted(go, key=lambda x: (-x[1], x[0])):
        mine = arcs[old_of[k]]
        j = max(mine, key=lambda j: (mine[j], -j))  # a block isn't cut: what is too much on an arc is less than a block
        mine[j] -= n
        out[k] = j
    return out


def files_of(size: dict[int, int], shard: dict[int, int], first: dict[int, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(block, shard, file, parts) in the order of blocks: files of whole blocks, or one block in several parts. ``first``: the first free file number."""
    total = defaultdict(int)
    for k, n in size.items():
        total[shard[k]] += n
    out, held = [], {}
    for k in sorted(size):
        j = shard[k]
        most = min(FILE_BYTES, max(1, -(-total[j] // FILES)))
        file, used = held.get(j, ((first or {}).get(j, 0), 0))
        if used and used + size[k] > most:
            file, used = file + 1, 0
        held[j] = file, used + size[k]
        out.append((k, j, file, max(1, -(-size[k] // FILE_BYTES))))
    return out


def sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each block (column ``block``, ``bytes``): at most ``BLOCKS`` rows."""
    return {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.sum("bytes").alias("n")).collect()}


def _put(rows: DataFrame, at: list[tuple[int, int, int, int]], path: str) -> None:
    """Write ``rows`` (block, bytes, doc_id, text) to the files of ``at``."""
    spark = rows.sparkSession
    place = C.materialize(spark.createDataFrame(at, "block int, shard int, file int, parts int"), "shard-plan")  # written: Spark sees its size
    j = rows.join(place, "block").withColumn("part", F.pmod(F.xxhash64("doc_id", "text", F.lit("part")), F.col("parts")).cast("int")).drop("parts")
    w = Window.partitionBy("shard", "file", "part").orderBy("block", "doc_id", _crc("text"))
    j.repartition(C.parts(spark), "shard", "file", "part").withColumn("pos", (F.row_number().over(w) - 1).cast("long")).write.partitionBy("shard", "file", "part").parquet(path)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = NEW) -> None:
    """A layout of ``shards`` shards, blocks dealt round: what ``reshard`` starts from."""
    d = docs.select(block_of(id_col, text_col).alias("block"), _bytes(text_col).alias("bytes"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = sizes(d)
    _put(d, files_of(size, {k: k % shards for k in size}), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE).parquet(path)


@dataclass
class Move:
    """Where the new layout is (``old`` files that stay, ``new`` ones, and the ``manifest``), and what it took."""

    old: str
    new: str
    manifest: str
    moved: int
    least: int
    rewritten: int
    total: int


def reshard(spark: SparkSession, path: str, to: str, old: int = OLD, new: int = NEW) -> Move:
    """From the layout at ``path`` to one of ``new`` shards; what changes is written under ``to``."""
    rows = _files(spark, path)
    found = rows.groupBy("block", "shard", "file").agg(F.sum("bytes").alias("bytes")).collect()  # a row a block
    size = {r["block"]: r["bytes"] for r in found}
    old_of, file_of = {r["block"]: r["shard"] for r in found}, {r["block"]: r["file"] for r in found}
    shard = assign(size, old_of, old, new, file_of)
    touched = {(old_of[k], file_of[k]) for k in size if shard[k] != old_of[k]}
    free = defaultdict(int)
    for k in size:
        free[old_of[k]] = max(free[old_of[k]], file_of[k] + 1)
    changed = {k: n for k, n in size.items() if (old_of[k], file_of[k]) in touched}
    hit = C.materialize(spark.createDataFrame(sorted(touched), "shard int, file int"), "shard-touched")
    _put(rows.join(hit, ["shard", "file"], "left_semi").select("block", "bytes", "doc_id", "text"), files_of(changed, shard, free), f"{to}/files")
    # Files by where they lie, with the rows that stand before theirs in the shard.
    count = lambda d, new_: d.groupBy("shard", "file", "part").agg(F.count("*").alias("rows")).withColumn("new", F.lit(new_))
    both = count(rows.join(hit, ["shard", "file"], "left_anti"), False).union(count(_files(spark, f"{to}/files"), True))
    before = Window.partitionBy("shard").orderBy("file", "part").rowsBetween(Window.unboundedPreceding, -1)
    both.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))).write.parquet(f"{to}/manifest")
    sums = [sum(n for k, n in size.items() if old_of[k] == i) for i in range(old)]
    stay = [min(a, b) for a, b in zip(sums, capacities(sum(sums), new), strict=False)]
    return Move(path, f"{to}/files", f"{to}/manifest", sum(n for k, n in size.items() if shard[k] != old_of[k]), sum(sums) - sum(stay), sum(changed.values()), sum(sums))


def read(spark: SparkSession, move: Move) -> DataFrame:
    """``shard, slot, doc_id, text`` of a new layout: files that stayed and files that were written, as the manifest has them."""
    m = spark.read.parquet(move.manifest)
    side = lambda path, new: _files(spark, path).join(m.where(F.col("new") == new).drop("new"), ["shard", "file", "part"])
    both = side(move.old, False).unionByName(side(move.new, True))
    return both.select("shard", (F.col("first") + F.col("pos")).alias("slot"), "doc_id", "text")


def query(spark, sf_dir: str) -> DataFrame:
    path = C.new_path(spark, "shards")
    write(C.table(spark, sf_dir, "documents"), f"{path}/old", shards=OLD)
    return digest(read(spark, reshard(spark, f"{path}/old", f"{path}/new")))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", _bytes("text").alias("size"), _crc("text").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
