"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets: every source has a weight and the wanted words are shared by weight; no source may give more than ``repeat``
times its size, and what is above that goes to the others by weight (water filling in closed form over the sources).

Blocks of equally many words then go to sources by highest quotients: of all quotients target / (2k + 1), with k from 0 below the number of
blocks that the source can give, as many as the house has seats win a block each, the greatest first. The house is the wanted words in blocks,
about ``BLOCKS`` of them at any size of the input. Seats are house-monotone: the first h quotients are the apportionment of h
blocks. So the seats in order are dealt to the shards in runs of equal length, which gives integer quotas per shard, and the first j shards
together always hold an apportionment.

Then blocks are chosen. A source's documents stand in a line in seeded order, closed to a ring that is gone round ``repeat`` times from a
seeded start, and cut into blocks. Of these, in seeded order (those of the first round first), as many as the source has seats are taken, the
k-th for the shard of its k-th seat. No word is in more than ``repeat`` blocks, so no document is taken more often.

Places in the line are prefix sums, by (source, hash range) and within it, so a source with a third of all rows is
spread over ``RANGES`` windows. Which blocks are taken is an array a source, of at most ``repeat`` / ``share`` * 2 * ``BLOCKS`` numbers altogether.

Edge cases: null text has no words and gives none; a null source is a source of its own, after all others; an empty
table gives no rows. Rows that agree in id and text are interchangeable: the multiset of results is fixed. A document
of no words is taken 0 times. Extra columns are ignored by ``plan`` and kept by ``emit``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE, REPEAT, SEED = 1.5, 2, "mix-1"
#: Blocks that all sources have together, at least, if there are words for them (and less than twice as many); hash ranges of a source.
BLOCKS, SHARDS, RANGES = 1 << 14, 16, 4096


def seeded(id_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target, words of a block, the blocks it can give, and the house. A row a source."""
    w = Window.partitionBy(F.lit(0))
    pos = F.row_number().over(w.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (pos % len(weights)) + 1)
    cap = F.col("source_size") * F.lit(float(repeat))
    s = sizes.withColumn("weight", weight).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of cap / weight: before it is the turn of a source, those before it hold their caps.
    by_fill = w.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("want", F.sum("source_size").over(w) * F.lit(float(share)))
    s = s.withColumn("rest", F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min(F.when(F.col("rest") / F.col("rest_w") <= F.col("fill"), F.struct("fill", (F.col("rest") / F.col("rest_w")).alias("level")))).over(w)["level"]
    t = s.withColumn("target", F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * level)))
    t = t.withColumn("block", F.greatest(F.lit(1), F.floor(F.col("want") / F.lit(BLOCKS))).cast("long"))
    can, house = F.floor(F.col("cap") / F.col("block")).cast("long"), F.floor(F.col("want") / F.col("block") + 0.5).cast("long")
    return t.select("source", "source_size", "weight", "target", "block", can.alias("can"), house.alias("house"))


def seats(t: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source, k, shard``: a row for each block that a source has, by highest quotients. As many rows as the house has seats, at most."""
    q = t.where(F.col("can") > 0).select("source", "house", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("can") - 1)).alias("k"))
    q = q.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    # One window over all quotients: less than 2 * repeat / share * BLOCKS of them and one a source, however large the input is.
    r = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "k"))
    q = q.withColumn("seat", r.cast("long")).where(F.col("seat") <= F.col("house"))
    return q.select("source", "k", F.floor((F.col("seat") - 1) * shards / F.col("house")).cast("int").alias("shard"))


def chosen(t: DataFrame, won: DataFrame, seed: str) -> DataFrame:
    """``source, i, shard``: the blocks of each source's ring in order, with the shard that takes them, or null."""
    b = t.where(F.col("can") > 0).select("source", F.greatest(F.lit(1).cast("long"), F.floor(F.col("source_size") / F.col("block"))).alias("round"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("can") - 1)).alias("i"))
    h = F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("")), F.lit("#"), F.col("i").cast("string")))
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.floor(F.col("i") / F.col("round")), h, "i"))
    b = b.withColumn("turn", (turn - 1).cast("long"))
    return b.alias("b").join(won.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.turn") == F.col("s.k")), "left").select("b.source", "i", "shard")


def shard_quotas(t: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``source, shard, blocks``."""
    return seats(t, shards).groupBy("source", "shard").agg(F.count("*").alias("blocks"))


def place(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, *more: Column) -> DataFrame:
    """Id, source, size and seeded key of each document."""
    text = F.col(text_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), C.n_words(text).alias("size"), seeded(id_col, seed).alias("h"), F.xxhash64(text).alias("x"), *more)
    return d.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))


def rings(sums: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """Where each range of a source begins in its line, and each source's target, start of its ring and blocks taken before each block."""
    t = C.materialize(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size"))), "mix-targets")
    base = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.select("source", "range", base.alias("base"))
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("long")
    heads = t.select("source", "source_size", "target", "block", "can", F.when(F.col("source_size") > 0, turn % F.col("source_size")).otherwise(F.lit(0).cast("long")).alias("first"))
    upto = F.sum(F.col("shard").isNotNull().cast("int")).over(Window.partitionBy("source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    got = chosen(t, seats(t), seed).select("source", "i", upto.alias("n")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("i", F.col("n").cast("int").alias("n")))).alias("z"))
    got = got.select(F.col("source").alias("s"), F.concat(F.array(F.lit(0)), F.transform("z", lambda z: z["n"])).alias("taken_before"))
    ring = heads.join(got, heads["source"].eqNullSafe(got["s"]), "left").drop("s").withColumn("taken_before", F.coalesce("taken_before", F.array(F.lit(0))))
    return at, C.materialize(ring, "mix-rings")


def words_before(x: Column) -> Column:
    """Taken words before place ``x`` of a ring that is gone round ``REPEAT`` times."""
    i = F.least(F.floor(x / F.col("block")), F.col("can")).cast("int")
    n = F.get("taken_before", i)
    return n * F.col("block") + F.coalesce(F.get("taken_before", i + 1) - n, F.lit(0)) * (x - i * F.col("block"))


def located(rows: DataFrame, sums: DataFrame, seed: str) -> DataFrame:
    """``rows`` with their source's ring, their place ``at`` on it, and ``rounds``: the words taken of them each time round."""
    at, ring = rings(sums, seed)
    w = Window.partitionBy("source", "range").orderBy("h", "id", "size", "x").rowsBetween(Window.unboundedPreceding, -1)
    d = rows.withColumn("in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    d = d.alias("d").join(at.alias("a"), F.col("d.source").eqNullSafe(F.col("a.source")) & (F.col("d.range") == F.col("a.range"))).select("d.*", "base")
    d = d.alias("d").join(ring.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))).select("d.*", *[F.col(f"r.{c}") for c in ring.columns if c != "source"])
    n, size = F.col("source_size"), F.col("size")
    d = d.withColumn("at", F.when(n > 0, F.pmod(F.col("base") + F.col("in") - F.col("first"), n)).otherwise(F.lit(0).cast("long")))

    def taken(lap: int) -> Column:
        lo = F.col("at") + lap * n
        hi = lo + size
        plain = words_before(hi) - words_before(lo)
        # What runs over the end of the last round is at the ring's beginning.
        return plain if lap < REPEAT - 1 else F.when(hi <= REPEAT * n, plain).otherwise(words_before(REPEAT * n) - words_before(lo) + words_before(hi - REPEAT * n))

    return d.withColumn("rounds", F.array(*[F.when(size > 0, taken(k)).otherwise(F.lit(0)).cast("long") for k in range(REPEAT)]))


def ranges(rows: DataFrame) -> DataFrame:
    return C.materialize(rows.groupBy("source", "range").agg(F.sum("size").alias("n")), "mix-ranges")  # at most RANGES rows a source


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """A row for each document: ``id_col, source, size, source_size, target, taken``."""
    rows = C.materialize(place(docs, id_col, text_col, source_col, seed), "mix")
    total = F.aggregate("rounds", F.lit(0).cast("long"), lambda a, x: a + x)
    return located(rows, ranges(rows), seed).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", total.alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: a row for each time that a document is taken: whole, or the words of it that lie in taken blocks."""
    names = docs.columns
    slim = place(docs, id_col, text_col, source_col, seed)
    d = located(place(docs, id_col, text_col, source_col, seed, F.struct("*").alias("row")), ranges(slim), seed)
    d = d.select("row", "size", "at", "block", "can", "source_size", "taken_before", F.posexplode("rounds").alias("lap", "n")).where(F.col("n") > 0)
    text = F.col("row")[text_col]

    def lies_in(j: Column) -> Column:
        x = F.pmod(F.col("at") + F.col("lap") * F.col("source_size") + j, REPEAT * F.col("source_size"))
        i = F.floor(x / F.col("block")).cast("int")
        return (i < F.col("can")) & (F.get("taken_before", i + 1) > F.get("taken_before", i))

    whole = F.col("n") == F.col("size")
    part = F.array_join(F.filter(C.words(text), lambda w, j: lies_in(j)), " ")
    e = d.select("row", whole.alias("whole"), F.when(whole, text).otherwise(part).alias("words"))
    col = {n: F.col("row")[n].alias(n) for n in names} | {text_col: F.col("words").cast(docs.schema[text_col].dataType).alias(text_col)}
    if "n_chars" in names:
        col["n_chars"] = F.when(F.col("whole"), F.col("row")["n_chars"]).otherwise(F.length("words")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return e.select(*[col[n] for n in names])


def query(spark, sf_dir: str) -> DataFrame:
    return plan(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
