"""Per-record and per-block operators on reads (``block_id, rec, id, bases, comment, qual``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases as B
from ..functions import ids as I
from ..functions import quality as Q

#: Longest base line of the short-read generation. Block sizes by compression level.
GEN2_MAX = 2048
LEVELS = {1: 512 << 10, 2: 2 << 20, 3: 8 << 20, 4: 16 << 20, 5: 32 << 20, 6: 64 << 20, 7: 128 << 20, 8: 256 << 20, 9: 512 << 20}
ALPHABET = "^[ACGTNactgn]*$"


def checks() -> dict[str, Column]:
    """The conditions of a valid record."""
    return {
        "header_ok": F.col("id").startswith("@"),
        "bases_ok": F.col("bases").rlike(ALPHABET) & (F.length("bases") > 0),
        "comment_ok": F.col("comment").startswith("+"),
        "length_ok": F.length("qual") == F.length("bases"),
    }


def validate(reads: DataFrame) -> DataFrame:
    c = checks()
    valid = c["header_ok"] & c["bases_ok"] & c["comment_ok"] & c["length_ok"]
    return reads.select("block_id", "rec", *[v.cast("int").alias(k) for k, v in c.items()], valid.cast("int").alias("valid"))


def generation(longest: Column) -> Column:
    return F.when(longest > GEN2_MAX, "fastq_gen3").otherwise("fastq_gen2")


def classify(reads: DataFrame) -> DataFrame:
    """The type of each block: any invalid record makes it binary."""
    valid = F.lit(True)
    for v in checks().values():
        valid = valid & v
    g = reads.groupBy("block_id").agg(F.min(valid.cast("int")).alias("ok"), F.max(F.length("bases")).cast("long").alias("max_len"), F.count("*").alias("n_rec"))
    return g.select("block_id", "n_rec", F.when(F.col("ok") == 1, generation(F.col("max_len"))).otherwise("binary").alias("block_type"))


def classify_head(head: Column) -> Column:
    """The type that a file's first bytes tell (binary column); records need ``classify``."""
    return F.when(F.hex(F.substring(head, 1, 2)) == "1F8B", "gzip").when(F.hex(F.substring(head, 1, 4)) == "42414D01", "bam").when(F.hex(F.substring(head, 1, 1)) == "40", "fastq?").otherwise("binary")


def record_bytes() -> Column:
    return (F.octet_length("id") + F.octet_length("bases") + F.octet_length("comment") + F.octet_length("qual") + 4).cast("long")


def first_separators(reads: DataFrame) -> DataFrame:
    first = reads.groupBy("block_id").agg(F.min_by("id", "rec").alias("id"))
    return first.select("block_id", F.array_join(I.separators(F.col("id")), "").alias("seps"))


def id_tokens(reads: DataFrame) -> DataFrame:
    d = reads.select("block_id", "rec", I.tokens(F.col("id")).alias("t"), I.separators(F.col("id")).alias("s"))
    p = d.select("block_id", "rec", "s", F.posexplode("t").alias("ordinal", "token"))
    return p.select("block_id", "rec", "ordinal", "token", F.coalesce(F.get("s", F.col("ordinal")), F.lit("")).alias("sep"))


def layouts(reads: DataFrame) -> DataFrame:
    """Whether all of a block's ids have the separators of the first, and its id mode."""
    seps = F.array_join(I.separators(F.col("id")), "")
    d = reads.select("block_id", "rec", seps.alias("seps"), F.array_min(F.transform(I.tokens(F.col("id")), lambda x: F.length(x))).alias("least"))
    g = d.groupBy("block_id").agg(F.min("seps").alias("a"), F.max("seps").alias("b"), F.min("least").alias("least"))
    same = F.col("a") == F.col("b")
    return g.select("block_id", same.cast("int").alias("consistent"), F.when(same & (F.col("least") > 0), "split").otherwise("all").alias("mode"))


def token_stats(reads: DataFrame) -> DataFrame:
    g = id_tokens(reads).groupBy("block_id", "ordinal")
    return g.agg(F.min(F.length("token")).cast("long").alias("min_len"), F.max(F.length("token")).cast("long").alias("max_len"), F.min_by("token", "rec").alias("first_token"))


def coder_choice(reads: DataFrame) -> DataFrame:
    varied = F.col("min_len") != F.col("max_len")
    return token_stats(reads).select("block_id", "ordinal", F.when(varied & F.col("first_token").rlike("^[0-9]*$"), "bwt").otherwise("affix").alias("coder"))


def base_stats(reads: DataFrame) -> DataFrame:
    n = F.length("bases")
    return reads.groupBy("block_id").agg(F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"), F.sum(B.n_count("bases")).alias("n_count"), F.count("*").alias("n_rec"))


def starts(reads: DataFrame) -> DataFrame:
    """Where each record's bases begin in those of its block."""
    w = Window.partitionBy("block_id").orderBy("rec").rowsBetween(Window.unboundedPreceding, -1)
    return reads.withColumn("start", F.coalesce(F.sum(F.length("bases")).over(w), F.lit(0)).cast("long"))


def n_positions(reads: DataFrame) -> DataFrame:
    d = starts(reads).where(F.col("bases").rlike("[Nn]")).select("block_id", "rec", "start", F.posexplode(F.split("bases", "")).alias("p", "c"))
    return d.where(F.col("c").isin("N", "n")).select("block_id", "rec", (F.col("start") + F.col("p")).alias("pos"))


def strip_n(c: Column) -> Column:
    return F.translate(c, "Nn", "")


def n_places(c: Column) -> Column:
    """Places of N in a line of bases, from 0."""
    return F.filter(F.transform(F.split(c, ""), lambda x, i: F.when(x.isin("N", "n"), i)), lambda x: x.isNotNull())


def restore_n(stripped: Column, places: Column, length: Column) -> Column:
    """Bases with N back at its places: the k-th place that is not an N's has the k-th stripped base."""
    at = F.transform(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))), lambda i: F.when(F.array_contains(places, i), F.lit("N")).otherwise(F.substring(stripped, i - F.size(F.filter(places, lambda p: p < i)) + 1, F.lit(1))))
    return F.when(length == 0, F.lit("")).otherwise(F.array_join(at, ""))


def length_deltas(reads: DataFrame) -> DataFrame:
    n = F.length("bases").cast("long")
    return reads.select("block_id", "rec", (n - F.min(n).over(Window.partitionBy("block_id"))).alias("delta"))


def joined(reads: DataFrame) -> DataFrame:
    """MD5 and length of each block's bases; line ends stay where lengths vary."""
    g = reads.groupBy("block_id").agg(F.sort_array(F.collect_list(F.struct("rec", "bases"))).alias("r"), F.min(F.length("bases")).alias("a"), F.max(F.length("bases")).alias("b"))
    lines = F.transform("r", lambda x: x["bases"])
    text = F.when(F.col("a") == F.col("b"), F.array_join(lines, "")).otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    return g.select("block_id", F.md5(text).alias("md5"), F.length(text).cast("long").alias("n"))


def comment_type(reads: DataFrame) -> DataFrame:
    plus, same = F.col("comment") == "+", F.expr("substring(comment, 2) = substring(id, 2)")
    g = reads.groupBy("block_id").agg(F.min(plus.cast("int")).alias("plus"), F.min(same.cast("int")).alias("same"))
    return g.select("block_id", F.when(F.col("plus") == 1, "PLUS_ONLY").when(F.col("same") == 1, "SAME_AS_ID").otherwise("OTHER").alias("comment_type"))


def quality_freq(reads: DataFrame) -> DataFrame:
    """Symbols of each block by frequency, then symbol; all weigh 1, as in the archive's table."""
    s = reads.select("block_id", F.explode(Q.symbols(F.col("qual"))).alias("sym")).groupBy("block_id", "sym").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("n"), "sym"))
    return s.select("block_id", F.col("sym").cast("int").alias("sym"), "n", rank.alias("rank"), F.lit(1).alias("weight"))


def quality_contexts(reads: DataFrame) -> DataFrame:
    """For each quality: its two predecessors quantised, the base at its place, and the mean of the line's characters before it."""
    q, b = Q.symbols(F.col("qual")), F.split("bases", "")
    d = reads.select("block_id", "rec", F.posexplode(F.arrays_zip(q.alias("q"), b.alias("b"))).alias("pos", "z"))
    d = d.select("block_id", "rec", "pos", F.col("z.q").alias("q"), F.col("z.b").alias("base")).where(F.col("q").isNotNull())
    w = Window.partitionBy("block_id", "rec").orderBy("pos")
    prev = lambda k: F.coalesce(Q.quantised(F.lag("q", k).over(w)), F.lit(Q.quant(0)))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mean = F.coalesce(F.floor(F.sum(F.col("q") + 33).over(before) / F.count("q").over(before)), F.lit(0))
    return d.select("block_id", "rec", F.col("pos").cast("int").alias("pos"), F.col("q").cast("int").alias("q"), prev(1).cast("int").alias("q1"), prev(2).cast("int").alias("q2"), "base", mean.cast("long").alias("mean"))


def preanalysis(reads: DataFrame) -> DataFrame:
    """All per-block statistics in one pass: an aggregation of narrow columns, and one of quality symbols."""
    seps = F.array_join(I.separators(F.col("id")), "")
    plus, same = F.col("comment") == "+", F.expr("substring(comment, 2) = substring(id, 2)")
    n = F.length("bases")
    g = reads.groupBy("block_id").agg(
        F.count("*").alias("n_rec"), F.min_by(seps, F.col("rec")).alias("seps"), F.min(seps).alias("_a"), F.max(seps).alias("_b"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"),
        F.sum(B.n_count("bases")).alias("n_count"), F.min(plus.cast("int")).alias("_p"), F.min(same.cast("int")).alias("_s"),
    )
    top = quality_freq(reads).groupBy("block_id").agg(F.max(F.when(F.col("rank") == 1, F.col("sym"))).alias("top_sym"), F.count("*").alias("n_syms"))
    return g.join(top, "block_id").select(
        "block_id", "n_rec", "seps", (F.col("_a") == F.col("_b")).cast("int").alias("consistent"), "min_len", "max_len", "n_count",
        F.when(F.col("_p") == 1, "PLUS_ONLY").when(F.col("_s") == 1, "SAME_AS_ID").otherwise("OTHER").alias("comment_type"), "top_sym", "n_syms",
    )
