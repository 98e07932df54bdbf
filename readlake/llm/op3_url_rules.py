"""URL filters by a sort-merge range join.

A host is turned round, label by label, into a canonical key (``www.example.net`` -> ``net.example.www.``).
A rule's host then stands for the interval of all keys with its own key as prefix, and such intervals are nested or
disjoint. One sorted sweep over interval starts, interval ends and URL keys carries the stack of active nested rules:
a start pushes its host's rules, an end restores its parent's stack, and a URL reads the stack as it stands there. The
longest rule of the stack whose path begins the URL's path decides.

The sweep runs over distinct hosts, so a host with a third of all rows is one row of it, and in chunks of key ranges;
an interval that reaches into several chunks opens anew at the start of each. All of it is windows and joins.

Edge cases: null URL or no ``://``: host and path empty, no rule, the default verdict. Empty tables give no rows.
Repeated URLs are judged each. Rules that are null or have an empty host are ignored, repeated rules count once, and
of two rules with one pattern the blocking one holds. Equal lengths: the rule with the longer host wins. Extra columns
and their names don't matter: only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return C.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = _rest(url)
    tail = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.lit(2**31 - 1))
    return F.regexp_extract(tail, r"^[^?#]*", 0)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise(F.lit(""))


def key_of(host: Column) -> Column:
    """Labels in reverse, each closed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_nodes(rules: DataFrame) -> DataFrame:
    """One row per rule host: its interval [lo, hi) and the stack of rules that are active inside it, outermost host first."""
    slash = F.instr("rule", "/")
    r = (
        rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict"))
        .where(F.col("rule").isNotNull())
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))  # block is after allow
        .select("rule", "verdict", F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")).alias("h"), F.when(slash > 0, F.substring("rule", slash, F.lit(2**31 - 1))).otherwise(F.lit("")).alias("p"))
        .where(F.col("h") != "")
        .select("rule", "verdict", "p", key_of(C.ascii_lower(F.col("h"))).alias("lo"))
    )
    own = r.groupBy("lo").agg(F.collect_list(F.struct((F.length("rule")).alias("n"), F.length("lo").alias("hn"), "rule", "verdict", "p")).alias("own"))
    # The hosts above a host are the label prefixes of its key: at most one for each of its labels.
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), r"\.", -1)
    above = own.select("lo", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("up"))
    return (
        above.join(own.select(F.col("lo").alias("up"), "own"), "up")
        .groupBy("lo")
        .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.length("up").alias("n"), "own"))), lambda x: x["own"])).alias("stack"), F.sort_array(F.collect_list("up")).alias("ups"))
        .withColumn("parent", F.when(F.size("ups") > 1, F.element_at("ups", -2)))
        .select("lo", F.expr("concat(substring(lo, 1, length(lo) - 1), '/')").alias("hi"), "stack", "parent")  # '/' follows '.'
    )


def sweep(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """``keys`` (column key, distinct) with the stack that is active at each: the sorted sweep."""
    spark = keys.sparkSession
    n = C.parts(spark)
    # One bound for each chunk, as many as there are partitions: a bounded list. Any bounds give right results.
    cut = keys.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("c")).agg(F.min("key").alias("b"))
    bounds = sorted(x["b"] for x in cut.select("b").collect())[1:]
    edges = F.lit(bounds) if bounds else F.array().cast("array<string>")
    chunk = lambda c: F.size(F.filter(edges, lambda b: b <= c))
    url = keys.select(chunk(F.col("key")).alias("chunk"), F.col("key").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("depth"), F.col("key"), F.lit(None).cast(nodes.schema["stack"].dataType).alias("stack"))
    up = nodes.select(F.col("lo").alias("parent"), F.col("stack").alias("under"))
    node = nodes.join(up, "parent", "left")
    none = F.array().cast(nodes.schema["stack"].dataType)
    spans = node.select("*", F.explode(F.sequence(chunk(F.col("lo")), chunk(F.col("hi")))).alias("chunk"))
    start = lambda: F.when(F.col("chunk") == 0, F.lit("")).otherwise(F.element_at(edges, F.greatest(F.col("chunk"), F.lit(1)))) if bounds else F.lit("")
    opens = spans.select("chunk", F.greatest(F.col("lo"), start()).alias("at"), F.lit(1).alias("kind"), F.length("lo").alias("depth"), F.lit(None).cast("string").alias("key"), "stack")
    # Ends come before starts at one place; of several ends the outermost host's is last, so its parent's stack holds.
    closes = node.select(chunk(F.col("hi")).alias("chunk"), F.col("hi").alias("at"), F.lit(0).alias("kind"), (-F.length("lo")).alias("depth"), F.lit(None).cast("string").alias("key"), F.coalesce("under", none).alias("stack"))
    w = Window.partitionBy("chunk").orderBy("at", "kind", "depth").rowsBetween(Window.unboundedPreceding, 0)
    return url.unionByName(opens).unionByName(closes).select("key", F.last("stack", ignorenulls=True).over(w).alias("stack")).where(F.col("key").isNotNull())


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """A row for each page: ``id_col, host, path, rule, verdict``."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", key_of(F.col("host")))
    stacks = sweep(rows.select("key").distinct(), rule_nodes(rules))
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["p"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["hn"], r["rule"], r["verdict"])))
    return rows.join(stacks, "key", "left").withColumn("best", best).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))
