"""Quality rules with risk-controlled thresholds.

Counts of each text's words, symbols, repeated lines and repeated three-word windows give features; a rule rejects a
document whose feature is above the rule's cut-off. Cut-offs come from labelled hold-outs: for each stratum (language)
the good documents that a candidate would reject are counted, and a candidate is safe if the exact binomial
distribution says so: with n good documents of which k are rejected, P(Bin(n, r) <= k) <= delta, that is, the exact upper
confidence bound of the false-rejection rate is r at most. r is the stratum's allowed rate shared over the rules, and delta
the allowed failure probability divided by the number of all tests (Bonferroni over strata, rules and candidates), so with
probability 1 - DELTA no stratum's rules reject more than RISK of its good documents. Of the safe candidates the one with the
greatest lead of bad over good documents rejected is taken, the most lenient of equals; where none is safe, or none is in the lead, the
rule is off in that stratum.

All on DataFrame functions: features are narrow, hold-out counts are one aggregation with map-side sums, and the cut-offs
(a row a stratum) are a written table whose size Spark checks before it broadcasts it.

Edge cases: null and blank texts have no words and fail the base rule. Labels without id or quality are left out; of
repeated labels of an id the worst counts. A document in a stratum without labels has the base rule alone. A null stratum is
one of its own. Repeated rows are judged each; empty tables give no rows. Extra columns are kept by ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from . import common as C

RISK, DELTA, MIN_WORDS = 0.05, 0.05, 50
FEATURES = ("symbols", "upper", "dup_lines", "repeats")
GRID = (0.02, 0.04, 0.06, 0.08, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.60, 0.70, 0.80)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts and ``_symbols, _upper, _dup_lines, _repeats`` (shares) and ``base_failed``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.withColumn("_w", C.words(text)).withColumn("n_words", F.size("_w").cast("long"))
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    d = d.withColumn("_h", F.when(F.size("_w") >= 3, windows))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(C.GAP_CHARS)) != "")
    d = d.withColumn("_l", lines)
    d = (
        d.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("_n_lines", F.size("_l"))
        .withColumn("_n_upper", (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"))
        # Windows by hash and place, if any hash is there twice; then the places whose neighbour has the same hash.
        .withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    )
    same = lambda x, k: (x["h"] == F.get("_s", k + 1)["h"]) | (x["h"] == F.get("_s", k - 1)["h"])
    at = F.transform(F.filter(F.transform("_s", lambda x, k: F.struct(x["i"].alias("i"), F.coalesce(same(x, k), F.lit(False)).alias("y"))), lambda x: x["y"]), lambda x: x["i"])
    d = d.withColumn("_p", F.sort_array(at))
    wide = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(wide, F.lit(0).cast("long"))).drop("_w", "_h", "_l", "_s", "_p")
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    return (
        d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("_symbols", share("n_symbols", "word_chars"))
        .withColumn("_upper", share("_n_upper", "word_chars"))
        .withColumn("_dup_lines", share("n_dup_lines", "_n_lines"))
        .withColumn("_repeats", share("n_repeat_words", "n_words"))
        .drop("_n_lines", "_n_upper")
    )


def most_rejected(n: Column, rate: float, delta: Column) -> Column:
    """The largest k with P(Bin(n, rate) <= k) <= delta, or -1; terms in logarithms, each from the one before."""
    odds = F.lit(rate / (1 - rate))

    def step(acc: Column, j: Column) -> Column:
        term = F.when(j == 0, n * F.log(F.lit(1 - rate))).otherwise(acc["term"] + F.log((n - j + 1) / F.greatest(j, F.lit(1)) * odds))
        hi, lo = F.greatest(acc["total"], term), F.least(acc["total"], term)
        total = hi + F.log1p(F.exp(lo - hi))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= F.log(delta), j).otherwise(acc["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("term"), F.lit(-1e300).alias("total"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n * rate), F.lit(0)).cast("long")), start, step)["k"]


def cutoffs(feats: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """A row for each stratum with labelled documents: its cut-off for each feature, null for none."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_q"))
    held = feats.where(~F.col("base_failed")).join(lab, F.col(id_col) == F.col("_id"))
    good, bad = F.col("_q") > 0, F.col("_q") <= 0
    hits = [F.sum((cls & (F.col(f"_{f}") > c)).cast("long")).alias(f"{f}_{k}_{name}") for f in FEATURES for k, c in enumerate(GRID) for cls, name in ((good, "good"), (bad, "bad"))]
    per = held.groupBy(F.col(stratum).alias("_stratum")).agg(F.sum(good.cast("long")).alias("n"), *hits)
    tests = F.count("*").over(Window.partitionBy(F.lit(0))) * len(FEATURES) * len(GRID)  # strata are few: a row each
    per = per.withColumn("most", most_rejected(F.col("n"), RISK / len(FEATURES), F.lit(DELTA) / tests))

    def cut(f: str) -> Column:
        gain = lambda k: F.col(f"{f}_{k}_bad") - F.col(f"{f}_{k}_good")
        safe = [F.when((F.col(f"{f}_{k}_good") <= F.col("most")) & (gain(k) > 0), F.struct(gain(k).alias("gain"), F.lit(c).alias("cut"))) for k, c in enumerate(GRID)]
        return F.array_max(F.array(*safe))["cut"]

    return C.materialize(per.select("_stratum", *[cut(f).alias(f"_cut_{f}") for f in FEATURES]), "cutoffs")


def verdict(feats: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    j = feats.join(cuts, feats[stratum].eqNullSafe(cuts["_stratum"]), "left")
    above = [F.coalesce(F.col(f"_{f}") > F.col(f"_cut_{f}"), F.lit(False)) for f in FEATURES]
    rejected = above[0] | above[1] | above[2] | above[3]
    return j.withColumn("kept", ~(F.col("base_failed") | rejected))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """A row for each document: id, the counts, ``base_failed`` and ``kept``."""
    feats = C.materialize(features(docs.select(id_col, text_col, stratum), text_col).drop(text_col), "quality")
    return verdict(feats, cutoffs(feats, labels, id_col, stratum), stratum).select(id_col, *COUNTS, "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns."""
    # Features are worked out once: rows and features are written together, and cut-offs and verdicts read what they need of them.
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"), F.col(stratum).alias("_lang"))
    feats = C.materialize(features(rows, "_text").drop("_text"), "quality")
    cuts = cutoffs(feats, labels, "_doc", "_lang")
    return verdict(feats, cuts, "_lang").where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
