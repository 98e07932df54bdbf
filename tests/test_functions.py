"""Golden values of the scalar functions, and random round trips with fixed seeds."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from readlake.functions import bases as B
from readlake.functions import codecs, ids
from readlake.functions import quality as Q
from readlake.operators import integrity as V
from readlake.operators import reads as R
from readlake.operators import streams as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("bases,packed", [("ACTGACTG", "1b1b"), ("ACTGA", "1b00"), ("ACTGAC", "1b10"), ("ACTGACT", "1b18"), ("", "")])
def test_packed_bytes(spark, bases, packed):
    assert one(spark, B.pack_bytes("s"), s=bases) == packed


@pytest.mark.parametrize("bases,rc", [("ACTG", "CAGT"), ("ACTGACTG", "CAGTCAGT"), ("acgtN", "CACGT")])
def test_reverse_complement(spark, bases, rc):
    assert one(spark, B.revcomp("s"), s=bases) == rc


def test_codes(spark):
    assert one(spark, B.encode_bases("s"), s="ATCGNatcg") == "021330213"
    assert one(spark, B.decode_bases(B.encode_bases("s")), s="ATCGN") == "ATCGG"


def test_differences(spark):
    r = random.Random(7)
    rows = [("".join(r.choice("ACGT") for _ in range(31)), "".join(r.choice("ACGT") for _ in range(31))) for _ in range(100)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", B.hamming("a", "b").alias("h"), B.packed_hamming(B.pack("a"), B.pack("b")).alias("p"), B.diff_keep("a", "b").alias("k"), B.diff_xor("a", "b").alias("x"))
    for row in df.collect():
        want = sum(x != y for x, y in zip(row["a"], row["b"], strict=True))
        assert row["h"] == row["p"] == want
        assert row["k"] == "".join("0" if x == y else str("ACTG".index(x)) for x, y in zip(row["a"], row["b"], strict=True))
        assert row["x"] == "".join(str("ACTG".index(x) ^ "ACTG".index(y)) for x, y in zip(row["a"], row["b"], strict=True))


def test_ids(spark):
    i = "@SRR12922210.1 1/1"
    assert one(spark, ids.separators(F.col("s")), s=i) == [".", " ", "/"]
    assert one(spark, ids.tokens(F.col("s")), s=i) == ["@SRR12922210", "1", "1", "1"]


def test_affixes(spark):
    r = random.Random(3)
    rows = [(0, i, "".join(r.choice("ab") for _ in range(r.randint(0, 12)))) for i in range(300)]
    df = S.affixes(spark.createDataFrame(rows, "g int, k int, t string"), "g", "k", "t")
    back = S.restore(F.col("prev"), F.col("prefix").cast("int"), F.col("suffix").cast("int"), F.col("middle"))
    prev = ""
    for row in df.withColumn("back", back).orderBy("k").collect():
        p = 0
        while p < min(len(prev), len(row["text"])) and prev[p] == row["text"][p]:
            p += 1
        assert row["prefix"] == p and row["back"] == row["text"]
        prev = row["text"]


def test_n_round_trip(spark):
    r = random.Random(5)
    rows = [("".join(r.choice("ACGTN") for _ in range(r.randint(0, 40))),) for _ in range(100)] + [("",), ("NNNN",)]
    c = F.col("s")
    df = spark.createDataFrame(rows, "s string").select("s", R.restore_n(R.strip_n(c), R.n_places(c), F.length(c)).alias("b"))
    assert all(x["s"] == x["b"] for x in df.collect())


def test_quality():
    assert [Q.quant(i) for i in (0, 1, 2, 4, 19, 20, 40, 94, 95, 127)] == [1, 1, 2, 4, 12, 11, 21, 49, 0, 0]


def test_bwt():
    r = random.Random(1)
    for _ in range(100):
        s = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        assert codecs.unbwt(codecs.bwt(s)) == s
    assert codecs.bwt("banana") == "annb\0aa"


def test_zstd(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc" * 50)), (2, None)], "k int, d binary")
    back = codecs.decompress(codecs.compress(df, "d"), "d").orderBy("k").collect()
    assert bytes(back[0]["d"]) == b"abc" * 50 and back[1]["d"] is None


def test_damage(spark):
    df = spark.createDataFrame([(1, "a", hashlib.md5(b"a").hexdigest()), (2, "b", "x")], "k int, t string, md5 string")
    assert [r["t"] for r in V.verify(df, "t").orderBy("k").collect()] == ["a", None]
    assert V.verify(df, "t", mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="damaged"):
        V.verify(df, "t", mode="FAILFAST").collect()


def test_fingerprint():
    small, large = b"x" * 100, bytes(range(256)) * 64
    assert V.file_fingerprint(io.BytesIO(small)) == hashlib.md5(small + (100).to_bytes(8, "little")).hexdigest()[:8]
    assert V.file_fingerprint(io.BytesIO(large)) != V.file_fingerprint(io.BytesIO(large + b"?"))


@pytest.mark.parametrize("text,md5", [("", "d41d8cd98f00b204e9800998ecf8427e"), ("abc", "900150983cd24fb0d6963f7d28e17f72")])
def test_md5(spark, text, md5):
    assert one(spark, F.md5(F.col("s")), s=text) == md5
