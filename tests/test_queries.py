import pytest
from parity import same

from readlake.plans.oracle import SQL
from readlake.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.execute(SQL[name]))


@pytest.mark.parametrize("name", ["q_bwt", "q_archive_roundtrip"])
def test_round_trips(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(r["ok"] == 1 for r in rows)


def test_crc(spark):
    import zlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(zlib.crc32(texts[r["doc_id"]].encode()) == r["crc"] for r in QUERIES["q_crc"](spark, SF).collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
