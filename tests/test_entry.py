import duckdb
import pytest

import __spark_entry__
from strandlake import queries as kmers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).itertuples(index=False, name=None)))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["item_id", "n_kmers", "n_found"] and out.count() == 40


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(kmers.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = kmers.QUERIES[name](spark, SF).toPandas()
    if name in kmers.ORACLES:
        assert rows(got) == rows(duck.execute(kmers.ORACLES[name]).df())
    else:
        assert len(got)
