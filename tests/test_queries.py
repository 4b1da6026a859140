"""Every registered query with SQL agrees with it at the smallest scale; the others run."""

import duckdb
import pytest

import __spark_entry__
from tracewell.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    return round(float(value), 4) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in found.collect())
    if name in ORACLES:
        said = duck.execute(ORACLES[name])
        names = [d[0] for d in said.description]
        assert sorted(names) == columns
        assert rows == sorted(str([plain(r[names.index(c)]) for c in columns]) for r in said.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
