"""Every registered query against its SQL on DuckDB, over the whole small tables."""

import decimal
from pathlib import Path

import pytest

import __spark_entry__ as entry
from entityops.plans import catalog

duckdb = pytest.importorskip("duckdb")
SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not on this machine")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def _text(value) -> str:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return repr(value) if isinstance(value, float) else str(value)


def _sorted_rows(names, rows):
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    result = catalog.QUERIES[name](spark, SF_DIR)
    rows = result.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(result.columns) == sorted(names)
    assert _sorted_rows(result.columns, rows) == _sorted_rows(names, found.fetchall())
    assert rows, "the query should say something about the test tables"


def test_entry_point(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
