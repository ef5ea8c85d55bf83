"""Every registered query against its SQL, at the smallest scale; rows-only keys must give rows."""
import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tracewell.registry import ORACLES, QUERIES
from tracewell.sources.tables import TABLES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield con
    con.close()


def norm(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return repr(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf_dir, oracle):
    df = QUERIES[key](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    got = [tuple(r) for r in df.collect()]
    if key not in ORACLES:
        assert got
        return
    cursor = oracle.execute(ORACLES[key])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert table_of(df.columns, got) == table_of(columns, cursor.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_contract(spark):
    assert QUERIES.keys() <= entry.queries().keys()
    assert all(k == "pipeline" or k.startswith("op") for k in entry.queries().keys() - QUERIES.keys())
    assert ORACLES.items() <= entry.oracle_sql().items()
    assert entry.entry(spark).columns == ["path", "depth"]
