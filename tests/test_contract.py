"""The driver's entry points; the corpus operators may be absent."""

import datetime as dt
import decimal

import __spark_entry__ as contract
import duckdb
import pytest

from corpuslens.plans import catalog
from corpuslens.plans.registry import TABLES


def plain(x):
    """A value as text, alike for both engines: numbers to ten digits, times without zone."""
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.10g}"
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, data, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    frame = catalog.QUERIES[name](spark, data)
    assert sorted(frame.columns) == sorted(columns)
    key = lambda r: [plain(x) for x in r]
    assert sorted(map(key, frame.select(*columns).collect())) == sorted(map(key, want.fetchall()))
