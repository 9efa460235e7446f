"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from samples import SF
from docketlake.plans.catalog import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (bool, int)):
        return float(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1], "empty result"
    result = duck.execute(entry_module.oracle_sql()[name])
    assert got == _rows([c[0] for c in result.description], result.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
