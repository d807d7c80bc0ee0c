"""Every registered query runs, and agrees with its SQL twin where there is one (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

QUERIES, SQL = entry.queries(), entry.oracle_sql()
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else repr(x)
        return repr(x)

    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert canonical(df.columns, rows) == canonical(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
