"""Registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from siftstone import catalog

DATA = "/root/testdata/sf0.001"


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    q = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    assert rows(df.columns, got) == rows(names, q.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "flagged", "intensity"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
