"""Every registered query of the key-value part against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import catalog_ops

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog_ops.all_queries()))
def test_query(spark, duck, name):
    df = catalog_ops.all_queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = catalog_ops.all_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())
