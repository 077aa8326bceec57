"""Every query with SQL equals DuckDB on the same tables."""

import duckdb
import pytest

from findinglake.plans import catalog, console, lake, outcomes, portfolio, software

QUERIES = catalog.QUERIES | software.QUERIES | portfolio.QUERIES | lake.QUERIES | console.QUERIES | outcomes.QUERIES
ORACLE = catalog.ORACLE | software.ORACLE | portfolio.ORACLE | lake.ORACLE | console.ORACLE | outcomes.ORACLE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = _rows(df.columns, df.collect())
    cur = duck.execute(ORACLE[name])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
