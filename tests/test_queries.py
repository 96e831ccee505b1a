"""Every registered event-log query against its DuckDB statement, and properties of those without one."""

import os

import duckdb
import pytest

from rillbase import admin_queries, surface_queries  # noqa: F401  add their queries to the registry
from rillbase import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_oracle(spark, sf, duck, name):
    df = Q.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({Q.ORACLE[name]})")
    assert sorted(duck.sql(Q.ORACLE[name]).columns) == columns
    assert ordered(df.select(*columns).collect()) == ordered(want.fetchall())


def test_batch_append_has_every_outcome(spark, sf):
    seen = {(r.status, r.err_id) for r in Q.append_fold_full(spark, sf).collect()}
    assert seen == {("success", 0), ("exists", 0), ("fail", 1001), ("fail", 1002)}
    assert {r.maybe for r in Q.QUERIES["command_filter"](spark, sf).collect()} == {True, False}


def test_no_statement_holds_without_rows():
    c = connect("/root/testdata/sf0.01")
    assert [name for name, sql in Q.ORACLE.items() if not c.sql(sql).limit(1).fetchall()] == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
