import os

import duckdb
import pytest

from rillbase.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        path = f"{sf}/{t}.parquet"
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = Q.queries()[name](spark, sf)
    columns = sorted(df.columns)
    want = duck.sql(Q.oracle_sql()[name])
    assert sorted(want.columns) == columns
    key = lambda r: tuple(map(str, r))
    rows = [tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()]
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(rows, key=key)
