"""Every query with SQL gives the same rows and columns as DuckDB on the small tables."""

import duckdb
import pytest

from ethogrid import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    key = sorted(columns)
    assert sorted((tuple(r[c] for c in key) for r in rows), key=str) == sorted((tuple(dict(zip(columns, r, strict=True))[c] for c in key) for r in got.fetchall()), key=str)
