"""Queries that SQL can express give the rows that DuckDB gives on the same tables."""

from pathlib import Path

import duckdb
import pytest

from tessera.llm import queries

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    rel = db.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, str(DATA))
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*rel.columns).collect())
