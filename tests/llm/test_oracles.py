"""Queries of the corpus operators against their SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

from lattica.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    assert columns == sorted(df.columns)
    frame = want.df()[columns]
    assert sorted(map(tuple, df.select(columns).toPandas().astype(str).values)) == sorted(map(tuple, frame.astype(str).values))
