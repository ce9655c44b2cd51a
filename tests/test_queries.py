"""Every registered query of the engine against its SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

from lattica.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(registry.queries())


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        path += "/**/*.parquet" if os.path.isdir(path) else ""
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(repr(plain(r[k])) for k in order) for r in values))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, oracle, name):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = oracle.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, cursor.fetchall())
