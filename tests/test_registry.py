"""Every registered query of the library proper runs; where it has SQL, DuckDB gives the same rows."""

import math

import duckdb
import pytest

from tidewater.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted((tuple(map(fix, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    if name in registry.oracle_sql():
        rel = duck.sql(registry.oracle_sql()[name])
        assert sorted(rel.columns) == cols
        assert got == plain(rel.select(*(f'"{c}"' for c in cols)).fetchall())
    else:
        assert got


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
