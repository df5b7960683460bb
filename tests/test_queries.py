"""Every query with a DuckDB counterpart gives the same rows on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from fathomline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    want = sorted(tuple(map(str, r)) for r in duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert got == want and got
