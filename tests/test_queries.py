"""Every library query with SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from twincheck.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    clean = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted((tuple(map(clean, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for x, y in zip(rows(got), rows(want), strict=True):
        assert all(math.isclose(a, b, abs_tol=2e-5) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(x, y, strict=True)), (x, y)
