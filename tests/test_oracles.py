"""Every query against its oracle SQL in DuckDB, at the smallest scale."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from commentlake.catalog.corpora import TABLES  # noqa: E402
from commentlake.catalog.oracles import ORACLES  # noqa: E402
from commentlake.catalog.queries import QUERIES, flagship  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 9) if isinstance(v, float) or hasattr(v, "as_integer_ratio") and not isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_flagship_runs(spark):
    assert flagship(spark, SF).count() > 0
