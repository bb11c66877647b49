"""Every query with SQL gives what DuckDB gives on the same tables."""

import os
from functools import cache

import duckdb
import pytest

from rillstone.plans import code_queries, more_queries, queries  # noqa: F401
from rillstone.plans.registry import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(pdf):
    columns = sorted(pdf.columns)
    pdf = pdf[columns].astype(object)
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(str(tuple(plain(v) for v in r)) for r in pdf.where(pdf.notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_analysis():
    """The library keeps nothing between queries; the test's tables don't change, so its queries may share what they parse."""
    shared = {name: cache(getattr(code_queries, name)) for name in ("_analysis", "_code")}
    with pytest.MonkeyPatch.context() as patch:
        for module in (code_queries, more_queries):
            for name, f in shared.items():
                patch.setattr(module, name, f)
        yield


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
