"""Every registered query against its DuckDB SQL (or rows-only) on the smallest tables."""

import pytest

from conftest import SF_SMALL
from kpiforge.plans.verify import compare, duck

import __spark_entry__ as entry

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF_SMALL, QUERIES, SQL)
    assert r["status"] in ("ok", "rows-only"), r
    assert not r.get("types"), r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["series", "rank", "label", "value"]
    assert df.count() > 0
