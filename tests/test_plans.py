"""Plan-shape regressions: the scale properties the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as entry
from kpiforge.operators import identity, lattice

QUERIES = entry.queries()
STREAMS = {"visit_intake_stream", "search_intake_stream", "live_daily_counts", "live_subscribers"}


def plan(spark, name):
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_range_filter_reaches_the_scan(spark):
    p = plan(spark, "daily_counts")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,", p)
    assert "customer" not in p  # the unused geography join is removed


def test_stored_table_prunes_day_partitions(spark):
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(spark, "stored_daily_counts"))


def test_fold_window_is_chunked(spark):
    p = plan(spark, "subscribers")
    assert re.search(r"hashpartitioning\(email#\d+, _chunk#\d+L?, \d+\)", p)


@pytest.mark.parametrize("name, table, most", [("traffic_dashboard", "events", 6), ("users_dashboard", "events", 3), ("users_dashboard", "customer", 3),
                                               ("traffic_dashboard", "customer", 1)])
def test_dashboards_scan_each_table_a_few_times(spark, monkeypatch, name, table, most):
    """Scans of the base counts, which are written while the plan is built, and of the plan itself."""
    plans = []

    def scans(df):
        return len(re.findall(rf"FileScan parquet [^\n]*/{table}\.parquet", df._jdf.queryExecution().executedPlan().toString()))

    write = lattice.materialize
    monkeypatch.setattr(lattice, "materialize", lambda df, label: plans.append(scans(df)) or write(df, label))
    last = QUERIES[name](spark, SF_SMALL)
    assert plans and 1 <= sum(plans) + scans(last) <= most


def test_default_kpis_have_no_expand(spark):
    assert "Expand [" not in plan(spark, "visit_kpis")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cartesian_product(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    # a nested-loop join may only attach a one-row broadcast side (a scalar)
    for m in re.finditer(r"BroadcastNestedLoopJoin BuildRight, (\w+)", p):
        assert m.group(1) in ("Inner", "Cross")


SPLIT_SOON = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.mark.parametrize("name", ["account_mapping", "stitch_visitors"])
def test_hot_key_is_split(spark, name):
    """Two thirds of the rows on one key: the final plan deals them out."""
    base = spark.range(0, 300000, 1, 8)
    hot = F.when(F.col("id") % 3 < 2, F.lit("hot@example.org")).otherwise(F.col("id").cast("string"))
    rows = base.select("id", hot.alias("email"), hot.alias("visitor_id"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("user_id"),
                       F.timestamp_seconds("id").alias("visited_at"))
    before = {k: spark.conf.get(k) for k in SPLIT_SOON}
    for k, v in SPLIT_SOON.items():
        spark.conf.set(k, v)
    try:
        out = getattr(identity, name)(rows)
        assert len(out.collect()) == 300000
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
