"""Results do not depend on the session time zone (event times are wall clock, TIMESTAMP_NTZ)."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry

NAMES = ["daily_counts", "visit_hours", "visit_weekdays", "visit_kpis", "session_kpis", "open_sessions",
         "live_daily_counts", "stored_daily_counts", "campaign_list"]


def rows(spark, name):
    return sorted(map(tuple, entry.queries()[name](spark, SF_SMALL).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_in_another_time_zone(spark, name):
    utc = rows(spark, name)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        other = rows(spark, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other
