"""Day, hour and weekday series.

Day buckets use ``to_date(ts)`` after a range predicate on the raw column, so
the filter reaches the Parquet scan (row-group pruning on ``ts``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import Calendar, lit_date
from .filters import since_days


def daily_counts(df: DataFrame, ts: str, as_of, days: int = 30, day_partition: str | None = None,
                 ordered: bool = True) -> DataFrame:
    """rows per day for the last ``days`` days (no upper bound), sparse, ascending.

    With ``day_partition`` (the date column a table is partitioned by, as
    written by ``sources.sinks.append_events``) the same bound is also put on
    the partition column, so older day folders are never listed or opened.
    """
    cal = Calendar.of(as_of)
    if day_partition is not None:
        df = df.filter(F.col(day_partition) >= lit_date(cal.days_back(days - 1).date()))
    rows = since_days(df, ts, as_of, days).select(F.to_date(ts).alias("_day"))
    out = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("value"))
    if ordered:
        out = out.orderBy("_day")
    return out.select(F.date_format("_day", "yyyy-MM-dd").alias("label"), "value")


def hourly_profile(df: DataFrame, ts: str, ordered: bool = True) -> DataFrame:
    """rows per hour of day (0-23), all time; hours without rows are absent."""
    out = df.filter(F.col(ts).isNotNull()).groupBy(F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("value"))
    return out.orderBy("hour") if ordered else out


def weekday_profile(df: DataFrame, ts: str) -> DataFrame:
    """rows per weekday, Monday = 0 ... Sunday = 6."""
    out = df.filter(F.col(ts).isNotNull()).groupBy(F.weekday(ts).alias("weekday")).agg(
        F.count(F.lit(1)).alias("value"))
    return out.orderBy("weekday")


def densify(spark: SparkSession, series: DataFrame, key: str, size: int) -> DataFrame:
    """zero-fill a 0..size-1 domain (24 hours, 7 weekdays).

    The domain is ``spark.range(size)`` (a handful of rows), the series is at
    most ``size`` rows after grouping; keys outside the domain are dropped as
    the chart did.
    """
    domain = spark.range(size).select(F.col("id").cast("int").alias(key))
    return (domain.join(series, key, "left")
            .select(key, F.coalesce(F.col("value"), F.lit(0)).cast("bigint").alias("value"))
            .orderBy(key))


def densify_days(series: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """fill missing days of a 'yyyy-MM-dd' labelled series with zeros."""
    spark = series.sparkSession
    days = spark.range(1).select(
        F.explode(F.sequence(lit_date(start), lit_date(end))).alias("_d")).select(
        F.date_format("_d", "yyyy-MM-dd").alias("label"))
    return (days.join(series, "label", "left")
            .select("label", F.coalesce(F.col("value"), F.lit(0)).cast("bigint").alias("value"))
            .orderBy("label"))
