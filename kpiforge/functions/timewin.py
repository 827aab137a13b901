"""Calendar boundaries relative to an explicit ``as_of``.

The source system reads the clock (SYSDATE) inside every query; here the
boundaries are computed once on the driver from ``as_of`` and enter the plan
as literals, so predicates stay sargable and are pushed to the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import lit_ts


def _as_datetime(value: dt.datetime | dt.date | str) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


@dataclass(frozen=True)
class Calendar:
    as_of: dt.datetime

    @staticmethod
    def of(as_of: dt.datetime | dt.date | str) -> "Calendar":
        return Calendar(_as_datetime(as_of))

    @property
    def today(self) -> dt.datetime:
        return dt.datetime(self.as_of.year, self.as_of.month, self.as_of.day)

    def days_back(self, n: int) -> dt.datetime:
        """Start of the day ``n`` days before today (TRUNC(now) - n)."""
        return self.today - dt.timedelta(days=n)

    @property
    def month_start(self) -> dt.datetime:
        return dt.datetime(self.as_of.year, self.as_of.month, 1)

    # --- predicates (half-open, no upper bound where the source has none) ---
    def on_day(self, ts: Column, offset: int = 0) -> Column:
        """Row falls on today - offset: a range, so Parquet statistics can prune."""
        start = self.days_back(offset)
        return (ts >= lit_ts(start)) & (ts < lit_ts(start + dt.timedelta(days=1)))

    def since_days(self, ts: Column, n: int) -> Column:
        """Last ``n`` calendar days including today: ts >= today - (n - 1)."""
        return ts >= lit_ts(self.days_back(n - 1))

    def since_month(self, ts: Column) -> Column:
        return ts >= lit_ts(self.month_start)

    def since_hours(self, ts: Column, hours: int) -> Column:
        return ts >= lit_ts(self.as_of - dt.timedelta(hours=hours))

    def after_now(self, ts: Column) -> Column:
        return ts > lit_ts(self.as_of)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
