"""Helpers that write the DuckDB oracle SQL next to each catalog query.

The SQL mirrors the Spark plan's semantics (same label cleaning, same
tie-breaks, same half-open time ranges) but is written independently in
plain SQL over the adapted views.
"""

from __future__ import annotations

import datetime as dt

from ..functions.timewin import Calendar
from ..schemas import UNSPECIFIED
from ..sources.adapters import with_views


def ts(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


class SqlCal:
    """The same calendar boundaries as ``Calendar``, rendered as SQL predicates."""

    def __init__(self, as_of):
        self.cal = Calendar.of(as_of)

    def on_day(self, col: str, offset: int = 0) -> str:
        start = self.cal.days_back(offset)
        return f"({col} >= {ts(start)} AND {col} < {ts(start + dt.timedelta(days=1))})"

    def since_days(self, col: str, n: int) -> str:
        return f"{col} >= {ts(self.cal.days_back(n - 1))}"

    def since_month(self, col: str) -> str:
        return f"{col} >= {ts(self.cal.month_start)}"

    def since_hours(self, col: str, h: int) -> str:
        return f"{col} >= {ts(self.cal.as_of - dt.timedelta(hours=h))}"

    def after_now(self, col: str) -> str:
        return f"{col} > {ts(self.cal.as_of)}"


def label_sql(dim: str, keep_null: bool) -> str:
    text = f"nullif(trim(CAST({dim} AS VARCHAR)), '')"
    return f"coalesce({text}, '{UNSPECIFIED}')" if keep_null else text


def count_by_sql(view: str, dim: str, n: int | None = None, keep_null: bool = False,
                 where: str | None = None, views: tuple[str, ...] | None = None) -> str:
    inner = f"SELECT {label_sql(dim, keep_null)} AS label FROM {view}" + (f" WHERE {where}" if where else "")
    sql = (f"SELECT label, count(*) AS value FROM ({inner}) q WHERE label IS NOT NULL GROUP BY label "
           f"ORDER BY value DESC, label ASC NULLS LAST" + (f" LIMIT {n}" if n else ""))
    return with_views(sql, *(views or (view,)))


def daily_sql(view: str, col: str, as_of, days: int = 30) -> str:
    c = SqlCal(as_of)
    return with_views(
        f"SELECT strftime(CAST({col} AS DATE), '%Y-%m-%d') AS label, count(*) AS value FROM {view} "
        f"WHERE {c.since_days(col, days)} GROUP BY 1 ORDER BY 1", view)


def hourly_sql(view: str, col: str) -> str:
    return with_views(
        f"SELECT CAST(hour({col}) AS INTEGER) AS hour, count(*) AS value FROM {view} "
        f"WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY 1", view)


def weekday_sql(view: str, col: str) -> str:
    return with_views(
        f"SELECT CAST(isodow({col}) - 1 AS INTEGER) AS weekday, count(*) AS value FROM {view} "
        f"WHERE {col} IS NOT NULL GROUP BY 1 ORDER BY 1", view)
