"""Registered queries: each name has a Spark plan and, where SQL can say it, DuckDB SQL.

The Spark side reads the driver tables through ``sources.adapters`` and runs
the library operators; the SQL side recomputes the same answer from the same
tables.  Parameters are fixed here (as_of, home country) and shared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import kpis, series, timeseries
from ..sources import adapters as A
from ..sources.adapters import with_views
from . import oracle as O

AS_OF = dt.datetime(2024, 1, 30, 12, 0, 0)
HOME = "NATION_19"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


C = O.SqlCal(AS_OF)

# ---------------------------------------------------------------- traffic --
register("daily_counts", O.daily_sql("visits", "visited_at", AS_OF))(
    lambda s, d: timeseries.daily_counts(A.visits(s, d), "visited_at", AS_OF))
register("search_timeline", O.daily_sql("search_log", "searched_at", AS_OF))(
    lambda s, d: timeseries.daily_counts(A.search_log(s, d), "searched_at", AS_OF))
register("visit_hours", O.hourly_sql("visits", "visited_at"))(
    lambda s, d: timeseries.hourly_profile(A.visits(s, d), "visited_at"))
register("visit_weekdays", O.weekday_sql("visits", "visited_at"))(
    lambda s, d: timeseries.weekday_profile(A.visits(s, d), "visited_at"))
register("visit_hours_dense", with_views(
    "SELECT CAST(h.i AS INTEGER) AS hour, coalesce(v.n, 0) AS value FROM range(24) h(i) "
    "LEFT JOIN (SELECT hour(visited_at) AS hr, count(*) AS n FROM visits WHERE visited_at IS NOT NULL "
    "GROUP BY 1) v ON v.hr = h.i", "visits"))(
    lambda s, d: timeseries.densify(s, timeseries.hourly_profile(A.visits(s, d), "visited_at"), "hour", 24))
register("search_days_dense", with_views(
    "SELECT strftime(CAST(g.d AS DATE), '%Y-%m-%d') AS label, coalesce(v.n, 0) AS value "
    "FROM generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY) g(d) LEFT JOIN "
    f"(SELECT CAST(searched_at AS DATE) AS dd, count(*) AS n FROM search_log WHERE {C.since_days('searched_at', 30)} "
    "GROUP BY 1) v ON v.dd = CAST(g.d AS DATE)", "search_log"))(
    lambda s, d: timeseries.densify_days(
        timeseries.daily_counts(A.search_log(s, d), "searched_at", AS_OF), dt.date(2023, 12, 25), dt.date(2024, 2, 5)))

VISIT_KPIS_BODY = f"""
SELECT count(*) AS total_visits,
  count(*) FILTER (WHERE {C.on_day('visited_at')}) AS today,
  count(*) FILTER (WHERE {C.on_day('visited_at', 1)}) AS yesterday,
  count(*) FILTER (WHERE {C.since_days('visited_at', 7)}) AS week,
  count(*) FILTER (WHERE {C.since_month('visited_at')}) AS month,
  count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT CASE WHEN {C.on_day('visited_at')} THEN visitor_id END) AS unique_today,
  count(DISTINCT session_key) AS sessions,
  count(*) FILTER (WHERE is_registered = 1) AS registered,
  count(*) FILTER (WHERE is_registered = 0) AS guests,
  count(DISTINCT country_code) AS countries,
  count(DISTINCT CASE WHEN country_code = '{HOME}' THEN region_name END) AS home_regions
FROM visits"""
register("visit_kpis", with_views(VISIT_KPIS_BODY, "visits"))(lambda s, d: kpis.visit_kpis(A.visits(s, d), AS_OF, HOME))

SEARCH_KPIS_BODY = f"""
SELECT count(*) AS searches, count(DISTINCT term_norm) AS unique_terms,
  count(*) FILTER (WHERE results_cnt = 0) AS zero_results,
  count(*) FILTER (WHERE {C.on_day('searched_at')}) AS searches_today
FROM search_log"""
register("search_kpis", with_views(SEARCH_KPIS_BODY, "search_log"))(lambda s, d: kpis.search_kpis(A.search_log(s, d), AS_OF))

register("top_pages", O.count_by_sql("visits", "page_path", 12))(lambda s, d: series.top_pages(A.visits(s, d)))
register("top_sections", O.count_by_sql("visits", "page_pattern", 10))(lambda s, d: series.top_sections(A.visits(s, d)))
register("home_regions", O.count_by_sql("visits", "region_name", where=f"country_code = '{HOME}'"))(
    lambda s, d: series.home_regions(A.visits(s, d), HOME))
register("home_cities", O.count_by_sql("visits", "city", 10, where=f"country_code = '{HOME}'"))(
    lambda s, d: series.home_cities(A.visits(s, d), HOME))
register("visit_countries", O.count_by_sql("visits", "country_code", 10))(
    lambda s, d: series.visit_countries(A.visits(s, d)))
register("by_device", O.count_by_sql("visits", "device_type", keep_null=True))(lambda s, d: series.by_device(A.visits(s, d)))
register("by_browser", O.count_by_sql("visits", "browser", keep_null=True))(lambda s, d: series.by_browser(A.visits(s, d)))
register("by_os", O.count_by_sql("visits", "os", keep_null=True))(lambda s, d: series.by_os(A.visits(s, d)))
register("top_terms", O.count_by_sql("search_log", "term_norm", 15))(lambda s, d: series.top_terms(A.search_log(s, d)))
register("zero_terms", O.count_by_sql("search_log", "term_norm", 10, where="results_cnt = 0"))(
    lambda s, d: series.zero_terms(A.search_log(s, d)))

# extras E23-E27
register("region_share", with_views(
    "SELECT label, value, round(value * 100.0 / (SELECT count(*) FROM visits), 2) AS pct FROM ("
    "SELECT nullif(trim(region_name), '') AS label, count(*) AS value FROM visits GROUP BY 1) q "
    "WHERE label IS NOT NULL", "visits"))(lambda s, d: series.region_share(A.visits(s, d)))
register("local_vs_foreign", with_views(
    f"SELECT CASE WHEN country_code IS NULL THEN 'unknown' WHEN country_code = '{HOME}' THEN 'local' "
    "ELSE 'foreign' END AS label, count(*) AS value FROM visits GROUP BY 1", "visits"))(
    lambda s, d: series.local_vs_foreign(A.visits(s, d), HOME))
register("cities_in_out", with_views(
    "SELECT side, label, value, rank FROM (SELECT side, label, value, CAST(row_number() OVER (PARTITION BY side "
    "ORDER BY value DESC, label ASC NULLS LAST) AS INTEGER) AS rank FROM (SELECT side, label, count(*) AS value FROM ("
    f"SELECT CASE WHEN country_code = '{HOME}' THEN 'inside' ELSE 'outside' END AS side, "
    "nullif(trim(city), '') AS label FROM visits WHERE country_code IS NOT NULL) a WHERE label IS NOT NULL "
    "GROUP BY 1, 2) b) c WHERE rank <= 10", "visits"))(lambda s, d: series.cities_in_out(A.visits(s, d), HOME))
register("unique_visitors_by_region", with_views(
    "SELECT label, count(DISTINCT visitor_id) AS value FROM (SELECT nullif(trim(region_name), '') AS label, "
    "visitor_id FROM visits) q WHERE label IS NOT NULL GROUP BY 1", "visits"))(
    lambda s, d: series.unique_visitors_by_region(A.visits(s, d)))


def _top_per_region_sql(view: str, dim: str, kind: str, k: int) -> str:
    return (f"SELECT '{kind}' AS kind, region, rank, label, value FROM (SELECT region, label, value, "
            "CAST(row_number() OVER (PARTITION BY region ORDER BY value DESC, label ASC NULLS LAST) AS INTEGER) "
            "AS rank FROM ("
            f"SELECT region_name AS region, nullif(trim({dim}), '') AS label, count(*) AS value FROM {view} "
            f"GROUP BY 1, 2) a WHERE label IS NOT NULL) b WHERE rank <= {k} AND region IS NOT NULL")


register("interest_by_region", with_views(
    _top_per_region_sql("visits", "page_path", "page", 5) + " UNION ALL "
    + _top_per_region_sql("search_log", "term_norm", "term", 5), "visits", "search_log"))(
    lambda s, d: series.interest_by_region(A.visits(s, d), A.search_log(s, d)))

# ------------------------------------------------------------------ users --
USER_KPIS_BODY = f"""
SELECT count(*) AS total_users,
  count(*) FILTER (WHERE {C.on_day('registered_at')}) AS today,
  count(*) FILTER (WHERE {C.on_day('registered_at', 1)}) AS yesterday,
  count(*) FILTER (WHERE {C.since_days('registered_at', 7)}) AS week,
  count(*) FILTER (WHERE {C.since_month('registered_at')}) AS month,
  count(*) FILTER (WHERE account_status = 'active') AS active_accounts,
  count(*) FILTER (WHERE password_hash IS NULL) AS google_users,
  count(*) FILTER (WHERE password_hash IS NOT NULL) AS local_users,
  count(*) FILTER (WHERE avatar IS NOT NULL) AS with_avatar,
  count(*) FILTER (WHERE phone IS NOT NULL) AS with_phone,
  count(*) FILTER (WHERE gender IN ('ذكر', 'Male', 'male', 'M')) AS males,
  count(*) FILTER (WHERE gender IN ('أنثى', 'Female', 'female', 'F')) AS females,
  count(DISTINCT country) AS countries_count, count(DISTINCT city) AS cities_count,
  count(DISTINCT university) AS universities_count
FROM users"""
register("user_kpis", with_views(USER_KPIS_BODY, "users"))(lambda s, d: kpis.user_kpis(A.users(s, d), AS_OF))

SESSION_KPIS_BODY = f"""
SELECT count(*) AS total_sessions,
  count(*) FILTER (WHERE is_active = 1 AND {C.after_now('expires_at')}) AS active_sessions,
  count(*) FILTER (WHERE {C.on_day('created_at')}) AS logins_today,
  count(*) FILTER (WHERE {C.since_days('created_at', 7)}) AS logins_week,
  count(*) FILTER (WHERE {C.since_month('created_at')}) AS logins_month,
  count(*) FILTER (WHERE {C.since_hours('created_at', 24)}) AS last_24h_logins,
  count(DISTINCT CASE WHEN {C.since_days('created_at', 7)} THEN user_id END) AS unique_logins_7d,
  count(DISTINCT CASE WHEN {C.since_days('created_at', 30)} THEN user_id END) AS unique_logins_30d,
  count(DISTINCT ip_address) AS distinct_ips
FROM sessions"""
register("session_kpis", with_views(SESSION_KPIS_BODY, "sessions"))(lambda s, d: kpis.session_kpis(A.sessions(s, d), AS_OF))

for _name, (_col, _keep, _n) in series.USER_SERIES.items():
    register(f"users_{_name}", O.count_by_sql("users", _col, _n, keep_null=_keep))(
        (lambda nm: lambda s, d: series.user_series(A.users(s, d), nm))(_name))

register("top_users", with_views(
    "SELECT user_id, label, value FROM (SELECT s.user_id, coalesce(u.full_name, u.username) AS label, "
    "count(s.session_id) AS value FROM sessions s JOIN users u ON s.user_id = u.id GROUP BY 1, 2) q "
    "ORDER BY value DESC, label ASC NULLS LAST, user_id LIMIT 8", "sessions", "users"))(
    lambda s, d: series.top_users(A.users(s, d), A.sessions(s, d)))
register("top_users_by_name", with_views(
    "SELECT coalesce(u.full_name, u.username) AS label, count(s.session_id) AS value FROM sessions s "
    "JOIN users u ON s.user_id = u.id GROUP BY 1 ORDER BY value DESC, label ASC NULLS LAST LIMIT 8",
    "sessions", "users"))(lambda s, d: series.top_users(A.users(s, d), A.sessions(s, d), by_name=True))

_AGE = "CAST(floor(datesub('month', birth_date, DATE '2024-01-30') / 12) AS INTEGER)"
register("age_groups", with_views(f"""
SELECT rank, label, count(*) AS value FROM (
  SELECT CASE WHEN a <= 17 THEN 1 WHEN a BETWEEN 18 AND 24 THEN 2 WHEN a BETWEEN 25 AND 34 THEN 3
              WHEN a BETWEEN 35 AND 44 THEN 4 ELSE 5 END AS rank,
         CASE WHEN a <= 17 THEN 'under 18' WHEN a BETWEEN 18 AND 24 THEN '18 - 24'
              WHEN a BETWEEN 25 AND 34 THEN '25 - 34' WHEN a BETWEEN 35 AND 44 THEN '35 - 44' ELSE '45+' END AS label
  FROM (SELECT {_AGE} AS a FROM users WHERE birth_date IS NOT NULL) x) y
GROUP BY 1, 2 ORDER BY 1""", "users"))(lambda s, d: series.age_groups(A.users(s, d), AS_OF))

register("registration_timeline", O.daily_sql("users", "registered_at", AS_OF))(
    lambda s, d: timeseries.daily_counts(A.users(s, d), "registered_at", AS_OF))
register("login_timeline", O.daily_sql("sessions", "created_at", AS_OF))(
    lambda s, d: timeseries.daily_counts(A.sessions(s, d), "created_at", AS_OF))
register("registration_hours", O.hourly_sql("users", "registered_at"))(
    lambda s, d: timeseries.hourly_profile(A.users(s, d), "registered_at"))
register("login_hours", O.hourly_sql("sessions", "created_at"))(
    lambda s, d: timeseries.hourly_profile(A.sessions(s, d), "created_at"))
register("login_weekdays", O.weekday_sql("sessions", "created_at"))(
    lambda s, d: timeseries.weekday_profile(A.sessions(s, d), "created_at"))
register("login_weekdays_dense", with_views(
    "SELECT CAST(w.i AS INTEGER) AS weekday, coalesce(v.n, 0) AS value FROM range(7) w(i) LEFT JOIN "
    "(SELECT isodow(created_at) - 1 AS wd, count(*) AS n FROM sessions WHERE created_at IS NOT NULL GROUP BY 1) v "
    "ON v.wd = w.i", "sessions"))(
    lambda s, d: timeseries.densify(s, timeseries.weekday_profile(A.sessions(s, d), "created_at"), "weekday", 7))

register("google_local_split", with_views(
    "SELECT * FROM (SELECT 'google' AS label, count(*) FILTER (WHERE password_hash IS NULL) AS value FROM users "
    "UNION ALL SELECT 'local', count(*) FILTER (WHERE password_hash IS NOT NULL) FROM users)", "users"))(
    lambda s, d: kpis.split_kpi(kpis.user_kpis(A.users(s, d), AS_OF), "google_users", "local_users", "google", "local"))
register("registered_guest_split", with_views(
    "SELECT * FROM (SELECT 'registered' AS label, count(*) FILTER (WHERE is_registered = 1) AS value FROM visits "
    "UNION ALL SELECT 'guests', count(*) FILTER (WHERE is_registered = 0) FROM visits)", "visits"))(
    lambda s, d: kpis.split_kpi(kpis.visit_kpis(A.visits(s, d), AS_OF, HOME, approx=True),
                                "registered", "guests"))
from . import catalog_more  # noqa: E402,F401  (registers part 2)
from . import catalog_dash  # noqa: E402,F401  (registers part 3)
from . import catalog_stream  # noqa: E402,F401  (registers part 4)

FLAGSHIP = "traffic_dashboard"
