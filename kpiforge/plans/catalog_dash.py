"""Catalog, part 3: whole dashboards (J1-J3, A8) and the K5/K6 batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessionize
from ..session import scratch_path
from ..sources import adapters as A
from ..sources.adapters import with_views
from ..streaming import run_available
from ..streaming.sessionize import collapse_typing_stream, suppress_repeats_stream
from . import dashboards as DB
from .catalog import AS_OF, HOME, C, SEARCH_KPIS_BODY, SESSION_KPIS_BODY, USER_KPIS_BODY, VISIT_KPIS_BODY, register
from .catalog_more import _FOLD_CTES, _subs
from .oracle import label_sql

_BY_VALUE = "ORDER BY value DESC, label ASC NULLS LAST"


def _count_body(view: str, dim: str, n: int | None = None, keep_null: bool = False, where: str | None = None) -> str:
    inner = f"SELECT {label_sql(dim, keep_null)} AS label FROM {view}" + (f" WHERE {where}" if where else "")
    return (f"SELECT label, count(*) AS value FROM ({inner}) q WHERE label IS NOT NULL GROUP BY label {_BY_VALUE}"
            + (f" LIMIT {n}" if n else ""))


def _by_value(name: str, body: str) -> str:
    return (f"SELECT '{name}' AS series, CAST(row_number() OVER ({_BY_VALUE}) AS INTEGER) AS rank, label, "
            f"CAST(value AS BIGINT) AS value FROM ({body}) b")


def _by_key(name: str, body: str) -> str:
    """``body`` yields (k, label, value); rank follows k ascending."""
    return (f"SELECT '{name}' AS series, CAST(row_number() OVER (ORDER BY k, label) AS INTEGER) AS rank, label, "
            f"CAST(value AS BIGINT) AS value FROM ({body}) b")


def _daily(view: str, col: str) -> str:
    return (f"SELECT CAST(CAST({col} AS DATE) - DATE '1970-01-01' AS BIGINT) AS k, "
            f"strftime(CAST({col} AS DATE), '%Y-%m-%d') AS label, count(*) AS value FROM {view} "
            f"WHERE {C.since_days(col, 30)} GROUP BY 1, 2")


def _hours(view: str, col: str) -> str:
    return (f"SELECT hour({col}) AS k, CAST(hour({col}) AS VARCHAR) AS label, count(*) AS value FROM {view} "
            f"WHERE {col} IS NOT NULL GROUP BY 1, 2")


def _weekdays(view: str, col: str) -> str:
    return (f"SELECT isodow({col}) - 1 AS k, CAST(isodow({col}) - 1 AS VARCHAR) AS label, count(*) AS value "
            f"FROM {view} WHERE {col} IS NOT NULL GROUP BY 1, 2")


def _kpis(body: str, names: list[str], offset: int = 0) -> str:
    lists = ", ".join(f"unnest([{', '.join(repr(n) for n in names)}]) AS label" for _ in [0])
    vals = f"unnest([{', '.join(f'CAST({n} AS BIGINT)' for n in names)}]) AS value"
    ks = f"unnest(range({offset}, {offset + len(names)})) AS k"
    return _by_key("kpis", f"SELECT {ks}, {lists}, {vals} FROM ({body}) kp")


VISIT_KPI_NAMES = ["total_visits", "today", "yesterday", "week", "month", "unique_visitors", "unique_today",
                   "sessions", "registered", "guests", "countries", "home_regions"]
SEARCH_KPI_NAMES = ["searches", "unique_terms", "zero_results", "searches_today"]
USER_KPI_NAMES = ["total_users", "today", "yesterday", "week", "month", "active_accounts", "google_users",
                  "local_users", "with_avatar", "with_phone", "males", "females", "countries_count", "cities_count",
                  "universities_count"]
SESSION_KPI_NAMES = ["total_sessions", "active_sessions", "logins_today", "logins_week", "logins_month",
                     "last_24h_logins", "unique_logins_7d", "unique_logins_30d", "distinct_ips"]


def _kpis_two(a_body, a_names, b_body, b_names) -> str:
    """KPI rows of two one-row aggregates, numbered continuously."""
    a = f"SELECT {', '.join(a_names)} FROM ({a_body}) x"
    b = f"SELECT {', '.join(b_names)} FROM ({b_body}) y"
    names = a_names + b_names
    dup = {n for n in a_names if n in b_names}
    assert not dup, dup
    return _kpis(f"SELECT * FROM ({a}) p, ({b}) q", names)


TRAFFIC_BODY = " UNION ALL ".join([
    _kpis_two(VISIT_KPIS_BODY, VISIT_KPI_NAMES, SEARCH_KPIS_BODY, SEARCH_KPI_NAMES),
    _by_key("visits_timeline", _daily("visits", "visited_at")),
    _by_value("top_pages", _count_body("visits", "page_path", 12)),
    _by_value("top_sections", _count_body("visits", "page_pattern", 10)),
    _by_value("home_regions", _count_body("visits", "region_name", where=f"country_code = '{HOME}'")),
    _by_value("home_cities", _count_body("visits", "city", 10, where=f"country_code = '{HOME}'")),
    _by_value("by_country", _count_body("visits", "country_code", 10)),
    _by_value("by_device", _count_body("visits", "device_type", keep_null=True)),
    _by_value("by_browser", _count_body("visits", "browser", keep_null=True)),
    _by_value("by_os", _count_body("visits", "os", keep_null=True)),
    _by_key("by_hour", _hours("visits", "visited_at")),
    _by_key("by_weekday", _weekdays("visits", "visited_at")),
    _by_value("top_terms", _count_body("search_log", "term_norm", 15)),
    _by_value("zero_terms", _count_body("search_log", "term_norm", 10, where="results_cnt = 0")),
    _by_key("search_timeline", _daily("search_log", "searched_at")),
]) 
TRAFFIC_SQL = with_views(TRAFFIC_BODY, "visits", "search_log")

_AGE = "CAST(floor(datesub('month', birth_date, DATE '2024-01-30') / 12) AS INTEGER)"
_AGES = (f"SELECT rank AS k, label, count(*) AS value FROM (SELECT CASE WHEN a <= 17 THEN 1 WHEN a <= 24 THEN 2 "
         "WHEN a <= 34 THEN 3 WHEN a <= 44 THEN 4 ELSE 5 END AS rank, CASE WHEN a <= 17 THEN 'under 18' "
         "WHEN a <= 24 THEN '18 - 24' WHEN a <= 34 THEN '25 - 34' WHEN a <= 44 THEN '35 - 44' ELSE '45+' END AS label "
         f"FROM (SELECT {_AGE} AS a FROM users WHERE birth_date IS NOT NULL) x) y GROUP BY 1, 2")
_TOP_USERS = ("SELECT label, value FROM (SELECT s.user_id, coalesce(u.full_name, u.username) AS label, "
              "count(s.session_id) AS value FROM sessions s JOIN users u ON s.user_id = u.id GROUP BY 1, 2) q "
              "ORDER BY value DESC, label ASC NULLS LAST, user_id LIMIT 8")

USERS_BODY = " UNION ALL ".join([
    _kpis_two(USER_KPIS_BODY, USER_KPI_NAMES, SESSION_KPIS_BODY, SESSION_KPI_NAMES),
    _by_value("by_type", _count_body("users", "user_type", keep_null=True)),
    _by_value("by_gender", _count_body("users", "gender", keep_null=True)),
    _by_value("by_status", _count_body("users", "account_status", keep_null=True)),
    _by_value("by_country", _count_body("users", "country", 8)),
    _by_value("by_city", _count_body("users", "city", 10)),
    _by_value("by_university", _count_body("users", "university", 8)),
    _by_value("by_degree", _count_body("users", "degree")),
    _by_value("by_research", _count_body("users", "research_field", 8)),
    _by_value("by_specialty", _count_body("users", "specialty", 8)),
    _by_key("age_groups", _AGES),
    _by_key("reg_timeline", _daily("users", "registered_at")),
    _by_key("login_timeline", _daily("sessions", "created_at")),
    _by_key("reg_by_hour", _hours("users", "registered_at")),
    _by_key("login_by_hour", _hours("sessions", "created_at")),
    _by_key("login_by_weekday", _weekdays("sessions", "created_at")),
    _by_value("top_users", _TOP_USERS),
]) 
USERS_SQL = with_views(USERS_BODY, "users", "sessions")

_SUB_KPIS = (f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, "
             "count(*) FILTER (WHERE status = 'unsubscribed') AS unsubscribed, "
             f"count(*) FILTER (WHERE {C.on_day('subscribed_at')}) AS today, "
             f"count(*) FILTER (WHERE {C.since_days('subscribed_at', 7)}) AS week, "
             f"count(*) FILTER (WHERE {C.since_month('subscribed_at')}) AS month, "
             "count(*) FILTER (WHERE user_id IS NOT NULL) AS registered FROM subs")
_CAMP_KPIS = "SELECT count(*) AS campaigns, count(*) FILTER (WHERE status = 'sent') AS sent FROM campaigns"
NEWSLETTER_SQL = with_views(
    _kpis_two(_SUB_KPIS, ["total", "active", "unsubscribed", "today", "week", "month", "registered"],
              _CAMP_KPIS, ["campaigns", "sent"]),
    "actions", "users", "campaigns", ctes=_FOLD_CTES)

register("traffic_dashboard", TRAFFIC_SQL)(
    lambda s, d: DB.traffic_dashboard(A.visits(s, d), A.search_log(s, d), AS_OF, HOME))
_DOC = ("SELECT '{' || string_agg(piece, ',' ORDER BY series <> 'kpis', series) || '}' AS document FROM ("
        "SELECT series, to_json(series)::VARCHAR || ':' || CASE WHEN series = 'kpis' THEN '{' || string_agg("
        "to_json(label)::VARCHAR || ':' || CAST(value AS VARCHAR), ',' ORDER BY rank) || '}' ELSE "
        "to_json(list({'label': label, 'value': value} ORDER BY rank))::VARCHAR END AS piece "
        "FROM long GROUP BY series) p")
register("traffic_document", with_views(_DOC, "visits", "search_log", ctes=f"long AS ({TRAFFIC_BODY})"))(
    lambda s, d: DB.to_document(DB.traffic_dashboard(A.visits(s, d), A.search_log(s, d), AS_OF, HOME)))
register("users_dashboard", USERS_SQL)(lambda s, d: DB.users_dashboard(A.users(s, d), A.sessions(s, d), AS_OF))
register("users_document", with_views(_DOC, "users", "sessions", ctes=f"long AS ({USERS_BODY})"))(lambda s, d: DB.to_document(DB.users_dashboard(A.users(s, d), A.sessions(s, d), AS_OF)))
register("newsletter_dashboard", NEWSLETTER_SQL)(
    lambda s, d: DB.newsletter_dashboard(_subs(s, d), A.campaigns(s, d), AS_OF))

# ------------------------------------------------------------- K5 / K6 --
def _as_stream(s, rows, ts):
    """``rows`` as a stream of four files, not quite in time order, and a last row that moves the watermark past them."""
    path = scratch_path(s, "sessionize-in")
    late = F.pmod(F.xxhash64("id"), F.lit(600)).cast("int")
    quarter = F.pmod(F.floor(F.unix_timestamp(F.timestamp_add("SECOND", late, F.col(ts))) / 604800), F.lit(4))
    dealt = rows.withColumn("_file", F.coalesce(quarter, F.lit(0))).repartition(4, "_file").drop("_file")
    dealt.write.parquet(path)
    last = rows.agg(F.timestamp_add("DAY", F.lit(60), F.max(ts)).alias(ts)).withColumns({"id": F.lit(-1).cast("long"), "visitor_id": F.lit("-")})
    last.select(*[F.col(c).cast(t).alias(c) if c in last.columns else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).parquet(path)


def _streamed(s, rows, ts, job):
    out = scratch_path(s, "sessionize-out")
    run_available(job(_as_stream(s, rows, ts)).writeStream.format("parquet").option("path", out), scratch_path(s, "sessionize-checkpoint"))
    return s.read.schema(rows.schema).parquet(out).filter("id <> -1")


_SUPPRESS_SQL = with_views(
    "SELECT id, visitor_id, page_pattern, visited_at FROM (SELECT *, lag(page_pattern) OVER w AS pp, "
    "lag(visited_at) OVER w AS pt FROM visits WINDOW w AS (PARTITION BY visitor_id ORDER BY visited_at, id)) q "
    "WHERE visitor_id IS NULL OR NOT coalesce(pp = page_pattern AND visited_at <= pt + INTERVAL 21600 SECOND, false)", "visits")
register("suppress_repeats_stream", _SUPPRESS_SQL)(lambda s, d: _streamed(
    s, A.visits(s, d).select("id", "visitor_id", "page_pattern", "visited_at"), "visited_at",
    lambda r: suppress_repeats_stream(r, 6 * 3600, "page_pattern", delay="1 day")))
register("suppress_repeats", with_views(
    "SELECT id, visitor_id, page_pattern, visited_at FROM (SELECT *, lag(page_pattern) OVER w AS pp, "
    "lag(visited_at) OVER w AS pt FROM visits WINDOW w AS (PARTITION BY visitor_id ORDER BY visited_at, id)) q "
    "WHERE visitor_id IS NULL OR NOT coalesce(pp = page_pattern AND visited_at <= pt + INTERVAL 21600 SECOND, false)",
    "visits"))(
    lambda s, d: sessionize.suppress_repeats(A.visits(s, d), 6 * 3600, "page_pattern")
    .select("id", "visitor_id", "page_pattern", "visited_at"))
register("collapse_typing", with_views(
    "SELECT id, visitor_id, term_norm, searched_at FROM (SELECT *, lead(searched_at) OVER (PARTITION BY visitor_id "
    "ORDER BY searched_at, id) AS nt FROM search_log) q WHERE visitor_id IS NULL OR nt IS NULL "
    "OR nt > searched_at + INTERVAL 7200 SECOND", "search_log"))(
    lambda s, d: sessionize.collapse_typing(A.search_log(s, d), 7200).select("id", "visitor_id", "term_norm", "searched_at"))

register("traffic_chart_arrays", with_views(
    "SELECT series, list(label ORDER BY rank) AS labels, list(value ORDER BY rank) AS \"values\" FROM long "
    "GROUP BY series", "visits", "search_log", ctes=f"long AS ({TRAFFIC_BODY})"))(
    lambda s, d: DB.series_arrays(DB.traffic_dashboard(A.visits(s, d), A.search_log(s, d), AS_OF, HOME)))
register("collapse_typing_stream", with_views(
    "SELECT id, visitor_id, term_norm, searched_at FROM (SELECT *, lead(searched_at) OVER (PARTITION BY visitor_id "
    "ORDER BY searched_at, id) AS nt FROM search_log) q WHERE visitor_id IS NULL OR nt IS NULL "
    "OR nt > searched_at + INTERVAL 7200 SECOND", "search_log"))(lambda s, d: _streamed(
        s, A.search_log(s, d).select("id", "visitor_id", "term_norm", "searched_at"), "searched_at",
        lambda r: collapse_typing_stream(r, 7200, delay="1 day")))
