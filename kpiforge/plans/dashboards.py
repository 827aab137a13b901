"""Whole dashboards as one long table, and as one JSON document.

Long table columns: ``series`` (name), ``rank`` (1-based position in the
series), ``label``, ``value``.  KPI rows are the series ``kpis`` in their
display order.

Scans: the source ran 16 (traffic) and 18 (users) statements, one scan each.
Here series and KPIs are added up from a few base counts (``operators.lattice``):
traffic scans the visits four times and the searches once, users scans the
sessions once and the users twice, and only the places need the geography join.
Every scan reads only the columns it needs (Parquet column pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import Calendar, age_years
from ..operators import kpis, lattice, series
from ..operators.joins import one_row_join
from ..operators.parts import PART_BYTES, document_parts, with_commas
from ..operators.filters import active_session
from ..schemas import FEMALE_SPELLINGS, MALE_SPELLINGS

def _rank_by_value(name: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(name).alias("series"), (-F.col("value")).cast("bigint").alias("_k1"),
                     F.col("label").cast("string").alias("label"), F.col("value").cast("bigint").alias("value"))


def _rank_by_key(name: str, df: DataFrame, key: Column, label: Column) -> DataFrame:
    return df.select(F.lit(name).alias("series"), key.cast("bigint").alias("_k1"), label.cast("string").alias("label"),
                     F.col("value").cast("bigint").alias("value"))


def kpi_rows(kpi_row: DataFrame, name: str = "kpis", offset: int = 0) -> DataFrame:
    """Unpivot a one-row KPI aggregate into (series, _k1, label, value) rows, in column order."""
    parts = ", ".join(f"{i + offset}L, '{c}', CAST(`{c}` AS BIGINT)" for i, c in enumerate(kpi_row.columns))
    rows = kpi_row.select(F.expr(f"stack({len(kpi_row.columns)}, {parts}) AS (_k1, label, value)"))
    return rows.select(F.lit(name).alias("series"), "_k1", "label", "value")


def _finish(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("series").orderBy(F.col("_k1"), F.col("label").asc_nulls_last())
    return out.select("series", F.row_number().over(w).alias("rank"), "label", "value")


def _keep_null(counts: DataFrame, dims: dict[str, str]) -> list[DataFrame]:
    return [_rank_by_value(name, series.count_by(counts, c, keep_null=True, ordered=False, weight="n")) for name, c in dims.items()]


def _by_time(counts: DataFrame, cal: Calendar, days: str, hours: str | None, weekdays: str | None) -> list[DataFrame]:
    """Series of the base counts by (day, hour): the last 30 days, the hours and the weekdays."""
    per_day = counts.filter(cal.since_days(F.col("day").cast("timestamp_ntz"), 30)).groupBy("day").agg(F.sum("n").alias("value"))
    out = [_rank_by_key(days, per_day, F.unix_date("day"), F.date_format("day", "yyyy-MM-dd"))]
    for name, key in ((hours, F.col("hour")), (weekdays, F.weekday("day"))):
        if name is not None:
            rows = counts.filter(F.col("day").isNotNull()).groupBy(key.alias("k")).agg(F.sum("n").alias("value"))
            out.append(_rank_by_key(name, rows, F.col("k"), F.col("k")))
    return out


def _stacked(*rows: DataFrame) -> DataFrame:
    """The KPIs of several one-row tables in their order: one (_k1, label, value) row each."""
    parts, at = [], 0
    for row in rows:
        parts.append(kpi_rows(row, offset=at))
        at += len(row.columns)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _times(cal: Calendar) -> dict[str, Column]:
    """Conditions on the day of a base count; all boundaries are midnights."""
    ts = F.col("day").cast("timestamp_ntz")
    return {"today": cal.on_day(ts), "yesterday": cal.on_day(ts, 1), "week": cal.since_days(ts, 7), "month": cal.since_month(ts)}


def traffic_dashboard(visits: DataFrame, search: DataFrame, as_of, home: str, approx: bool = False) -> DataFrame:
    """16 KPIs and the 14 traffic/search series.

    Two scans give the base counts of the visits (only places need the geography), one those of the searches;
    the two distinct counts of high cardinality have a narrow scan each.
    """
    cal = Calendar.of(as_of)
    day = {"day": F.to_date("visited_at"), "hour": F.hour("visited_at")}
    base = lattice.base_counts(visits.withColumns(day), {
        "page": ["page_path", "page_pattern"], "agent": ["device_type", "browser", "os"], "time": ["day", "hour"],
        "registered": ["is_registered"]}, {}, "traffic-visits")
    place = lattice.base_counts(visits, {"place": ["country_code", "region_name", "city"]}, {}, "traffic-places")["place"]
    asked = search.select("term_norm", (F.col("results_cnt") == 0).alias("zero"), F.to_date("searched_at").alias("day"))
    asked = lattice.base_counts(asked, {"term": ["term_norm", "zero"], "day": ["day"]}, {}, "traffic-searches")

    at_home = F.col("country_code") == home
    times, distinct = _times(cal), F.approx_count_distinct if approx else F.count_distinct
    visitors = kpis.kpi_row(visits, [("unique_visitors", F.col("visitor_id"), None), ("unique_today", F.col("visitor_id"), cal.on_day(F.col("visited_at")))], approx)
    is_in = F.col("is_registered")
    rows = _stacked(
        lattice.total(base["time"], total_visits=None, **times), visitors,
        visits.agg(distinct("session_key").alias("sessions")),
        lattice.total(base["registered"], registered=is_in == 1, guests=is_in == 0),
        kpis.kpi_row(place, [("countries", F.col("country_code"), None), ("home_regions", F.col("region_name"), at_home)]),
        lattice.total(asked["day"], searches=None),
        asked["term"].agg(F.count_distinct("term_norm").alias("unique_terms")),
        lattice.total(asked["term"], zero_results=F.col("zero")),
        lattice.total(asked["day"], searches_today=times["today"]))

    def top(name: str, counts: DataFrame, dim: str, n: int | None = None, where: Column | None = None) -> DataFrame:
        return _rank_by_value(name, series.count_by(counts, dim, n, where=where, ordered=False, weight="n"))

    return _finish([
        rows,
        *_by_time(base["time"], cal, "visits_timeline", "by_hour", "by_weekday"),
        top("top_pages", base["page"], "page_path", 12), top("top_sections", base["page"], "page_pattern", 10),
        top("home_regions", place, "region_name", where=at_home), top("home_cities", place, "city", 10, at_home),
        top("by_country", place, "country_code", 10),
        *_keep_null(base["agent"], {"by_device": "device_type", "by_browser": "browser", "by_os": "os"}),
        top("top_terms", asked["term"], "term_norm", 15), top("zero_terms", asked["term"], "term_norm", 10, F.col("zero")),
        *_by_time(asked["day"], cal, "search_timeline", None, None),
    ])


def users_dashboard(users: DataFrame, sessions: DataFrame, as_of) -> DataFrame:
    """24 KPIs and the 16 user/login series: one scan of the users, one of the sessions, and the names of the top users."""
    cal = Calendar.of(as_of)
    flags = {"local": F.col("password_hash").isNotNull(), "pictured": F.col("avatar").isNotNull(), "reachable": F.col("phone").isNotNull()}
    ages = F.when(F.col("birth_date").isNotNull(), age_years("birth_date", as_of))
    shaped = users.withColumns(flags | {"age": ages, "day": F.to_date("registered_at"), "hour": F.hour("registered_at")})
    sets = {name: [c] for name, (c, _, _) in series.USER_SERIES.items()}
    base = lattice.base_counts(shaped, sets | {"age": ["age"], "time": ["day", "hour"], "flags": list(flags)}, {}, "users-users")

    ts = F.col("created_at")
    measures = {
        "open": F.count_if(active_session(as_of)), "recent": F.count_if(cal.since_hours(ts, 24)),
        "d7": F.count_if(cal.since_days(ts, 7)), "d30": F.count_if(cal.since_days(ts, 30)), "numbered": F.count("session_id")}
    logins = lattice.base_counts(sessions.withColumns({"day": F.to_date("created_at"), "hour": F.hour("created_at")}),
                                 {"time": ["day", "hour"], "user": ["user_id"], "ip": ["ip_address"]}, measures, "users-logins")

    times, gender = _times(cal), F.col("gender")
    known = {name: base[name].agg(F.count_distinct(c).alias(f"{kpi}_count")) for name, c, kpi in (
        ("by_country", "country", "countries"), ("by_city", "city", "cities"), ("by_university", "university", "universities"))}
    rows = _stacked(
        lattice.total(base["time"], total_users=None, **times),
        lattice.total(base["by_status"], active_accounts=F.col("account_status") == "active"),
        lattice.total(base["flags"], google_users=~F.col("local"), local_users=F.col("local"), with_avatar=F.col("pictured"), with_phone=F.col("reachable")),
        lattice.total(base["by_gender"], males=gender.isin(*MALE_SPELLINGS), females=gender.isin(*FEMALE_SPELLINGS)),
        *known.values(),
        logins["time"].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_sessions"), F.coalesce(F.sum("open"), F.lit(0)).alias("active_sessions")),
        lattice.total(logins["time"], logins_today=times["today"], logins_week=times["week"], logins_month=times["month"]),
        logins["time"].agg(F.coalesce(F.sum("recent"), F.lit(0)).alias("last_24h_logins")),
        logins["user"].filter("user_id is not null").agg(F.count_if(F.col("d7") > 0).alias("unique_logins_7d"), F.count_if(F.col("d30") > 0).alias("unique_logins_30d")),
        logins["ip"].agg(F.count("ip_address").alias("distinct_ips")))

    rank, label = series.age_bucket(F.col("age"))
    by_age = base["age"].filter("age is not null").select(rank.alias("rank"), label.alias("label"), "n").groupBy("rank", "label").agg(F.sum("n").alias("value"))
    per_user = logins["user"].filter("user_id is not null").select("user_id", F.col("numbered").alias("value"))
    return _finish([
        rows,
        *[_rank_by_value(name, series.count_by(base[name], c, n, keep_null=keep, ordered=False, weight="n"))
          for name, (c, keep, n) in series.USER_SERIES.items()],
        _rank_by_key("age_groups", by_age, F.col("rank"), F.col("label")),
        *_by_time(base["time"], cal, "reg_timeline", "reg_by_hour", None),
        *_by_time(logins["time"], cal, "login_timeline", "login_by_hour", "login_by_weekday"),
        _rank_by_value("top_users", series.top_of_counts(users, per_user).select("label", "value")),
    ])


def newsletter_dashboard(subs: DataFrame, campaigns: DataFrame, as_of) -> DataFrame:
    """The nine newsletter KPIs."""
    s = kpis.subscriber_kpis(subs, as_of)
    c = kpis.campaign_kpis(campaigns)
    return _finish([kpi_rows(s), kpi_rows(c, offset=len(s.columns))])


def to_document(long: DataFrame) -> DataFrame:
    """One JSON text {"kpis": {name: value}, "<series>": [{label, value}, ...], ...}.

    Each series is collected as a sorted array (bounded by the series' own
    size); the object is assembled from ``to_json`` fragments so series keys
    stay at the top level as in the source.
    """
    item = F.struct(F.col("rank"), F.struct("label", "value").alias("lv"))
    per = long.groupBy("series").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    frag = F.when(
        F.col("series") == "kpis",
        F.to_json(F.map_from_entries(F.transform("_items", lambda x: F.struct(x["lv"]["label"], x["lv"]["value"])))),
    ).otherwise(F.to_json(F.transform("_items", lambda x: x["lv"])))
    key = F.regexp_extract(F.to_json(F.array(F.col("series"))), r"^\[(.*)\]$", 1)
    pieces = per.select(F.struct((F.col("series") != "kpis").alias("_o"), F.col("series"),
                                 F.concat(key, F.lit(":"), frag).alias("_p")).alias("_e"))
    body = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda x: x["_p"]), ",").alias("_b"))
    return body.select(F.concat(F.lit("{"), F.col("_b"), F.lit("}")).alias("document"))


def to_document_parts(long: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """A8 as (part, offset, text): the parts in order are ``to_document``; no series is collected whole."""
    order = ["_o", "series", "_kind", "rank"]
    named = F.regexp_replace(F.to_json(F.map_from_arrays(F.array("label"), F.array("value"))), r"^\{|\}$", "")
    value = F.when(F.col("_o"), F.to_json(F.struct("label", "value"))).otherwise(named)
    long = long.withColumn("_o", F.col("series") != "kpis")
    rows = long.select("_o", "series", F.lit(1).alias("_kind"), "rank", F.lit(True).alias("_listed"), value.alias("text"))
    key = F.regexp_extract(F.to_json(F.array(F.col("series"))), r"^\[(.*)\]$", 1)
    each = long.select("_o", "series").distinct()
    begin = F.concat(key, F.when(F.col("_o"), F.lit(":[")).otherwise(F.lit(":{")))
    end = F.when(F.col("_o"), F.lit("]")).otherwise(F.lit("}"))
    heads = [each.select("_o", "series", F.lit(kind).alias("_kind"), F.lit(0).alias("rank"), F.lit(False).alias("_listed"), text.alias("text"))
             for kind, text in ((0, begin), (2, end))]
    first = each.agg(F.min(F.struct("_o", "series")).alias("_f"))
    heads[0] = one_row_join(heads[0], first).withColumn(
        "text", F.concat(F.when(F.struct("_o", "series") > F.col("_f"), F.lit(",")).otherwise(F.lit("")), F.col("text"))).drop("_f")
    edge = [long.sparkSession.range(1).select(F.lit(o).alias("_o"), F.lit(name).alias("series"), F.lit(kind).alias("_kind"), F.lit(0).alias("rank"),
                                              F.lit(False).alias("_listed"), F.lit(text).alias("text"))
            for o, name, kind, text in ((False, "", 0, "{"), (True, "\uffff", 3, "}"))]
    every = rows
    for part in [*heads, *edge]:
        every = every.unionByName(part)
    return document_parts(with_commas(every, "series", "_listed", ["rank"]), order, part_bytes)


def series_arrays(long: DataFrame) -> DataFrame:
    """Each series as two parallel arrays (labels, values) in rank order, the chart input."""
    from ..functions import pairs_to_arrays

    per = long.groupBy("series").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "value"))),
                    lambda x: F.struct(x["label"].alias("label"), x["value"].alias("value"))).alias("_lv"))
    labels, values = pairs_to_arrays("_lv")
    return per.select("series", labels.alias("labels"), values.alias("values"))
