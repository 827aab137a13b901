"""One-row KPI aggregates and small scalar lookups.

Plain conditional counts (``count_if``) of a KPI row share one pass.  Exact
distinct counts are, by default, one aggregate each (``kpi_row`` with
``split=True``): several exact distincts in one aggregate would make Catalyst
plan an ``Expand`` (one copy of every row per distinct column) before the
partial aggregate.  ``approx=True`` uses ``approx_count_distinct``
(HyperLogLog++, fixed-size buffers) in the single pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Calendar
from .filters import active_session
from ..schemas import DEFAULT_YEAR, FEMALE_SPELLINGS, MALE_SPELLINGS


def _distinct(c: Column, approx: bool) -> Column:
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def kpi_row(df: DataFrame, columns: list[tuple], approx: bool = False, split: bool = True) -> DataFrame:
    """One-row KPI aggregate from ``(name, aggregate)`` and ``(name, distinct_col, condition)`` specs.

    Plain aggregates always share one pass.  Distinct counts:
    ``approx`` -> ``approx_count_distinct`` in the same pass (HLL++, no Expand);
    ``split`` (default) -> one two-stage aggregate per distinct column (no
    Expand, each hash table holds one column's values): a single condition
    becomes a filter pushed to the scan; several conditions on the same
    column share one pass that keeps one flag per condition per value.  The one-row results are stacked as
    (name, value) rows and folded back into one row by a final aggregate
    over those few rows (no join);
    otherwise -> ``count(DISTINCT CASE ...)`` in the same pass (Catalyst
    plans an Expand with one copy of every row per distinct column).
    """
    plain = [agg.alias(name) for name, agg in (c for c in columns if len(c) == 2)]
    distinct = [c for c in columns if len(c) == 3]
    order = [c[0] for c in columns]
    if approx or not split or not distinct:
        aggs = plain + [_distinct(F.when(cond, col) if cond is not None else col, approx).alias(name)
                        for name, col, cond in distinct]
        return df.agg(*aggs).select(*order)
    by_column: dict[str, tuple[Column, list]] = {}
    for name, col, cond in distinct:
        by_column.setdefault(str(col), (col, []))[1].append((name, cond))
    parts = []
    for col, specs in by_column.values():
        if len(specs) == 1:  # the condition becomes a filter, pushed to the scan
            name, cond = specs[0]
            part = (df.filter(cond) if cond is not None else df).agg(F.count_distinct(col).cast("bigint").alias("_v"))
            parts.append(part.select(F.lit(name).alias("_k"), "_v"))
            continue
        # several conditions on one column: one pass per distinct value, one flag per condition
        flags = [F.max(F.coalesce(cond, F.lit(False)) if cond is not None else F.lit(True)).alias(f"_f{i}")
                 for i, (_, cond) in enumerate(specs)]
        per_value = df.filter(col.isNotNull()).groupBy(col.alias("_val")).agg(*flags)
        counts = per_value.agg(*[F.count_if(F.col(f"_f{i}")).alias(f"_c{i}") for i in range(len(specs))])
        parts.append(counts.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(n) for n, _ in specs]),
            F.array(*[F.col(f"_c{i}").cast("bigint") for i in range(len(specs))]))).alias("_k", "_v")))
    if plain:
        base = df.agg(*plain)
        parts.append(base.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(n) for n in base.columns]),
            F.array(*[F.col(n).cast("bigint") for n in base.columns]))).alias("_k", "_v")))
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.agg(*[F.max(F.when(F.col("_k") == n, F.col("_v"))).cast("bigint").alias(n) for n in order])


def visit_kpis(visits: DataFrame, as_of, home: str, approx: bool = False, split: bool = True) -> DataFrame:
    """Twelve visit indicators."""
    cal, ts = Calendar.of(as_of), F.col("visited_at")
    today = cal.on_day(ts)
    return kpi_row(visits, [
        ("total_visits", F.count(F.lit(1))),
        ("today", F.count_if(today)),
        ("yesterday", F.count_if(cal.on_day(ts, 1))),
        ("week", F.count_if(cal.since_days(ts, 7))),
        ("month", F.count_if(cal.since_month(ts))),
        ("unique_visitors", F.col("visitor_id"), None),
        ("unique_today", F.col("visitor_id"), today),
        ("sessions", F.col("session_key"), None),
        ("registered", F.count_if(F.col("is_registered") == 1)),
        ("guests", F.count_if(F.col("is_registered") == 0)),
        ("countries", F.col("country_code"), None),
        ("home_regions", F.col("region_name"), F.col("country_code") == home),
    ], approx, split)


def search_kpis(search: DataFrame, as_of, approx: bool = False, split: bool = True) -> DataFrame:
    """Four search indicators."""
    cal = Calendar.of(as_of)
    return kpi_row(search, [
        ("searches", F.count(F.lit(1))),
        ("unique_terms", F.col("term_norm"), None),
        ("zero_results", F.count_if(F.col("results_cnt") == 0)),
        ("searches_today", F.count_if(cal.on_day(F.col("searched_at")))),
    ], approx, split)


def user_kpis(users: DataFrame, as_of, active_status: str = "active",
              male: list[str] = MALE_SPELLINGS, female: list[str] = FEMALE_SPELLINGS,
              approx: bool = False, split: bool = True) -> DataFrame:
    """D3: fifteen user indicators (gender KPIs fold the listed spellings)."""
    cal, ts = Calendar.of(as_of), F.col("registered_at")
    return kpi_row(users, [
        ("total_users", F.count(F.lit(1))),
        ("today", F.count_if(cal.on_day(ts))),
        ("yesterday", F.count_if(cal.on_day(ts, 1))),
        ("week", F.count_if(cal.since_days(ts, 7))),
        ("month", F.count_if(cal.since_month(ts))),
        ("active_accounts", F.count_if(F.col("account_status") == active_status)),
        ("google_users", F.count_if(F.col("password_hash").isNull())),
        ("local_users", F.count_if(F.col("password_hash").isNotNull())),
        ("with_avatar", F.count_if(F.col("avatar").isNotNull())),
        ("with_phone", F.count_if(F.col("phone").isNotNull())),
        ("males", F.count_if(F.col("gender").isin(*male))),
        ("females", F.count_if(F.col("gender").isin(*female))),
        ("countries_count", F.col("country"), None),
        ("cities_count", F.col("city"), None),
        ("universities_count", F.col("university"), None),
    ], approx, split)


def session_kpis(sessions: DataFrame, as_of, approx: bool = False, split: bool = True) -> DataFrame:
    """Nine login indicators.  Addresses are only ever counted, never output."""
    cal, ts = Calendar.of(as_of), F.col("created_at")
    return kpi_row(sessions, [
        ("total_sessions", F.count(F.lit(1))),
        ("active_sessions", F.count_if(active_session(as_of))),
        ("logins_today", F.count_if(cal.on_day(ts))),
        ("logins_week", F.count_if(cal.since_days(ts, 7))),
        ("logins_month", F.count_if(cal.since_month(ts))),
        ("last_24h_logins", F.count_if(cal.since_hours(ts, 24))),
        ("unique_logins_7d", F.col("user_id"), cal.since_days(ts, 7)),
        ("unique_logins_30d", F.col("user_id"), cal.since_days(ts, 30)),
        ("distinct_ips", F.col("ip_address"), None),
    ], approx, split)


def subscriber_kpis(subs: DataFrame, as_of) -> DataFrame:
    """Seven subscriber indicators."""
    cal, ts = Calendar.of(as_of), F.col("subscribed_at")
    return subs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "unsubscribed").alias("unsubscribed"),
        F.count_if(cal.on_day(ts)).alias("today"),
        F.count_if(cal.since_days(ts, 7)).alias("week"),
        F.count_if(cal.since_month(ts)).alias("month"),
        F.count_if(F.col("user_id").isNotNull()).alias("registered"),
    )


def campaign_kpis(campaigns: DataFrame) -> DataFrame:
    """Campaigns and sent campaigns."""
    return campaigns.agg(
        F.count(F.lit(1)).alias("campaigns"),
        F.count_if(F.col("status") == "sent").alias("sent"),
    )


def latest_year(achievements: DataFrame, default: int = DEFAULT_YEAR) -> DataFrame:
    """Newest published year, or ``default`` when nothing is published (one row)."""
    pub = achievements.filter(F.col("is_published") == 1)
    return pub.agg(F.coalesce(F.max("year_no"), F.lit(default)).cast("int").alias("year"))


def send_rollup(log: DataFrame) -> DataFrame:
    """Recipients, sent and failed per campaign."""
    return log.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("recipients"),
        F.count_if(F.col("status") == "sent").alias("sent"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def duplicate_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Keys held by more than one row (NULL keys excluded)."""
    return (df.select(key.alias(name)).filter(F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1))


def name_taken_count(candidates: DataFrame, users: DataFrame, col: str = "username") -> DataFrame:
    """For each candidate name, how many users hold it ignoring case.

    Existing names are counted per lowercase key first (one row per key), then
    joined, so a popular name costs one row, not one row per holder.
    """
    taken = users.filter(F.col(col).isNotNull()).groupBy(F.lower(col).alias("_k")).agg(
        F.count(F.lit(1)).alias("taken"))
    cand = candidates.withColumn("_k", F.lower(F.col(col)))
    return (cand.join(taken, "_k", "left")
            .select(*candidates.columns, F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")))


def split_kpi(kpis: DataFrame, a: str, b: str, label_a: str | None = None, label_b: str | None = None) -> DataFrame:
    """A two-slice series (label, value) from two KPI columns."""
    la, lb = label_a or a, label_b or b
    return kpis.select(F.expr(f"stack(2, '{la}', CAST({a} AS BIGINT), '{lb}', CAST({b} AS BIGINT)) AS (label, value)"))


def distinct_years(achievements: DataFrame) -> DataFrame:
    """Published years, newest first."""
    return (achievements.filter(F.col("is_published") == 1).select(F.col("year_no").alias("year"))
            .distinct().orderBy(F.col("year").desc()))
