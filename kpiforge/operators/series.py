"""Grouped {label, value} series.

One generic operator, ``count_by``, and thin instances.  Labels are cleaned
*before* grouping (blank and NULL fall in one group), a deliberate change
from the source system, which cleaned after grouping and could emit the
"unspecified" label twice.  Ties in a top-N are broken by label ascending,
NULLs last, so results are deterministic.

Scale notes: grouping is a hash aggregate with map-side partial counts, so a
hot label (one page holding a third of all visits) costs one row per map task
in the shuffle, not a third of the data.  A top-N becomes
``TakeOrderedAndProject`` (a per-partition heap, then a merge of N rows per
partition), never a global sort.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import age_years, clean_label
from ..schemas import AGE_BUCKETS, UNSPECIFIED
from .filters import country_scope, dim_filter, zero_results
from .joins import one_row_join


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def order_series(df: DataFrame, n: int | None = None, ordered: bool = True) -> DataFrame:
    """ORDER BY value DESC, label ASC NULLS LAST [LIMIT n] (G1 top_k).

    ``ordered=False`` skips a sort nobody reads (a caller that ranks the
    rows itself); a limit always keeps its order (it picks the rows).
    """
    if not ordered and not n:
        return df
    out = df.orderBy(F.col("value").desc(), F.col("label").asc_nulls_last())
    return out.limit(n) if n else out


def count_by(
    df: DataFrame,
    dim: Column | str,
    n: int | None = None,
    keep_null: bool = False,
    where: Column | None = None,
    unspecified: str = UNSPECIFIED,
    ordered: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """Rows per cleaned label: (label string, value bigint), largest first.

    ``weight``: ``df`` holds counts already (``lattice.base_counts``), in this column.
    """
    if where is not None:
        df = df.filter(where)
    label = clean_label(dim, unspecified if keep_null else None)
    rows = df.select(label.alias("label"), *([weight] if weight else []))
    if not keep_null:
        rows = dim_filter(rows, "label")
    value = F.sum(weight) if weight else F.count(F.lit(1))
    return order_series(rows.groupBy("label").agg(value.alias("value")), n, ordered)


def count_distinct_by(df: DataFrame, dim, of, n: int | None = None, approx: bool = False) -> DataFrame:
    """Distinct ``of`` per cleaned label (NULL labels dropped)."""
    label = clean_label(dim)
    rows = df.select(label.alias("label"), _c(of).alias("_of")).filter(F.col("label").isNotNull())
    agg = F.approx_count_distinct("_of") if approx else F.count_distinct("_of")
    return order_series(rows.groupBy("label").agg(agg.alias("value")), n)


# --- traffic (visits / search_log) ---------------------------------------
def top_pages(visits: DataFrame, n: int = 12) -> DataFrame:
    return count_by(visits, "page_path", n)


def top_sections(visits: DataFrame, n: int = 10) -> DataFrame:
    return count_by(visits, "page_pattern", n)


def home_regions(visits: DataFrame, home: str, ordered: bool = True) -> DataFrame:
    return count_by(country_scope(visits, home), "region_name", ordered=ordered)


def home_cities(visits: DataFrame, home: str, n: int = 10) -> DataFrame:
    return count_by(country_scope(visits, home), "city", n)


def visit_countries(visits: DataFrame, n: int = 10) -> DataFrame:
    return count_by(visits, "country_code", n)


def by_device(visits: DataFrame) -> DataFrame:
    return count_by(visits, "device_type", keep_null=True)


def by_browser(visits: DataFrame) -> DataFrame:
    return count_by(visits, "browser", keep_null=True)


def by_os(visits: DataFrame) -> DataFrame:
    return count_by(visits, "os", keep_null=True)


def top_terms(search: DataFrame, n: int = 15) -> DataFrame:
    return count_by(search, "term_norm", n)


def zero_terms(search: DataFrame, n: int = 10) -> DataFrame:
    return count_by(zero_results(search), "term_norm", n)


# --- users --------------------------------------------------------------
USER_SERIES = {
    # name: (column, keep_null, n)
    "by_type": ("user_type", True, None),
    "by_gender": ("gender", True, None),
    "by_status": ("account_status", True, None),
    "by_country": ("country", False, 8),
    "by_city": ("city", False, 10),
    "by_university": ("university", False, 8),
    "by_degree": ("degree", False, None),
    "by_research": ("research_field", False, 8),
    "by_specialty": ("specialty", False, 8),
}


def user_series(users: DataFrame, name: str, ordered: bool = True) -> DataFrame:
    col, keep, n = USER_SERIES[name]
    return count_by(users, col, n, keep_null=keep, ordered=ordered)


def top_users(users: DataFrame, sessions: DataFrame, n: int = 8, by_name: bool = False) -> DataFrame:
    """Sessions per user, joined to the user's display name.

    Sessions are counted per user id *before* the join (partial aggregation
    absorbs a hot user), so the join sees one row per user.  ``by_name=True``
    merges namesakes as the source system did.
    """
    return top_of_counts(users, sessions.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("session_id").alias("value")), n, by_name)


def top_of_counts(users: DataFrame, per_user: DataFrame, n: int = 8, by_name: bool = False) -> DataFrame:
    """E20 from the number of sessions per user (user_id, value)."""
    named = users.select(F.col("id").alias("user_id"),
                         F.coalesce("full_name", "username").alias("label"))
    joined = per_user.join(named, "user_id", "inner")
    if by_name:
        joined = joined.groupBy("label").agg(F.sum("value").cast("bigint").alias("value"))
        return order_series(joined.select("label", "value"), n)
    out = joined.orderBy(F.col("value").desc(), F.col("label").asc_nulls_last(), F.col("user_id").asc())
    return out.limit(n).select("user_id", "label", "value")


def age_bucket(age: Column, labels: list[tuple] = AGE_BUCKETS) -> tuple[Column, Column]:
    """(rank, label) of an age in years."""
    rank = label = None
    for r, lab, lo, hi in labels:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (age >= lo)
        if hi is not None:
            cond = cond & (age <= hi)
        rank = F.when(cond, F.lit(r)) if rank is None else rank.when(cond, F.lit(r))
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
    return rank, label


def age_groups(users: DataFrame, as_of: dt.datetime, labels: list[tuple] = AGE_BUCKETS,
               ordered: bool = True) -> DataFrame:
    """Five age buckets ordered by bucket rank; NULL birth dates dropped."""
    rank, label = age_bucket(F.col("_age"), labels)
    rows = users.filter(F.col("birth_date").isNotNull()).select(age_years("birth_date", as_of).alias("_age"))
    out = rows.select(rank.alias("rank"), label.alias("label")).groupBy("rank", "label").agg(
        F.count(F.lit(1)).alias("value"))
    out = out.select("rank", "label", "value")
    return out.orderBy("rank") if ordered else out


# --- documented extras (E23-E27) -------------------------------------------
def region_share(visits: DataFrame, dim: str = "region_name") -> DataFrame:
    """Visits per region and its percentage of all visits.

    The total is a one-row aggregate attached to the grouped result, so no
    window over the whole table is needed.
    """
    counts = count_by(visits, dim)
    total = visits.agg(F.count(F.lit(1)).alias("_total"))
    return one_row_join(counts, total).select(
        "label", "value", F.round(F.col("value") * 100.0 / F.col("_total"), 2).alias("pct"))


def local_vs_foreign(visits: DataFrame, home: str) -> DataFrame:
    """Home country vs abroad; NULL country is its own 'unknown' bucket."""
    c = F.col("country_code")
    label = F.when(c.isNull(), F.lit("unknown")).when(c == home, F.lit("local")).otherwise(F.lit("foreign"))
    return order_series(visits.select(label.alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("value")))


def top_per_group(df: DataFrame, group: Column | str, dim: Column | str, k: int, group_name: str = "grp",
                  buckets: int = 16) -> DataFrame:
    """Top-k labels per group, exact, without one sorted partition per group.

    Counts are aggregated per (group, label) first.  Then a two-level top-k:
    labels are split into ``buckets`` hash buckets, the top k of every
    (group, bucket) survive, and the final ranking runs over at most
    ``buckets * k`` survivors per group.  Any label in a group's top k is in
    its bucket's top k, so the result equals a plain ranking.
    """
    rows = df.select(_c(group).alias(group_name), clean_label(dim).alias("label")).filter(
        F.col("label").isNotNull())
    counts = rows.groupBy(group_name, "label").agg(F.count(F.lit(1)).alias("value"))
    order = [F.col("value").desc(), F.col("label").asc_nulls_last()]
    bucket = F.pmod(F.xxhash64("label"), F.lit(buckets))
    w1 = Window.partitionBy(group_name, "_b").orderBy(*order)
    survivors = (counts.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w1))
                 .filter(F.col("_r") <= k).drop("_b", "_r"))
    w = Window.partitionBy(group_name).orderBy(*order)
    return survivors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cities_in_out(visits: DataFrame, home: str, k: int = 10) -> DataFrame:
    """Top cities inside and outside the home country."""
    side = F.when(F.col("country_code") == home, F.lit("inside")).otherwise(F.lit("outside"))
    return top_per_group(visits.filter(F.col("country_code").isNotNull()), side, "city", k, "side")


def unique_visitors_by_region(visits: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct visitors per region."""
    return count_distinct_by(visits, "region_name", "visitor_id", approx=approx)


def interest_by_region(visits: DataFrame, search: DataFrame, k: int = 5) -> DataFrame:
    """Top pages and top search terms per region, one long table."""
    pages = top_per_group(visits, "region_name", "page_path", k, "region").withColumn("kind", F.lit("page"))
    terms = top_per_group(search, "region_name", "term_norm", k, "region").withColumn("kind", F.lit("term"))
    return pages.unionByName(terms).filter(F.col("region").isNotNull()).select("kind", "region", "rank", "label", "value")
