"""Achievements report: year resolution, items, headline stats, category counts.

A requested year that parses is a literal filter (pushed to the scan).
Otherwise the newest published year (else 2025) stays in the plan as a
one-row aggregate joined to the facts on ``year_no`` (broadcast, exactly one
row), so nothing is pulled to the driver.  Categories are a bounded
dimension and are broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_YEAR
from .filters import featured_with_figure, optional_equals, published
from .joins import one_row_join
from .parts import PART_BYTES, document_parts, with_commas
from .kpis import latest_year


def resolve_year(achievements: DataFrame, requested: str | int | None) -> int | DataFrame:
    """The report year (S33): the requested year if it parses, else D7.

    The request parameter is parsed on the driver (it is an argument, not
    data) and returned as an int; only the fallback is data-derived, a
    one-row DataFrame with column ``year``.
    """
    text = str(requested).strip()
    if re.fullmatch("[+-]?[0-9]+", text):  # int() would also take 2_022 and other digits than 0-9
        return int(text)
    return latest_year(achievements, DEFAULT_YEAR)


def year_frame(achievements: DataFrame, year: int | DataFrame) -> DataFrame:
    """The resolved year as a one-row DataFrame."""
    if isinstance(year, DataFrame):
        return year
    return achievements.sparkSession.range(1).select(F.lit(year).cast("int").alias("year"))


def _published_in(achievements: DataFrame, year: int | DataFrame) -> DataFrame:
    pub = published(achievements)
    if not isinstance(year, DataFrame):
        return pub.filter(F.col("year_no") == year)  # pushed to the scan
    return pub.join(F.broadcast(year), F.col("year_no") == F.col("year"), "inner").drop("year")


def _with_category(items: DataFrame, categories: DataFrame) -> DataFrame:
    cats = categories.select(
        F.col("code").alias("category"), F.col("name").alias("category_name"), "icon", "color",
        F.col("display_order").alias("category_order"))
    return items.join(cats, "category", "inner")


def achievement_items(achievements: DataFrame, categories: DataFrame, year: int | DataFrame,
                      category: str | None = None) -> DataFrame:
    """Published items of the year, optional category ('all'/None = every one)."""
    items = optional_equals(_published_in(achievements, year), "category", category)
    out = _with_category(items, categories)
    return out.orderBy(F.col("category_order").asc_nulls_last(), F.col("category"),
                       F.col("display_order").asc_nulls_last(), F.col("id")).select(
        "id", "category", "category_name", "icon", "color", "title", "summary", "figure_value",
        "figure_label", "source_url", (F.col("is_featured") == 1).alias("featured"))


def achievement_stats(achievements: DataFrame, categories: DataFrame, year: int | DataFrame) -> DataFrame:
    """Featured items with a figure, in category then item order."""
    items = featured_with_figure(_published_in(achievements, year))
    out = _with_category(items, categories)
    return out.orderBy(F.col("category_order").asc_nulls_last(), F.col("category"),
                       F.col("display_order").asc_nulls_last(), F.col("id")).select(
        "id", F.col("figure_value").alias("value"), F.col("figure_label").alias("label"), "category", "color")


def category_counts(achievements: DataFrame, categories: DataFrame, year: int | DataFrame) -> DataFrame:
    """Categories with their item count for the year; empty ones hidden."""
    counts = _published_in(achievements, year).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    out = _with_category(counts, categories)
    return out.orderBy(F.col("category_order").asc_nulls_last(), F.col("category")).select(
        F.col("category").alias("code"), F.col("category_name").alias("name"), "icon", "color", "count")


_LAST = 2**31 - 1  # order key that sorts NULL display orders last


def _sorted_array(df: DataFrame, name: str, order: list, fields: list) -> DataFrame:
    """One row: ``name`` = array of ``fields`` structs sorted by the ``order`` columns."""
    e = F.struct(F.struct(*order).alias("k"), F.struct(*fields).alias("v"))
    return df.agg(F.transform(F.array_sort(F.collect_list(e)), lambda x: x["v"]).alias(name))


def achievements_document(achievements: DataFrame, categories: DataFrame, requested_year=None,
                          category: str | None = None) -> DataFrame:
    """The report as one JSON text {year, years, stats, categories, items}.

    Each array is ``collect_list`` of structs sorted by an explicit order key;
    its size is bounded by one year's published items.  NULL fields are
    omitted, as the source's JSON writer does.
    """
    year = resolve_year(achievements, requested_year)
    years = (achievements.filter(F.col("is_published") == 1)
             .agg(F.sort_array(F.collect_set("year_no"), asc=False).alias("years")))
    cats = categories.select(
        F.col("code").alias("category"), F.col("name").alias("category_name"), "icon", "color",
        F.coalesce(F.col("display_order"), F.lit(_LAST)).alias("_co"))
    pub = _published_in(achievements, year).withColumn(
        "_io", F.coalesce(F.col("display_order"), F.lit(_LAST))).join(cats, "category", "inner")
    item_order = [F.col("_co"), F.col("category"), F.col("_io"), F.col("id")]

    listed = pub if category in (None, "all") else pub.filter(F.col("category") == category)
    items = _sorted_array(listed, "items", item_order, [
        F.col("id"), F.col("category"), F.col("category_name").alias("categoryName"), F.col("icon"),
        F.col("color"), F.col("title"), F.col("summary"), F.col("figure_value").alias("figureValue"),
        F.col("figure_label").alias("figureLabel"), F.col("source_url").alias("sourceUrl"),
        (F.col("is_featured") == 1).alias("featured")])
    stats = _sorted_array(
        pub.filter((F.col("is_featured") == 1) & F.col("figure_value").isNotNull()), "stats", item_order,
        [F.col("figure_value").alias("value"), F.col("figure_label").alias("label"), F.col("category"),
         F.col("color")])
    counted = pub.groupBy("category", "category_name", "icon", "color", "_co").agg(F.count(F.lit(1)).alias("count"))
    cat_doc = _sorted_array(counted, "categories", [F.col("_co"), F.col("category")], [
        F.col("category").alias("code"), F.col("category_name").alias("name"), F.col("icon"), F.col("color"),
        F.col("count")])
    doc = one_row_join(year_frame(achievements, year), years, stats, cat_doc, items)
    body = F.struct(
        F.col("year"), F.coalesce(F.col("years"), F.array()).alias("years"),
        F.coalesce(F.col("stats"), F.array()).alias("stats"),
        F.coalesce(F.col("categories"), F.array()).alias("categories"),
        F.coalesce(F.col("items"), F.array()).alias("items"))
    return doc.select(F.col("year"), F.to_json(body).alias("document"))


def achievements_parts(achievements: DataFrame, categories: DataFrame, requested_year=None, category: str | None = None,
                       part_bytes: int = PART_BYTES) -> DataFrame:
    """A9 as (part, offset, text): the parts in order are ``achievements_document``; no task collects a year's items."""
    year = resolve_year(achievements, requested_year)
    years = (achievements.filter(F.col("is_published") == 1)
             .agg(F.sort_array(F.collect_set("year_no"), asc=False).alias("years")))
    cats = categories.select(
        F.col("code").alias("category"), F.col("name").alias("category_name"), "icon", "color",
        F.coalesce(F.col("display_order"), F.lit(_LAST)).alias("_co"))
    pub = _published_in(achievements, year).withColumn(
        "_io", F.coalesce(F.col("display_order"), F.lit(_LAST))).join(cats, "category", "inner")
    listed = pub if category in (None, "all") else pub.filter(F.col("category") == category)
    counted = pub.groupBy("category", "category_name", "icon", "color", "_co").agg(F.count(F.lit(1)).alias("count"))

    def pieces(section: int, rows: DataFrame, text: Column, place: dict[str, Column] | None = None) -> DataFrame:
        at = {"_co": F.lit(0), "category": F.lit(""), "_io": F.lit(0), "id": F.lit(0).cast("bigint")} | (place or {})
        return rows.select(F.lit(section).alias("section"), F.lit(place is not None).alias("listed"),
                           *[c.alias(k) for k, c in at.items()], text.alias("text"))

    def word(section: int, text: str) -> DataFrame:
        return pieces(section, achievements.sparkSession.range(1), F.lit(text))

    def element(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields))

    by_item = {c: F.col(c) for c in ("_co", "category", "_io", "id")}
    by_category = {c: F.col(c) for c in ("_co", "category")}
    featured = pub.filter((F.col("is_featured") == 1) & F.col("figure_value").isNotNull())
    head = one_row_join(year_frame(achievements, year), years)
    start = F.to_json(F.struct("year", F.coalesce(F.col("years"), F.array()).alias("years")))
    parts = [
        pieces(0, head, F.regexp_replace(start, r"\}$", "")),
        word(1, ',"stats":['),
        pieces(1, featured, element(F.col("figure_value").alias("value"), F.col("figure_label").alias("label"), F.col("category"), F.col("color")), by_item),
        word(2, '],"categories":['),
        pieces(2, counted, element(F.col("category").alias("code"), F.col("category_name").alias("name"), F.col("icon"), F.col("color"), F.col("count")), by_category),
        word(3, '],"items":['),
        pieces(3, listed, element(
            F.col("id"), F.col("category"), F.col("category_name").alias("categoryName"), F.col("icon"), F.col("color"), F.col("title"),
            F.col("summary"), F.col("figure_value").alias("figureValue"), F.col("figure_label").alias("figureLabel"),
            F.col("source_url").alias("sourceUrl"), (F.col("is_featured") == 1).alias("featured")), by_item),
        word(4, "]}"),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = ["_co", "category", "_io", "id"]
    return document_parts(with_commas(every, "section", "listed", order), ["section", "listed", *order], part_bytes)
