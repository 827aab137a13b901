"""K1/K2 in batch form: validate, enrich and shape raw visit/search events.

Each function returns (accepted rows in the table's shape, quarantined rows
with a reason).  The source lost an event on any error; here nothing is lost:
an event either lands in the table or in quarantine with the first failing
check.  Lookups: session token -> user (exactly one session valid when the event
arrived, S19),
home-country region code -> name (S20).  Over-long free text is truncated
(S22); over-long codes are rejected (S21).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_label, truncate
from .joins import attach_region, attach_user

# Columns cut to width on intake vs columns rejected when too long.
VISIT_TRUNCATE = {"path": 500, "pattern": 200, "title": 300, "referrer": 500, "city": 100}
VISIT_REJECT = {"token": 255, "visitor_id": 64, "region": 10, "device": 20, "browser": 50, "os": 50, "session_key": 64}
SEARCH_REJECT = {"token": 255, "visitor_id": 64, "region": 10}


def _first_reason(checks: list[tuple[Column, str]]) -> Column:
    out = None
    for cond, text in checks:
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out


def _width_checks(widths: dict[str, int]) -> list[tuple[Column, str]]:
    return [(F.length(F.col(c)) > w, f"{c} longer than {w}") for c, w in widths.items()]


def empty_as_null(df: DataFrame) -> DataFrame:
    """S1: '' reads as NULL in every text column."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def visit_intake(events: DataFrame, sessions: DataFrame, regions: DataFrame, home: str,
                 country_width: int = 2) -> tuple[DataFrame, DataFrame]:
    events = empty_as_null(events)
    country = F.upper(F.col("country"))
    checks = [(F.length(country) > country_width, f"country longer than {country_width}")] + _width_checks(VISIT_REJECT)
    tagged = events.withColumn("country", country).withColumn("reason", _first_reason(checks))
    quarantine = tagged.filter(F.col("reason").isNotNull()).select("event_id", "received_at", "reason")
    ok = tagged.filter(F.col("reason").isNull())
    ok = attach_user(ok, sessions)
    ok = attach_region(ok, regions, home, country="country", code="region")
    visits = ok.select(
        F.col("event_id").alias("id"),
        "visitor_id",
        F.col("session_user_id").alias("user_id"),
        F.when(F.col("session_user_id").isNull(), 0).otherwise(1).alias("is_registered"),
        truncate("path", 500).alias("page_path"),
        truncate("pattern", 200).alias("page_pattern"),
        truncate("title", 300).alias("page_title"),
        truncate("referrer", 500).alias("referrer"),
        F.col("country").alias("country_code"),
        F.col("region").alias("region_code"),
        F.col("region_name_lookup").alias("region_name"),
        truncate("city", 100).alias("city"),
        F.col("device").alias("device_type"),
        "browser", "os", "session_key",
        F.col("received_at").alias("visited_at"),
    )
    return visits, quarantine


def search_intake(events: DataFrame, sessions: DataFrame, regions: DataFrame, home: str,
                  country_width: int = 2) -> tuple[DataFrame, DataFrame]:
    events = empty_as_null(events)
    country = F.upper(F.col("country"))
    term = truncate(clean_label("term"), 400)
    checks = ([(term.isNull(), "blank term"), (F.length(country) > country_width, f"country longer than {country_width}")]
              + _width_checks(SEARCH_REJECT))
    tagged = (events.withColumn("country", country).withColumn("term", term)
              .withColumn("reason", _first_reason(checks)))
    quarantine = tagged.filter(F.col("reason").isNotNull()).select("event_id", "received_at", "reason")
    ok = tagged.filter(F.col("reason").isNull())
    ok = attach_user(ok, sessions)
    ok = attach_region(ok, regions, home, country="country", code="region")
    search = ok.select(
        F.col("event_id").alias("id"),
        "visitor_id",
        F.col("session_user_id").alias("user_id"),
        "term",
        F.lower("term").alias("term_norm"),
        F.col("results").alias("results_cnt"),
        truncate("path", 500).alias("page_path"),
        F.col("country").alias("country_code"),
        F.col("region_name_lookup").alias("region_name"),
        F.col("received_at").alias("searched_at"),
    )
    return search, quarantine
