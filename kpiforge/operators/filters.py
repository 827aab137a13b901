"""Named predicates.  Each returns a filtered DataFrame (or a Column for
composition) and is written so that Catalyst can push it to the Parquet scan
when it compares a raw column with a literal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import Calendar


def dim_filter(df: DataFrame, col: str) -> DataFrame:
    """B1: rows with a non-NULL grouping key."""
    return df.filter(F.col(col).isNotNull())


def country_scope(df: DataFrame, country: str, col: str = "country_code") -> DataFrame:
    """B2: one country only."""
    return df.filter(F.col(col) == country)


def since_days(df: DataFrame, ts: str, as_of, n: int) -> DataFrame:
    """``ts >= today - (n - 1)`` (a range predicate, pushed down)."""
    return df.filter(Calendar.of(as_of).since_days(F.col(ts), n))


def active_session(as_of) -> Column:
    """Active and not yet expired at ``as_of`` (a condition: it is only ever counted)."""
    return (F.col("is_active") == 1) & Calendar.of(as_of).after_now(F.col("expires_at"))


def published(df: DataFrame, year: int | None = None) -> DataFrame:
    """Published items, optionally of one year."""
    out = df.filter(F.col("is_published") == 1)
    return out if year is None else out.filter(F.col("year_no") == year)


def featured_with_figure(df: DataFrame) -> DataFrame:
    """Featured items that carry a headline figure."""
    return df.filter((F.col("is_featured") == 1) & F.col("figure_value").isNotNull())


def optional_equals(df: DataFrame, col: str, arg) -> DataFrame:
    """No filter when ``arg`` is None or 'all', else equality."""
    return df if arg is None or arg == "all" else df.filter(F.col(col) == arg)


def text_search(df: DataFrame, cols: list[str], needle: str | None) -> DataFrame:
    """Case-insensitive literal substring on any of ``cols`` (no wildcards, S26)."""
    if not needle:
        return df
    q = needle.lower()
    cond = None
    for c in cols:
        hit = F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False))
        cond = hit if cond is None else cond | hit
    return df.filter(cond)


def zero_results(df: DataFrame) -> DataFrame:
    """Searches that found nothing (NULL is not zero)."""
    return df.filter(F.col("results_cnt") == 0)


def valid_email(col: Column | str) -> Column:
    """Present and containing '@'."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.contains("@"), F.lit(False))


def registration_checks(df: DataFrame, email: str = "email", password_len: str = "password_len",
                        confirmation_matches: str = "confirmation_matches", username: str = "username") -> DataFrame:
    """The sign-up form rules as flags plus the list of failed rules.

    Works on the password *length* and an equality flag, never on the secret.
    """
    rules = {
        "email_invalid": ~valid_email(email),
        "password_short": F.coalesce(F.col(password_len) < 6, F.lit(True)),
        "confirmation_mismatch": ~F.coalesce(F.col(confirmation_matches), F.lit(False)),
        "username_short": F.coalesce(F.length(F.col(username)) < 3, F.lit(True)),
    }
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.withColumn("failed_rules", failed).withColumn("valid", F.size("failed_rules") == 0)


DEFAULTS = {
    "is_registered": 0, "status": "active", "source": "website", "display_order": 100, "is_published": 1,
    "year_no": 2025, "is_featured": 0,
}


def default_values(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Column DEFAULTs applied at intake (only for columns present)."""
    d = DEFAULTS if defaults is None else defaults
    out = df
    for c, v in d.items():
        if c in df.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)))
    return out


def min_term_length(df: DataFrame, n: int = 2, col: str = "term_norm") -> DataFrame:
    """Searches of at least ``n`` characters."""
    return df.filter(F.length(F.col(col)) >= n)


def drop_bots(df: DataFrame, agent_col: str, pattern: str) -> DataFrame:
    """Drop rows whose agent text matches ``pattern`` (the caller's rules)."""
    return df.filter(~F.coalesce(F.col(agent_col).rlike(pattern), F.lit(False)))
