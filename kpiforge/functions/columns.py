"""Scalar column helpers.

All of them build JVM-side expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_ts(value: dt.datetime | dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal, independent of the Python process time zone."""
    if isinstance(value, dt.datetime):
        text = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = f"{value.isoformat()} 00:00:00"
    else:
        text = value
    return F.lit(text).cast("timestamp_ntz")


def lit_date(value: dt.date | str) -> Column:
    text = value.isoformat() if isinstance(value, dt.date) else value
    return F.lit(text).cast("date")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_label(c: Column | str, unspecified: str | None = None) -> Column:
    """Blank-is-NULL label: ``nullif(trim(c), '')``, optionally defaulted.

    The source system treats '' as NULL, so a label of spaces shows as the
    "unspecified" label.  Non-string columns are rendered as text first.
    """
    text = F.nullif(F.trim(_col(c).cast("string")), F.lit(""))
    return text if unspecified is None else F.coalesce(text, F.lit(unspecified))


def truncate(c: Column | str, width: int) -> Column:
    """First ``width`` characters (SUBSTR(c, 1, n))."""
    return F.substring(_col(c), 1, width)


def null_safe_concat(*parts: Column | str) -> Column:
    """Concatenation where NULL counts as '' (the ``||`` of the source system)."""
    return F.concat(*[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])


def html_escape(c: Column | str) -> Column:
    """Escape & < > " for HTML text; '&' first so entities are not doubled."""
    out = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


def age_years(birth: Column | str, as_of: dt.date | dt.datetime) -> Column:
    """Whole years between a birth date and ``as_of`` (both truncated to dates).

    floor(months_between(as_of, birth) / 12) with roundOff off, so the month
    fraction is exact.
    """
    day = as_of.date() if isinstance(as_of, dt.datetime) else as_of
    return F.floor(F.months_between(lit_date(day), F.to_date(_col(birth)), False) / 12).cast("int")


def display_name(full_name: Column | str, username: Column | str, fallback: str | None = None) -> Column:
    """The first of full name, username and ``fallback`` that is there; '' counts as missing."""
    parts = [F.nullif(_col(c), F.lit("")) for c in (full_name, username)]
    return F.coalesce(*parts, *([F.lit(fallback)] if fallback is not None else []))


def pairs_to_arrays(arr: Column | str) -> tuple[Column, Column]:
    """Split an array of {label, value} structs into a labels array and a values array."""
    a = _col(arr)
    return F.transform(a, lambda x: x["label"]), F.transform(a, lambda x: x["value"])
