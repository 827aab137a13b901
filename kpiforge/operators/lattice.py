"""A small lattice of base counts, from which dashboards derive their series and KPIs.

``base_counts`` counts a table by several sets of raw columns in one scan (one
``groupingSets`` aggregate with map-side partial counts) and writes the result,
which is as large as the distinct combinations, not as the table.  Series and KPIs
then add these counts up: labels are cleaned, filters applied and tops taken on
the base counts, so a dashboard scans each table a few times, not once per series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def base_counts(df: DataFrame, sets: dict[str, list[str]], measures: dict[str, Column], name: str) -> dict[str, DataFrame]:
    """For each set of columns the rows (columns, n, measures), all from one scan of ``df``."""
    columns = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    grouped = df.groupingSets([list(cols) for cols in sets.values()], *columns).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()], F.grouping_id().alias("_set"))
    table = materialize(grouped, name)

    def number(cols: list[str]) -> int:  # a bit per column, 1 where the set leaves it out
        return int("".join("0" if c in cols else "1" for c in columns), 2)

    return {key: table.filter(F.col("_set") == number(cols)).select(*cols, "n", *measures) for key, cols in sets.items()}


def total(counts: DataFrame, **columns: Column | None) -> DataFrame:
    """One row: for each name the number of rows counted where its condition holds (None: all)."""
    return counts.agg(*[F.coalesce(F.sum(F.col("n") if c is None else F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in columns.items()])
