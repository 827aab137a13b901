"""M1-M4: constraint checks as violation reports (Parquet enforces none)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def unique_violations(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """M1: key values held by more than one row; NULL keys are not constrained."""
    return (df.select(key.alias(name)).filter(F.col(name).isNotNull())
            .groupBy(name).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, derived: bool = False) -> DataFrame:
    """M2: child rows whose non-NULL key has no parent (left anti join).

    ``derived``: the parent is itself the result of joins or aggregates; its keys are then written first, so that the
    skew join can split a key that many children hold.
    """
    p = parent.select(F.col(parent_key).alias("_pk")).filter(F.col("_pk").isNotNull())
    p = materialize(p, "parent-keys") if derived else p
    c = child.filter(F.col(child_key).isNotNull())
    return c.join(p, c[child_key] == p["_pk"], "left_anti")


def not_null_violations(df: DataFrame, columns: list[str], row_id: str = "id") -> DataFrame:
    """M3: one row (row id, column) per NULL in a NOT NULL column."""
    cells = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("is_null")) for c in columns])).alias("_c"))
    return cells.filter("_c.is_null").select(row_id, F.col("_c.column").alias("column"))


def length_violations(df: DataFrame, widths: dict[str, int], row_id: str = "id") -> DataFrame:
    """M4: one row (row id, column, length, limit) per value longer than its column width."""
    cells = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.length(F.col(c)).alias("length"), F.lit(w).alias("limit"))
        for c, w in widths.items()])).alias("_c"))
    return cells.filter(F.col("_c.length") > F.col("_c.limit")).select(row_id, "_c.column", "_c.length", "_c.limit")
