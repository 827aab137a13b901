"""Ordered per-key scans that stay parallel when one key is huge.

``Window.partitionBy(key)`` sends every row of a key to one task; with a key
holding a third of all rows that task holds a third of the data.  Here the
window is partitioned by (key, chunk), where the chunk is a range of the
ordering (a sequence-number block or a calendar day), and the one value that
crosses a chunk border (the previous row of each chunk's first row, or the
next row of its last row) is carried in from a per-chunk summary that has one
row per (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_CHUNK = 1 << 20


def chunk_of(order: Column, size: int) -> Column:
    """Chunk number of an integer ordering column (sequence number)."""
    return F.floor(order / F.lit(size)).cast("bigint")


def keyed_lag(df: DataFrame, key: str, order: str | list[str], value: str | Column, out: str,
              chunk_size: int = DEFAULT_CHUNK, chunk: Column | None = None, lead: bool = False,
              materialize_result: bool = True) -> DataFrame:
    """Add ``out`` = lag (or lead) of ``value`` over rows of ``key`` sorted by ``order``.

    ``order`` (one column or several) must be unique within a key, and the
    chunk must be monotone in it.  Default chunk: blocks of ``chunk_size`` of
    the first order column (an integer).  Only the edge row of each chunk
    takes its value from the neighbouring chunk's summary.  The windowed
    rows are written once (``session.materialize``) because three branches
    read them.
    """
    cols = [order] if isinstance(order, str) else list(order)
    ch = chunk if chunk is not None else chunk_of(F.col(cols[0]), chunk_size)
    val = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_chunk", ch).withColumn("_v", val)
    w = Window.partitionBy(key, "_chunk").orderBy(*cols)
    d = d.withColumn(out, (F.lead if lead else F.lag)("_v").over(w))
    d = d.withColumn("_edge", ((F.lead if lead else F.lag)(F.lit(1)).over(w)).isNull())
    if materialize_result:
        # the windowed rows feed three branches below; compute them once
        d = materialize(d, "keyed-lag")
    ordering = F.struct(*cols)
    ends = d.groupBy(key, "_chunk").agg(
        (F.min_by("_v", ordering) if lead else F.max_by("_v", ordering)).alias("_end"))
    wc = Window.partitionBy(key).orderBy("_chunk")
    carry = ends.select(key, "_chunk", (F.lead("_end") if lead else F.lag("_end")).over(wc).alias("_carry"))
    edges = (d.filter("_edge").drop(out).join(carry, [key, "_chunk"], "left")
             .withColumnRenamed("_carry", out))
    inner = d.filter(~F.col("_edge"))
    return inner.unionByName(edges).drop("_chunk", "_edge", "_v")


def keyed_last_before(df: DataFrame, key: str, order: str | list[str], value: str | Column, out: str,
                      chunk_size: int = DEFAULT_CHUNK, chunk: Column | None = None) -> DataFrame:
    """Add ``out`` = the last non-NULL ``value`` strictly before each row of ``key``.

    Inside a (key, chunk) window: ``last(value, ignorenulls)`` over the rows
    before.  Rows with nothing earlier in their chunk take the last non-NULL
    value of the earlier chunks, from a per-(key, chunk) summary scanned in
    chunk order (one row per chunk, not per event).
    """
    cols = [order] if isinstance(order, str) else list(order)
    ch = chunk if chunk is not None else chunk_of(F.col(cols[0]), chunk_size)
    val = F.col(value) if isinstance(value, str) else value
    d = df.withColumn("_chunk", ch).withColumn("_v", val)
    before = Window.partitionBy(key, "_chunk").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    d = materialize(d.withColumn("_in", F.last("_v", ignorenulls=True).over(before)), "keyed-last")
    # last non-NULL value of each chunk (NULL orderings are skipped by max_by)
    ends = d.groupBy(key, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*cols))).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "_chunk", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (d.join(carry, [key, "_chunk"], "left")
            .withColumn(out, F.coalesce(F.col("_in"), F.col("_carry")))
            .drop("_chunk", "_v", "_in", "_carry"))


#: Aggregates that ``keyed_running`` can carry: how two neighbouring stretches combine, and the value of none.
_FOLDS = {
    "sum": (F.sum, lambda a, b: a + b),
    "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
}


def keyed_running(df: DataFrame, key: str, order: str | list[str], folds: dict[str, tuple[str, str]], chunk: Column) -> DataFrame:
    """Add running folds over the rows of ``key`` in ``order``, the current row included.

    ``folds``: out -> (aggregate, bigint column), aggregates ``sum`` or ``bit_xor``; NULL values count as none.
    ``chunk`` must be monotone in the order.  Inside a (key, chunk) the fold is a window; what
    earlier chunks add comes from one row per (key, chunk), so no task sees a whole key.
    """
    cols = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_chunk", chunk)
    here = Window.partitionBy(key, "_chunk").orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    none, totals, carry, local, out = F.lit(0).cast("bigint"), [], [], {}, {}
    for name, (how, value) in folds.items():
        fold, join = _FOLDS[how]
        totals.append(fold(value).alias(name))
        carry.append(F.coalesce(fold(name).over(earlier), none).alias(f"_c{name}"))
        local[name] = F.coalesce(fold(value).over(here), none)
        out[name] = join(F.col(name), F.col(f"_c{name}"))
    per_chunk = d.groupBy(key, "_chunk").agg(*totals).select(key, "_chunk", *carry)
    return (d.withColumns(local).join(per_chunk, [key, "_chunk"]).withColumns(out)
            .drop("_chunk", *[f"_c{name}" for name in folds]))
