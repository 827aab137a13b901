"""Long documents as ordered parts with offsets, in place of one collected text.

A document is a table of pieces in a known order.  ``document_parts`` deals them by
ranges of that order, adds up their lengths in every range, carries the sums over from the
ranges before, and joins neighbouring pieces into parts of bounded size.  No task holds
more than a range's lengths or one part's texts, however long the document is; the
parts, written one after the other, are the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Bytes of a part: pieces that start within so many bytes of each other stand together.
PART_BYTES = 1 << 20


def with_commas(pieces: DataFrame, section: str, listed: str, order: list[str]) -> DataFrame:
    """Put a comma before every listed piece but the first of its section (one aggregate row per section)."""
    first = pieces.filter(listed).groupBy(section).agg(F.min(F.struct(*order)).alias("_first"))
    later = F.col(listed) & (F.struct(*order) > F.col("_first"))
    return pieces.join(F.broadcast(first), section, "left").withColumn(
        "text", F.concat(F.when(later, F.lit(",")).otherwise(F.lit("")), F.col("text"))).drop("_first")


def document_parts(pieces: DataFrame, order: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(part, offset, text) of the pieces' ``text`` in ``order`` (unique): ``offset`` is where the part starts, in bytes."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size: Column = F.octet_length("text").cast("long")
    dealt = pieces.repartitionByRange(tasks, *order).select(*order, "text", size.alias("_size"), F.spark_partition_id().alias("_range"))
    dealt = materialize(dealt, "document-pieces")
    sums = dealt.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    # One row per range: its start is the sum of those before it.
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(F.broadcast(starts.select("_range", "_start")), "_range")
    placed = placed.select("text", (F.col("_start") + F.col("_local")).alias("offset"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "text"))), lambda x: x["text"]), "")
    return placed.groupBy(F.expr(f"offset div {part_bytes}").alias("part")).agg(F.min("offset").alias("offset"), joined.alias("text"))
