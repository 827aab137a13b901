"""Helpers shared by the corpus operators.

``pick`` isolates an operator from extra or clashing columns; ``running_totals``
is the distributed prefix sum behind mixing, sharding and block building;
``components`` labels connected components without collecting links;
``filter_bits`` and ``may_match`` keep rows without a partner out of a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.session import materialize

#: Bytes of rows handed to a Python worker at a time.
BATCH_BYTES = 16 << 20
#: Bits of the filter that keeps most rows without a partner out of a shuffle; a row of its table holds 64.
FILTER_BITS = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name (the first, if one is repeated).

    Other columns, also those that differ only in case or repeat a name, are
    dropped by position, so they can never make a reference ambiguous.
    """
    at = [df.columns.index(n) for n in names]
    renamed = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return renamed.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(at, names)])


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes, so that long rows cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """The fifth of the documents that no model may learn from (NULL ids hash as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def running_totals(df: DataFrame, by: list[str], order: list[str], weight: str, out: str, name: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the earlier rows of the same ``by``.

    Rows are dealt by ranges of (by, order), a tie-breaking number included, so
    neither a large group nor a long run of equal rows stays in one task.  Each
    range sums locally; the offsets of the ranges come from a table with one row
    per range and group.  ``by`` columns must not be NULL.  An empty input gives
    an empty result.
    """
    spark = df.sparkSession
    dealt = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *by, *order, "_tie")
        .withColumn("_part", F.spark_partition_id())
    )
    dealt = materialize(dealt, name)
    sums = dealt.groupBy("_part", *by).agg(F.sum(weight).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *by, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_part", *by).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_local", F.coalesce(F.sum(weight).over(local), F.lit(0)))
    total = (F.col("_local") + F.col("_offset")).alias(out)
    return rows.join(offsets, ["_part", *by]).select(*df.columns, total)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the links (a, b): rows (id, comp), comp the smallest id.

    Alternates large-star and small-star contraction, each step written to the shared
    folder, until every id has one smaller neighbour.  The links are trees by then, and
    each round points every id at its parent's parent, until all parents are roots.
    Either step leaves no more links than it finds.  Ids without a link to another id
    are absent.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    links = materialize(links, name)
    while True:
        least, trees = _least(links, name)
        if trees:
            break
        # Large star: the larger neighbours of an id are linked with the smallest one instead.
        large = materialize(_moved(links, least).select("u", F.coalesce("m", "v").alias("v")), name)
        least, trees = _least(large, name)
        if trees:
            break
        # Small star: so are the smaller neighbours of an id, and the id itself.
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.distinct(), name)
    links = least.select("u", F.col("m").alias("v"))
    while True:
        links = _moved(links, links.select("u", F.col("v").alias("m")))
        links = materialize(links.select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")), name)
        if links.filter("moved").isEmpty():
            break
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
        roots.select("id", F.col("id").alias("comp"))
    )


def _least(links: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """(u, m): the smallest of each id's smaller neighbours; whether no id has several of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), (F.min("v") < F.max("v")).alias("several"))
    least = materialize(least, name)
    return least.drop("several"), least.filter("several").isEmpty()


def _moved(links: DataFrame, least: DataFrame) -> DataFrame:
    """``links`` (u, v) with m: what ``least`` has for v, if anything."""
    return links.join(least.withColumnRenamed("u", "v"), "v", "left")


def filter_bits(wanted: DataFrame) -> DataFrame:
    """(_word, _bits): a hash bit for each row of ``wanted`` (all of its columns), at most FILTER_BITS / 64 rows."""
    at = wanted.select(F.pmod(F.xxhash64(*wanted.columns), F.lit(FILTER_BITS)).alias("_bit"))
    word, bit = F.shiftright("_bit", 6).cast("int"), F.expr("shiftleft(1L, cast(_bit & 63 as int))")
    return at.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def may_match(df: DataFrame, keys: list[Column], bits: DataFrame, out: str) -> DataFrame:
    """Add ``out``: false for rows whose ``keys`` no row behind ``filter_bits`` has; of the others some are true as well.

    ``keys`` need the types of the wanted columns.  The filter may be broadcast whatever the corpus, since its size
    is bounded; a corpus that fills it only has more rows that pass.  An exact join must follow for those.
    """
    tried = df.withColumn("_bit", F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)))
    tried = tried.join(F.broadcast(bits), F.shiftright("_bit", 6).cast("int") == F.col("_word"), "left")
    found = F.expr("shiftright(_bits, cast(_bit & 63 as int)) & 1 = 1")
    return tried.withColumn(out, F.coalesce(found, F.lit(False))).drop("_bit", "_word", "_bits")
