"""Benchmark decontamination by a prefix-filtered set join (operator 4); DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window).  The corpus is read once for every ``BLOCK_WINDOWS`` windows: its
``SHINGLE``-word shingles meet those of the benchmark in broadcast joins, and every
meeting is written with the words around it.  The number of meetings is the shingle's frequency in all documents.  A
window can only occur where its rarest shingle occurs: for full containment the
necessary prefix of its shingles, ordered from rare to common, has length one.  So
each window is looked up by that one shingle; the place less the shingle's offset
is a candidate start, which must leave room before and behind (positional and
length bounds), and there the words themselves are compared.

The corpus is never shuffled, and the benchmark side is broadcast in blocks of at
most ``BLOCK_WINDOWS`` windows, one join per block, so what is broadcast is bounded
for any benchmark.  Items of fewer words than a shingle are looked up whole, in a
pass of their own.

Edge cases: NULL and empty texts and items have no words and no windows; a
document without words is not contaminated; NULL ids are kept as they are
(rows with equal id and equal text share one result each, also if repeated);
equal windows of several items are looked up once and count for each item;
repeated item ids count once; items with a NULL id are hit like all others but stay
out of n_items and items_sha256; an empty benchmark hits
nothing and an empty corpus gives an empty result.  Only ``doc_id`` and ``text``,
``item_id`` and ``text`` are read, so extra columns do not matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import pick
from kpiforge.session import materialize, scratch

#: What stands between words (after lower-casing A-Z): ASCII characters but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 4
#: Windows (each at most 13 words here) that one broadcast join holds.
BLOCK_WINDOWS = 50_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; plain ``lower`` where the text is ASCII, which is much faster."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(slow)


def words(text: Column) -> Column:
    # Splitting is some ten times as fast as extracting; it may leave an empty word at either end.
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), BETWEEN), ""), F.array().cast("array<string>"))


def shingle_at(w: str, pos: str, n: int) -> Column:
    """Hash of the n words of array ``w`` from ``pos`` (from 0); evaluated per row inside generated code."""
    return F.xxhash64(*[F.get(F.col(w), F.col(pos) + i) for i in range(n)])


def windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(window_id, w): the distinct windows; (window_id, item_id): the items that have them."""
    items = pick(benchmark, "item_id", "text").select("item_id", words(F.col("text")).alias("iw"))
    items = items.filter(F.size("iw") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("iw") - window + 1, F.lit(1)))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("iw", i, window))).alias("w"))
    each = materialize(each.withColumn("window_id", F.md5(F.array_join("w", " "))).distinct(), "bench-windows")
    return each.select("window_id", "w").distinct(), each.select("window_id", "item_id").distinct()


def meetings(docs: DataFrame, wins: DataFrame, size: int, reach: int) -> DataFrame:
    """(doc_id, text_key, pos, shingle, before, around) wherever a shingle of ``wins`` occurs.

    ``around`` holds up to ``reach`` words either side of the place, ``before`` of them ahead of it.
    """
    n_blocks = max(1, -(-wins.count() // BLOCK_WINDOWS))
    parts = wins.withColumn("block", F.pmod(F.xxhash64("window_id"), F.lit(n_blocks)))
    parts = parts.select("block", "w", F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("pos"))
    keys = parts.select(shingle_at("w", "pos", size).alias("shingle"), "block").groupBy("shingle").agg(F.min("block").alias("block"))
    keys = materialize(keys, "bench-keys")
    at = docs.select("doc_id", "text_key", "dw", F.posexplode("dw").alias("pos", "_word"))
    at = at.withColumn("shingle", shingle_at("dw", "pos", size))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    around = F.slice("dw", first + 1, F.lit(2 * reach + size))
    out = None
    for b in range(n_blocks):
        met = at.join(F.broadcast(keys.filter(F.col("block") == b).select("shingle")), "shingle")
        met = met.filter(F.col("pos") + size <= F.size("dw"))
        met = met.select("doc_id", "text_key", "pos", "shingle", (F.col("pos") - first).alias("before"), around.alias("around"))
        out = met if out is None else out.unionByName(met)
    return materialize(out, "bench-meetings")


def occurrences(docs: DataFrame, wins: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, start, end, window_id): every place where a window occurs."""
    wins = materialize(wins.withColumn("n", F.size("w")), "bench-sized")
    sizes = [r.size for r in wins.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect()]
    out = None
    for size in sorted(sizes) or [SHINGLE]:  # at most SHINGLE passes; one unless there are shorter items
        mine = wins.filter(F.least("n", F.lit(SHINGLE)) == size)
        met = meetings(docs, mine, size, window)
        rarity = materialize(met.groupBy("shingle").count(), "bench-rarity")
        parts = mine.select("window_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset"))
        parts = parts.withColumn("shingle", shingle_at("w", "offset", size)).join(rarity, "shingle", "left")
        # A window with a shingle that occurs nowhere (its count is NULL) occurs nowhere.
        place = F.struct("count", "shingle", "offset")
        prefix = parts.groupBy("window_id", "n").agg(
            F.min_by(F.struct("shingle", "offset"), place).alias("p"), F.first("w").alias("w"), F.count("count").alias("known"), F.count("*").alias("all")
        )
        prefix = materialize(prefix.filter("known = all").select("window_id", "n", "w", "p.shingle", "p.offset"), "bench-prefix")
        found = met.join(prefix, "shingle").withColumn("start", F.col("pos") - F.col("offset")).filter("start >= 0")
        there = F.slice("around", F.col("before") - F.col("offset") + 1, F.col("n"))
        found = found.filter(there == F.col("w"))
        found = found.select("doc_id", "text_key", "start", (F.col("start") + F.col("n")).alias("end"), "window_id")
        out = found if out is None else out.unionByName(found)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) for every row."""
    text = F.col("text")
    rows = pick(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), words(text).alias("dw"))
    wins, of_items = windows(benchmark, window)
    # Equal (id, text) rows would only repeat each other's places: distinct() keeps one of each.
    places = materialize(occurrences(rows, wins, window).distinct(), "bench-places")
    key = ["doc_id", "text_key"]
    # Union of the intervals of a document: sorted by start, each adds what lies beyond the end so far.
    spans = places.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))

    def add(acc: Column, x: Column) -> Column:
        more = F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))
        return F.struct((acc["hit"] + more).alias("hit"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    hit = spans.select(*key, F.aggregate("spans", zero, add)["hit"].alias("n_hit"))
    items = places.select(*key, "window_id").distinct().join(materialize(of_items, "bench-items"), "window_id")
    names = F.sort_array(F.collect_set(F.col("item_id").cast("string")))
    items = items.groupBy(*key).agg(names.alias("items")).select(
        *key, F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    found = materialize(hit.join(items, [hit[c].eqNullSafe(items[c]) for c in key]).select(hit["*"], "n_items", "items_sha256"), "bench-found")
    found = found.withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_key", "_text")
    counted = rows.select("doc_id", "text_key", F.size("dw").cast("long").alias("n_words"))
    match = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, match, "left").select(
        "doc_id",
        "text_key",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    with scratch(docs.sparkSession) as keep:
        judged = judge(docs, benchmark).filter("contaminated").select(
            F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text")
        )
        bad = keep(judged.distinct(), "bench-bad")
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc, text = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text"))
    match = doc.eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_text"))
    return inner.join(bad, match, "left_anti").toDF(*names)
