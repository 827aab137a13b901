"""Mixing sources to target weights (operator 5).

The corpus is resampled so that each source comes near its target number of
words.  Targets share the size of the whole corpus by weight; a source stops at
``max_epochs`` times its size and what it cannot take is shared again among the
others.  Every document gets a hash-random key; the documents of a source are
range-sorted by it, distributed prefix sums place each on the source's word
line, and the line is cut at the exact budget: whole epochs first, then the
documents before the cut once more, the one at the cut in part.

Edge cases: a NULL text has size 0 (taken 0); a NULL source is a source of its
own, after all others; an empty source ('') is an ordinary one; repeated rows
are taken one by one; documents with a NULL id take part; a corpus without words
has targets 0; an empty table gives an empty result.  ``mix`` reads ``doc_id``,
``text`` and ``source`` only, so extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import pick, running_totals
from kpiforge.session import materialize

BETWEEN = r"[\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Budgets are whole words; a target this close below a whole number counts as it.
_ROUNDING = 1e-6


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(words(text))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(no_source, source_name, source_size) -> the same with weight and target.

    The level is raised until the capped sources no longer change: a source is
    capped when level * weight reaches ``max_epochs`` times its size.  Each round
    reads one row of sums; the set of capped sources only grows.
    """
    at = running_totals(sizes.withColumn("one", F.lit(1)), [], ["no_source", "source_name"], "one", "place", "mix-sources")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = materialize(at.select("no_source", "source_name", "source_size", share.alias("weight")), "mix-weights")
    cap = F.col("source_size").cast("double") * max_epochs
    level, capped = 0.0, -1
    while True:
        full = cap <= F.col("weight") * level if capped >= 0 else F.lit(False)
        total, taken, free, n = ranked.agg(
            F.sum("source_size"),
            F.sum(F.when(full, cap).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))),
            F.sum(full.cast("int")),
        ).first()
        if not total or not free or n == capped:
            break
        level, capped = (total - taken) / free, n
    return ranked.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(doc_id, source, text_key, size, source_size, target, taken) for every row."""
    rows = pick(docs, "doc_id", "text", "source").select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_name"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("text_key"),
    )
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text_key"))
    by = ["no_source", "source_name"]
    placed = running_totals(rows, by, ["key", "doc_id", "text_key"], "size", "before", "mix")
    placed = materialize(placed, "mix-placed")
    sizes = placed.groupBy(*by).agg(F.sum("size").alias("source_size"))
    # One row per source: written by targets(), so the join below shuffles it plainly and a hot source can be split.
    goal = targets(sizes, weights, max_epochs)
    budget = F.floor(F.col("target") + _ROUNDING)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.join(goal, by).select(
        "doc_id",
        F.when(~F.col("no_source"), F.col("source_name")).alias("source"),
        "text_key",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + part).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row per epoch, the copy at a cut shortened to its first words.

    Documents are found by id, source and text.  Rows equal in all three are
    interchangeable and share what is taken of them evenly, the first ones (in the
    order of a hash of all columns) a word more where it does not divide.  Rows of
    which nothing is taken, and so all without words, stay out.  A shortened text is its words joined by one
    space; a column ``n_chars`` follows it.
    """
    names = docs.columns
    inner = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc, text, source = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text", "source"))
    same = ["doc_id", "source", "text_key", "size"]
    # Rows of which nothing is taken are counted, too: they are among those that share.
    takes = mixed.groupBy(*same).agg(F.sum("taken").alias("all"), F.count("*").alias("n")).filter("all > 0")
    takes = takes.select(*same, F.expr("all div n").alias("each"), (F.col("all") % F.col("n")).alias("more"))
    takes = takes.toDF("_doc", "_source", "_text", "_size", "_each", "_more")
    # Two tables: few takes do not divide, so the join with those is a broadcast and the texts are shuffled once.
    even, odd = (materialize(takes.filter(c), "mix-takes") for c in ("_more = 0", "_more > 0"))
    match = doc.eqNullSafe(F.col("_doc")) & source.eqNullSafe(F.col("_source")) & (F.xxhash64(text) == F.col("_text"))
    joined = inner.join(even, match)
    uneven = inner.join(odd, match).withColumns({"_group": F.xxhash64("_doc", "_source", "_text"), "_hash": F.xxhash64(*inner.columns), "_one": F.lit(1)})
    uneven = running_totals(uneven, ["_group"], ["_hash"], "_one", "_before", "mix-uneven")
    uneven = uneven.withColumn("_each", F.col("_each") + F.when(F.col("_before") < F.col("_more"), 1).otherwise(0))
    joined = joined.unionByName(uneven.select(joined.columns))
    rest = F.col("_each") % F.col("_size")
    copies = F.floor(F.col("_each") / F.col("_size")) + F.when(rest > 0, 1).otherwise(0)
    rows = joined.filter("_each > 0").withColumn("_rest", rest)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))))
    last = F.col("_copy") > F.floor(F.col("_each") / F.col("_size"))
    begin = F.slice(words(text), F.lit(1), F.col("_rest").cast("int"))
    cut = F.when(last, F.array_join(begin, " ")).otherwise(text)
    out = {f"_c{i}": F.col(f"_c{i}") for i in range(len(names))}
    out[f"_c{names.index('text')}"] = cut
    if "n_chars" in names:
        at = f"_c{names.index('n_chars')}"
        out[at] = F.when(last, F.length(cut)).otherwise(F.col(at)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(k) for k, c in out.items()]).toDF(*names)
