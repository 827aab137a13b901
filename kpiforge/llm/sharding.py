"""Sharding by vector bin packing (operator 9).

Equal texts form a group.  A group is a vector (bytes, words, rows); the groups
are placed one by one, large ones first, into the shard whose residual capacity
has the largest dot product with the vector.

What is placed is bounded whatever the corpus: groups above a fixed fraction of
a shard are placed by themselves (at most ``3 * shards * FINE`` of them fit in a
corpus) and, beyond a larger fraction, are cut into even pieces, so that a text
that makes up a third of the corpus is spread; all other groups fall by text hash into at most ``BUNDLES`` bundles.  Bytes weigh most in
the dot product: the law of the assignment is that the shards' byte sizes are
near equal, with rows and words balanced as far as that allows; a last pass moves
items from the fullest to the emptiest shard while that narrows the gap.

Edge cases: a NULL text has size 1 and is a group of its own kind, different from
the empty text; NULL ids and repeated rows are placed like all others; fewer
documents than shards leave shards empty; an empty table gives an empty result.
``assign`` reads ``doc_id`` and ``text`` only, so extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import pick, running_totals
from kpiforge.llm.mixing import n_words
from kpiforge.session import materialize

#: Bundles of small groups; a bundle is about shards / BUNDLES of a shard.
BUNDLES = 16_384
#: A group above 1 / FINE of a shard in any dimension is placed by itself.
FINE = 64
#: A group stays whole up to 1 / SPLIT of a shard and is cut into pieces beyond.
SPLIT = 8
#: Weights of bytes, words and rows in the dot product.
IMPORTANCE = (4.0, 1.0, 1.0)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, words, rows); the items are a bounded table."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1.0)
    weighted = share * np.array(IMPORTANCE)
    residual = np.full((shards, items.shape[1]), 1.0 / shards)
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = at = int((residual @ weighted[i]).argmax())
        residual[at] -= share[i]
    return _even_bytes(items[:, 0], out, shards)


def _even_bytes(size: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Move items from the fullest to the emptiest shard while that narrows the gap in bytes."""
    load = np.bincount(shard, weights=size, minlength=shards)
    for _ in range(4 * len(size)):
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        mine = np.flatnonzero(shard == high)
        best = mine[np.abs(size[mine] - gap / 2).argmin()] if len(mine) else None
        if best is None or size[best] >= gap:
            break
        shard[best] = low
        load[high] -= size[best]
        load[low] += size[best]
    return shard


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, n_words, shard, slot) for every row; slots run from 0 in each shard."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        n_words(text).alias("n_words"),
        F.md5(F.coalesce(text, F.lit("\\x00null")).cast("binary")).alias("group"),
    )
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("int"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("group", "bundle").agg(
        F.sum("size").alias("b"), F.sum("n_words").alias("w"), F.count("*").alias("r")
    )
    groups = materialize(groups, "shard-groups")
    total = groups.agg(F.sum("b"), F.sum("w"), F.sum("r")).first()
    share = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(c) * (shards / t) for c, t in zip("bwr", total) if t])
    # At most 3 * shards * FINE groups are large, and their pieces are at most 3 * shards * SPLIT more: a bounded table.
    large = groups.withColumn("share", share).filter(F.col("share") >= 1 / FINE)
    large = large.withColumn("parts", F.ceil(F.col("share") * SPLIT))
    large = materialize(large.withColumn("parts", F.least("parts", "r").cast("int")), "shard-large")
    alone = []  # (group, piece, bytes, words, rows); a group's rows are alike, so the pieces' sizes are exact
    for g in large.orderBy("group").collect():
        for i in range(g.parts):
            n = -(-(i + 1) * g.r // g.parts) - -(-i * g.r // g.parts)
            alone.append((g.group, i, g.b / g.r * n, g.w / g.r * n, n))
    small = groups.join(F.broadcast(large.select("group")), "group", "left_anti")
    bundles = small.groupBy("bundle").agg(F.sum("b"), F.sum("w"), F.sum("r")).orderBy("bundle").collect()
    items = [a[2:] for a in alone] + [tuple(b)[1:] for b in bundles]
    shard = place(np.array(items, float).reshape(-1, 3), shards).tolist()
    to_large = spark.createDataFrame(
        [(g, i, s) for (g, i, *_), s in zip(alone, shard)], "group string, piece int, shard int"
    )
    to_bundle = spark.createDataFrame(
        [(b.bundle, s) for b, s in zip(bundles, shard[len(alone) :])], "bundle int, shard int"
    )
    rows = rows.withColumn("one", F.lit(1))
    in_large = rows.join(F.broadcast(large.select("group", "parts", "r")), "group")
    ranked = running_totals(in_large, ["group"], ["doc_id"], "one", "rank", "shard-pieces")
    ranked = ranked.withColumn("piece", F.floor(F.col("rank") * F.col("parts") / F.col("r")).cast("int"))
    columns = ["doc_id", "size", "text_crc32", "n_words", "shard", "one"]
    placed = ranked.join(F.broadcast(to_large), ["group", "piece"]).select(*columns)
    in_small = rows.join(F.broadcast(large.select("group")), "group", "left_anti")
    placed = placed.unionByName(in_small.join(F.broadcast(to_bundle), "bundle").select(*columns))
    order = ["doc_id", "text_crc32", "size"]
    return running_totals(placed, ["shard"], order, "one", "slot", "shard-slots").drop("one")
