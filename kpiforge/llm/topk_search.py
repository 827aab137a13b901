"""Exact top-k search over quantised vectors with an impact-ordered index (operator 7).

Components are quantised to ``floor(256 * x)``; the score is the integer inner
product.  The index is built in blocks of ``BLOCK_ROWS`` vectors.  A block keeps
every dimension as two posting segments, a coarse plane (the component without
its last ``FINE_BITS`` bits) and a fine plane (those bits), with the smallest and
largest value of each.  For a query the impact of a segment is the spread of what
it can add to a score; segments are processed score at a time, in rounds of
descending impact, for all queries of a batch at once.  After each round every
vector has a lower and an upper bound from the segments still to come.  A query
leaves the traversal only when this proves that few vectors can still be among
its k best; those, all of them, are rescored exactly (if the proof never comes,
all segments are processed).  The best k of all blocks are merged by Spark.

Queries come in blocks as well, and an index block meets a query block in one
task, so neither side is ever whole in one place.

Edge cases: vectors that are NULL or hold a NULL or non-finite component, and
rows with a NULL id, take no part; an empty vector scores 0; vectors of unequal
length are compared as if padded with zeros; rows equal in id and vector count
once; a query never finds rows with its own id; fewer than k candidates are all
returned; ties go to the smaller id; an empty table gives an empty result.  Only
``vec_id`` and ``embedding`` are read, so extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import pick, running_totals
from kpiforge.session import materialize

SCALE = 256
#: Vectors of an index block, and queries of a query block.
BLOCK_ROWS = 16_384
QUERY_ROWS = 1024
#: Bits of a component in the fine plane.
FINE_BITS = 3
#: Segments per round, and queries processed together.
ROUND, BATCH = 64, 128
#: Rescore as soon as no more than this part of a block (one in FEW) can still be members.
FEW = 64


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): the rows that take part, components as whole numbers."""
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = pick(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, fine))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.select("vec_id", q.alias("q")).distinct()


def _packed(rows: DataFrame, block_rows: int, name: str) -> DataFrame:
    """One row per block, in id order: ids and components as a matrix padded with zeros."""
    numbered = running_totals(rows.withColumn("one", F.lit(1)), [], ["vec_id"], "one", "place", name)
    numbered = numbered.withColumn("block", F.floor(F.col("place") / block_rows).cast("int"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        m = np.zeros((len(group), max(map(len, group["q"]))), np.int64)
        for i, q in enumerate(group["q"]):
            m[i, : len(q)] = q
        row = {"block": group["block"].iloc[0], "n": len(group), "ids": group["vec_id"].to_numpy(np.int64).tobytes()}
        return pd.DataFrame([row | {"m": m.tobytes()}])

    return materialize(numbered.groupBy("block").applyInPandas(pack, "block int, n int, ids binary, m binary"), name)


class IndexBlock:
    """The posting segments of one block: row j of ``planes`` is dimension j's coarse, row d + j its fine plane."""

    def __init__(self, n: int, m: bytes):
        self.n = n
        self.m = np.frombuffer(m, np.int64).reshape(n, -1)
        self.dims = self.m.shape[1]
        coarse = self.m >> FINE_BITS << FINE_BITS
        self.planes = np.concatenate([coarse, self.m - coarse], axis=1).T
        self.high = self.planes.max(axis=1) if n else np.zeros(2 * self.dims, np.int64)
        self.low = self.planes.min(axis=1) if n else np.zeros(2 * self.dims, np.int64)
        self.as_float: dict[type, np.ndarray] = {}

    def _number(self, q: np.ndarray) -> type | None:
        """A type that holds every partial score exactly."""
        most = float(np.abs(q).max(initial=0)) * float(np.abs(self.planes).max(initial=0)) * max(1, len(self.planes))
        return np.float32 if most < 2**24 else np.float64 if most < 2**53 else None

    def best(self, asked: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per row of ``asked`` the (positions, scores) of its k best rows, ties in id order."""
        q = np.zeros((len(asked), self.dims), np.int64)
        d = min(self.dims, asked.shape[1])
        q[:, :d] = asked[:, :d]
        number = self._number(q)
        if self.n <= k or not self.dims or number is None:
            return [self._exact(np.arange(self.n), x, k) for x in q]
        planes = self.as_float.setdefault(number, self.planes.astype(number))
        both = np.concatenate([q, q], axis=1)
        most = np.maximum(both * self.high, both * self.low)
        least = np.minimum(both * self.high, both * self.low)
        turn = np.argsort(least - most, axis=1, kind="stable")
        gathered = np.zeros((len(q), self.n), number)
        out: list = [None] * len(q)
        open_ = np.arange(len(q))
        for start in range(0, both.shape[1], ROUND):
            now = np.zeros((len(open_), both.shape[1]), bool)
            np.put_along_axis(now, turn[open_, start : start + ROUND], True, axis=1)
            rows = np.flatnonzero(now.any(axis=0))
            gathered[open_] += np.where(now, both[open_], 0)[:, rows].astype(number) @ planes[rows]
            most[open_] = np.where(now, 0, most[open_])
            least[open_] = np.where(now, 0, least[open_])
            last, still = start + ROUND >= both.shape[1], []
            for i in open_:
                theta = np.partition(gathered[i], self.n - k)[self.n - k] + least[i].sum()
                members = np.flatnonzero(gathered[i] + most[i].sum() >= theta)
                if last or len(members) <= max(self.n // FEW, k):
                    out[i] = self._exact(members, q[i], k)
                else:
                    still.append(i)
            open_ = np.array(still, np.int64)
            if not len(open_):
                break
        return out

    def _exact(self, rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.m[rows] @ q
        take = np.lexsort((rows, -scores))[:k]  # rows stand in id order, so position breaks ties by id
        return rows[take], scores[take]


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return _packed(quantised(vectors), block_rows, "topk-index")


def search(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the k best of every row of ``queries``."""
    blocks = _packed(quantised(queries), QUERY_ROWS, "topk-queries").toDF("q_block", "q_n", "q_ids", "q_m")
    n_blocks = blocks.count()
    if n_blocks == 0:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    meet = index.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "q_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                block, ids = IndexBlock(r.n, r.m), np.frombuffer(r.ids, np.int64)
                query_ids, asked = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_m, np.int64).reshape(r.q_n, -1)
                # A query's own rows may be among the best: look for that many more and drop them.
                own = np.searchsorted(ids, query_ids, "right") - np.searchsorted(ids, query_ids, "left")
                for at in range(0, r.q_n, BATCH):
                    part = slice(at, at + BATCH)
                    best = block.best(asked[part], k + int(own[part].max()))
                    frames = []
                    for query_id, (rows, scores) in zip(query_ids[part], best):
                        keep = np.flatnonzero(ids[rows] != query_id)[:k]
                        frames.append((np.full(len(keep), query_id), ids[rows[keep]], scores[keep]))
                    columns = [np.concatenate(c) for c in zip(*frames)]
                    yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns)))

    rows = meet.repartition(F.col("block"), F.col("q_block")).mapInPandas(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
