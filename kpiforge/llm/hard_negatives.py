"""Hard negatives by Kronecker-packed products (operator 12).

Components are quantised to ``floor(256 * x)``; the score of two rows is the integer
inner product.  For each anchor and each of its positives (the best rows of its label)
the hard negatives are the best rows of other labels whose score is at most, and not
far below, that of the positive.

Scores come from packed products: the components of several candidates are put as signed
digits into separate fields of one wide integer, wide enough for the whole sum; one
multiplication per anchor component then serves all of them, and the sums are read off the
fields, so every score is exact.  How large a sum can get is bounded by the components and
by the lengths of the vectors, whichever says less.  Words are whole numbers below 2**53 in
doubles where the sums fit (a matrix product of them is exact, as no partial sum exceeds the
word), else 63-bit integers, else integers of any width.

Rows lie in blocks of bounded bytes in the order of (label, id).  Each task holds a bounded
part of the anchors, and a run of candidate blocks goes by: the anchors are a stated query
set against all rows.  A first pass finds the positives among the rows of an anchor's label,
a second one the negatives among all others, within the bounds that the positives' scores
set; so each pair is scored once.  The best rows met so far set the least score that still
counts for an anchor.  A field is unpacked only for anchors whose highest sum in it reaches
that score, and a task hands on a few rows per anchor, however many blocks it has met.

Edge cases: rows with a NULL id, label, vector, or with a NULL or non-finite component
take no part; of rows with equal ids the least by (label, vector) counts; vectors of
unequal length are compared as if padded with zeros, an empty one scores 0; ties go to
the smaller id; an anchor without positives, or a positive without negatives, gives no
rows; an empty table gives an empty result.  Only ``vec_id``, ``embedding`` and
``label`` are read, so extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, partitions, pick
from kpiforge.session import materialize

SCALE = 256
#: Bytes of a block of rows, of the anchors that a task holds and of the candidates that it meets, at 8 a component.
BLOCK_BYTES, ANCHOR_BYTES, GROUP_BYTES = 4 << 20, 32 << 20, 256 << 20
#: Candidates packed at a time, scores of a product, and rows found that may wait to be ranked.
CHUNK, PAIRS, WAITING = 2048, 1 << 20, 1 << 21
#: A product is crowded if more than one in so many of its scores count.
CROWDED = 32
#: Fields of a word of unlimited width.
WIDE_FIELDS = 16
#: Rows whose lengths are taken at a time.
BATCH = 1 << 12
#: Stand for no score and no id.
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): the rows that take part, one per id, components as whole numbers."""
    v = F.col("embedding")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = pick(vectors, "vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, fine))
    q = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    each = F.struct(F.col("label").cast("long").alias("label"), q.alias("q"))
    return rows.groupBy("vec_id").agg(F.min(each).alias("r")).select("vec_id", "r.label", "r.q")


def packed_blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` bytes in the order of (label, id): ids, labels, components padded with zeros, and ``scores`` if given.

    Components are kept in the fewest bytes (``width``) that hold those of the block; ``bytes`` is the size at 8 a component.
    """
    rows = rows if "scores" in rows.columns else rows.withColumn("scores", F.array().cast("array<long>"))
    dealt = rows.select("label", "vec_id", "q", "scores").repartitionByRange(partitions(rows.sparkSession), "label", "vec_id")

    def matrix(values: np.ndarray, lengths: np.ndarray, fill: int) -> np.ndarray:
        m = np.full((len(lengths), lengths.max(initial=0)), fill, np.int64)
        m[np.arange(m.shape[1]) < lengths[:, None]] = values
        return m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("vec_id", "label"))
            flat, lengths = zip(*((batch.column(c).flatten().to_numpy(), pc.list_value_length(batch.column(c)).to_numpy().astype(np.int64)) for c in ("q", "scores")))
            ends, at = [np.append(0, n.cumsum()) for n in lengths], 0
            while at < len(ids):
                padded = (np.maximum.accumulate(lengths[0][at:]) + 2) * np.arange(1, len(ids) - at + 1) * 8
                end = at + max(1, int(np.searchsorted(padded, size, "right")))
                m, scores = (matrix(flat[i][ends[i][at] : ends[i][end]], lengths[i][at:end], fill) for i, fill in ((0, 0), (1, LEAST)))
                low, high = int(m.min(initial=0)), int(m.max(initial=0))
                width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
                row = {"ids": ids[at:end].tobytes(), "labels": labels[at:end].tobytes(), "m": m.astype(f"i{width}").tobytes(), "scores": scores.tobytes()}
                yield pa.RecordBatch.from_pylist([row | {"width": width, "bytes": int(padded[end - at - 1])}], schema)
                at = end

    schema = pa.schema([(c, pa.binary()) for c in ("ids", "labels", "m", "scores")] + [("width", pa.int32()), ("bytes", pa.int64())])
    blocks = dealt.sortWithinPartitions("label", "vec_id").mapInArrow(run, "ids binary, labels binary, m binary, scores binary, width int, bytes long")
    return materialize(blocks.withColumn("block", F.monotonically_increasing_id()), name)


class Packed:
    """Candidates ready for products with anchors whose components lie in [low, high] and whose length is at most ``norm``."""

    def __init__(self, m: np.ndarray, low: int, high: int, norm: float = np.inf):
        self.m = m
        n, dims = m.shape
        most = max(1, dims) * max(1, -low, high) * max(1, -int(m.min(initial=0)), int(m.max(initial=0)))
        self.length = float(_lengths(m).max(initial=0))
        if np.isfinite(norm):
            most = min(most, int(norm * self.length) + 1)
        self.bits = most.bit_length() + 1
        if most < 1 << 53:
            self.fields, self.type = 1, np.float64
            while most * sum(1 << (self.bits * f) for f in range(self.fields + 1)) < 1 << 53:
                self.fields += 1
        elif self.bits <= 63:
            self.fields, self.type = 1, np.int64
        else:
            self.fields, self.type = WIDE_FIELDS, object
        kind = object if self.type is object else np.int64
        self.words = np.zeros((-(-n // self.fields), dims), kind)
        for f in range(self.fields):
            part = m[f :: self.fields].astype(kind)
            self.words[: len(part)] += part * (1 << (self.bits * f))
        self.words = np.ascontiguousarray(self.words.astype(self.type).T)

    def products(self, asked: np.ndarray, space: np.ndarray | None = None) -> np.ndarray:
        """For each row of ``asked`` the words of its inner products with all candidates, in ``space[0]`` if given (doubles only)."""
        if self.type is not np.float64:
            return asked.astype(self.type) @ self.words
        shape = len(asked), self.words.shape[1]
        whole, doubles = np.empty((2, math.prod(shape)), np.int64) if space is None else space[:2, : math.prod(shape)]
        product = np.matmul(asked.astype(np.float64), self.words, out=doubles.view(np.float64).reshape(shape))
        np.copyto(whole.reshape(shape), product, casting="unsafe")
        return whole.reshape(shape)

    def count(self, f: int) -> int:
        """The candidates in field ``f``: number f, f + fields, ..."""
        return len(range(f, len(self.m), self.fields))

    def field(self, words: np.ndarray, f: int) -> np.ndarray:
        """The scores in field ``f``; each field is a signed digit, so half a unit is added for those below."""
        at, half = self.bits * f, 1 << (self.bits - 1)
        if self.type is object:
            return ((words + sum(half << (self.bits * g) for g in range(self.fields)) >> at) & (2 * half - 1)) - half
        if f == self.fields - 1:
            return (words + (1 << at - 1)) >> at if f else words
        return ((words << (64 - at - self.bits)) + (1 << (63 - self.bits))) >> (64 - self.bits)

    def peaks(self, words: np.ndarray, f: int, space: np.ndarray) -> np.ndarray:
        """The highest score of each row in field ``f``; works in ``space[2]``."""
        if self.type is object:
            return self.field(words, f).max(axis=1)
        if f == self.fields - 1:
            return self.field(words.max(axis=1), f)
        low = np.left_shift(words, 64 - self.bits * (f + 1), out=space[2, : words.size].reshape(words.shape))
        return (low.max(axis=1) + (1 << (63 - self.bits))) >> (64 - self.bits)

    def unpacked(self, words: np.ndarray) -> np.ndarray:
        out = np.empty((len(words), len(self.m)), words.dtype)
        for f in range(self.fields):
            out[:, f :: self.fields] = self.field(words, f)[:, : self.count(f)]
        return out

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """The exact inner products of the rows of ``asked`` with all candidates."""
        return self.unpacked(self.products(asked))


def _lengths(m: np.ndarray) -> np.ndarray:
    """Of the rows, and not less."""
    return np.concatenate([np.sqrt(np.square(m[i : i + BATCH], dtype=np.float64).sum(axis=1)) for i in range(0, max(1, len(m)), BATCH)]) * (1 + 1e-9)


class Search:
    """The best candidates of anchors, which are in the order of their labels, as blocks of candidates go by.

    Each anchor has windows of scores [low, high] (two arrays, a column for each window); the best ``keep`` candidates of
    each window are kept.  ``same``: only candidates of the anchor's label count, else only those of other labels.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same: bool):
        self.ids, self.labels, self.m, self.low, self.high, self.keep, self.same = ids, labels, m, low, high, keep, same
        self.lengths, self.space = _lengths(m), np.empty((3, PAIRS), np.int64)
        self.span = int(m.min(initial=0)), int(m.max(initial=0)), float(self.lengths.max(initial=0))
        #: The least score that still counts in a window; and of candidates with just that score, only those with ids below ``last``.
        self.need, self.last = low.copy(), np.full(low.shape, MOST)
        self.found: list[tuple[np.ndarray, ...]] = [tuple(np.empty(0, np.int64) for _ in range(3))]
        self.waiting, self.serves = 0, np.empty((0, low.shape[1]), bool)

    def meet(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> None:
        """Candidates in the order of (label, id)."""
        m, at = m[:, : self.m.shape[1]], 0
        while at < len(ids):
            end = min(at + (CHUNK // 8 if self._open(labels[at]) else CHUNK), len(ids))
            run = int(np.searchsorted(labels[at:end], labels[at], "right"))
            end = at + run if run >= CHUNK // 8 else end
            first, last = np.searchsorted(self.labels, labels[at], "left"), np.searchsorted(self.labels, labels[end - 1], "right")
            if self.same:
                spans = [(first, last)]
            else:
                spans = [(0, first), (last, len(self.ids))] if labels[at] == labels[end - 1] else [(0, len(self.ids))]
            if any(a < b for a, b in spans):
                by_id = at + np.argsort(ids[at:end], kind="stable")
                met, step = (Packed(m[by_id], *self.span), ids[by_id], labels[by_id]), max(1, PAIRS // (end - at))
                need = self.need + (met[1][0] > self.last)
                need[need > self.high] = MOST
                least = need.min(axis=1)
                for a, b in spans:
                    for i in range(a, b, step):
                        rows = slice(i, min(i + step, b))
                        self._product(*met, i, need[rows], least[rows])
                        if self.waiting > WAITING:
                            self.settle()
                # What is kept is ranked anew each time, so not for a few.
                if self.waiting > max(2 * sum(max(0, b - a) for a, b in spans), len(self.found[0][0]) // 4):
                    self.settle()
            at = end

    def _open(self, label: int) -> bool:
        """Whether nearly every score still counts for most anchors of ``label``, so that few candidates should be met at first."""
        own = self.last[np.searchsorted(self.labels, label, "left") : np.searchsorted(self.labels, label, "right")]
        return self.same and 2 * np.count_nonzero(own == MOST) > own.size

    def _product(self, packed: Packed, ids: np.ndarray, labels: np.ndarray, a: int, need: np.ndarray, least: np.ndarray) -> None:
        """The candidates of ``packed``, which are in the order of their ids, against the anchors from ``a`` on that ``need`` has."""
        b = a + len(need)
        who = np.flatnonzero(least <= self.lengths[a:b] * packed.length + 1)
        if not len(who):
            return
        need, least, high, who = need[who], least[who], self.high[a:b][who], who + a
        asked = self.m[a:b] if len(who) == b - a else self.m[who]
        words, found, many = packed.products(asked[:, : packed.m.shape[1]], self.space), [], 0
        for f in range(packed.fields):
            near = np.flatnonzero(packed.peaks(words, f, self.space) >= least)
            if not len(near):
                continue
            scores = packed.field(words[near], f)[:, : packed.count(f)]
            hit = scores >= least[near, None]
            if np.count_nonzero(hit) * CROWDED > hit.size:
                hit = np.zeros(hit.shape, bool)
                for w in range(need.shape[1]):
                    hit |= (scores >= need[near, w, None]) & (scores <= high[near, w, None])
            row, column = np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))
            found.append((near[row], column * packed.fields + f, scores[row, column]))
            many += len(row)
        if not many:
            return
        row, column, score = (np.concatenate(x) for x in zip(*found))
        if many * CROWDED > words.shape[0] * len(ids):
            row, column, score = self._best(packed.unpacked(words), ids, labels, who, need, high)
        counts = ((labels[column] == self.labels[who[row]]) == self.same) & (ids[column] != self.ids[who[row]])
        self.found.append((who[row[counts]], ids[column[counts]], score[counts].astype(np.int64)))
        self.waiting += len(self.found[-1][0])

    def _best(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray, who: np.ndarray, need: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, column, score) of the best scores of each row and window; ties in the order of columns."""
        counts = ((labels == self.labels[who, None]) == self.same) & (ids != self.ids[who, None])
        n, chosen = scores.shape[1], np.zeros(scores.shape, bool)
        for w in range(need.shape[1]):
            fits = counts & (scores >= need[:, w, None]) & (scores <= high[:, w, None])
            if n > self.keep:
                inside = np.where(fits, scores, LEAST)
                bar = np.partition(inside, n - self.keep, axis=1)[:, n - self.keep, None]
                above, level = fits & (inside > bar), fits & (inside == bar)
                fits = above | level & (level.cumsum(axis=1) <= self.keep - above.sum(axis=1)[:, None])
            chosen |= fits
        row, column = np.nonzero(chosen)
        return row, column, scores[row, column]

    def settle(self) -> None:
        """Ranks what was found, drops what is out of rank and raises the scores that still count."""
        row, ids, scores = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        begin = np.append(True, row[1:] != row[:-1])[: len(row)]
        group, begin = begin.cumsum() - 1, np.flatnonzero(begin)
        serves = np.zeros((len(row), self.low.shape[1]), bool)
        for w in range(serves.shape[1]):
            fits = (scores >= self.low[row, w]) & (scores <= self.high[row, w])
            total = fits.cumsum()
            place = total - (total[begin] - fits[begin])[group]
            serves[:, w] = fits & (place <= self.keep)
            last = np.flatnonzero(fits & (place == self.keep))
            self.need[row[last], w], self.last[row[last], w] = scores[last], ids[last]
        stays = serves.any(axis=1)
        self.found, self.serves, self.waiting = [(row[stays], ids[stays], scores[stays])], serves[stays], 0


def _parted(blocks: DataFrame, size: int, least: int) -> tuple[DataFrame, int]:
    """``blocks`` with ``part``, runs of about ``size`` bytes in the order of the blocks, and the number of parts: at least ``least`` if there are so many blocks."""
    total, count = blocks.agg(F.sum("bytes"), F.count("*")).first()
    parts = max(1, -(-(total or 0) // size), min(least, count))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select("block", F.floor(before * parts / F.lit(total or 1)).cast("int").alias("part"))
    # Two numbers a block; without the hint the blocks themselves would be shuffled.
    return blocks.join(F.broadcast(placed), "block"), parts


def _meet(index: DataFrame, anchors: DataFrame, schema: str, windows: Callable, keep: int, same: bool) -> DataFrame:
    """The best ``keep`` candidates of each anchor and window in each part of ``index``, as columns of ``schema``.

    ``windows(scores)`` gives the arrays low and high from the anchors' ``scores``.  The columns are the anchor's id, for
    ``same`` no more, else the scores whose windows a candidate serves, and the candidate's id and score.
    """
    index, groups = _parted(index, GROUP_BYTES, 4 * index.sparkSession.sparkContext.defaultParallelism)
    anchors, parts = _parted(anchors, ANCHOR_BYTES, 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["task", "candidates", "block", "ids", "labels", "m", "scores", "width"]
    asked = anchors.withColumn("group", every(groups)).withColumn("candidates", F.lit(False))
    met = index.withColumnRenamed("part", "group").withColumn("part", every(parts)).withColumn("candidates", F.lit(True))
    both = asked.unionByName(met).withColumn("task", F.col("part") * groups + F.col("group")).select(*columns)
    dealt = both.repartitionById(parts * groups, "task").sortWithinPartitions("candidates", "block")
    names = [c.split()[0] for c in schema.split(", ")]

    def started(held: list[tuple[np.ndarray, ...]]) -> tuple[Search, np.ndarray]:
        def stacked(ms: tuple[np.ndarray, ...], fill: int) -> np.ndarray:
            wide = max(m.shape[1] for m in ms)
            return np.concatenate([np.pad(m, ((0, 0), (0, wide - m.shape[1])), constant_values=fill) for m in ms])

        ids, labels, ms, scores = zip(*held)
        scores = stacked(scores, LEAST)
        return Search(np.concatenate(ids), np.concatenate(labels), stacked(ms, 0), *windows(scores), keep, same), scores

    def table(search: Search, scores: np.ndarray) -> Iterator[pa.RecordBatch]:
        search.settle()
        row, ids, found = search.found[0]
        for at in range(0, len(row), 1 << 16):
            cut = slice(at, at + (1 << 16))
            out = [pa.array(search.ids[row[cut]]), pa.array(ids[cut]), pa.array(found[cut])]
            if not same:
                ends = np.append(0, search.serves[cut].sum(axis=1).cumsum()).astype(np.int32)
                out.insert(1, pa.ListArray.from_arrays(pa.array(ends), pa.array(scores[row[cut]][search.serves[cut]])))
            yield pa.RecordBatch.from_arrays(out, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Anchors of like width are held together, so that a long vector does not widen all.
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        searches: list[tuple[Search, np.ndarray]] = []
        for r in (r for batch in batches for r in batch.to_pylist()):
            ids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "labels"))
            m, own = (np.frombuffer(r[c], kind).reshape(len(ids), -1) if r[c] else np.zeros((len(ids), 0), kind) for c, kind in (("m", f"i{r['width']}"), ("scores", np.int64)))
            if r["candidates"]:
                searches = searches or [started(x) for x in held.values()]
                for search, _ in searches:
                    search.meet(ids, labels, m)
            else:
                held.setdefault(m.shape[1].bit_length(), []).append((ids, labels, m, own))
        for found in searches:
            yield from table(*found)

    return dealt.mapInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` (which replaces the label) are expressions over vec_id and label.  Negatives are the
    best rows of another label with least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    bounded_batches(vectors.sparkSession)
    rows = quantised(vectors)
    rows = materialize(rows if label is None else rows.withColumn("label", label.cast("long")), "negatives-rows")
    index = packed_blocks(rows, BLOCK_BYTES, "negatives-index")
    chosen = rows.filter(is_anchor)

    def all_scores(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.full((len(scores), 1), LEAST), np.full((len(scores), 1), MOST)

    found = _meet(index, packed_blocks(chosen, BLOCK_BYTES, "negatives-anchors"), "anchor_id long, positive_id long, positive_score long", all_scores, positives, True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n")
    pairs = materialize(found, "negatives-positives")
    bounds = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set("positive_score").alias("scores"))

    def below(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Whole hundreds apart, so that no product exceeds a long.
        whole, rest = scores // 100, scores % 100
        none = scores == LEAST
        return np.where(none, MOST, least * whole - (-least * rest // 100)), np.where(none, LEAST, most * whole + most * rest // 100)

    schema = "anchor_id long, positive_scores array<long>, negative_id long, negative_score long"
    hard = _meet(index, packed_blocks(chosen.join(bounds, "vec_id"), BLOCK_BYTES, "negatives-asked"), schema, below, negatives, False)
    # Dealt by anchor first, so that a row is not shuffled once for each positive that it serves.
    hard = hard.repartition("anchor_id").withColumn("positive_score", F.explode("positive_scores"))
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return pairs.join(hard, ["anchor_id", "positive_score"]).select(*columns)
