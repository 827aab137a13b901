"""Quality classifier by compression (operator 8).

Two zstandard dictionaries are trained, one on good and one on bad labelled
text.  A text is cut into blocks, each block is compressed with either
dictionary, and the normalised difference of the summed sizes,
``(bad - good) / (bad + good)``, together with the log of the better ratio of
compression (endless repetition shrinks alike under both dictionaries), is
turned into a probability by a logistic curve.  The curve is fitted on labelled
texts that the dictionaries have not seen and set to the shares of the two
classes among all usable labels.

Learning reads a bounded sample: per class the ``per_class`` labelled documents
with the smallest id hash, of each one slice of at most ``slice_bytes``; every
document is scored over its whole text.

Edge cases: NULL and empty texts have difference and ratio 0 and get the
curve's value there; NULL ids are scored and never learned from; labels that are NULL,
outside 0/1 or contradict each other for one id are ignored; repeated rows are
scored alike; with no usable label in a class every score is 0.5; an empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read from the
documents, so extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, held_out, pick

BLOCK_BYTES = 2048
DICT_BYTES = 64 << 10
LEVEL = 3


def usable_labels(labels: DataFrame) -> DataFrame:
    """One row (doc_id, quality) per id outside the held-out fold with one clear label."""
    rows = pick(labels, "doc_id", "quality").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_max"))
    return each.filter("quality = _max and quality in (0, 1)").select("doc_id", "quality")


def training_slices(docs: DataFrame, labels: DataFrame, per_class: int, slice_bytes: int) -> list[tuple[int, bytes]]:
    """At most ``per_class`` (quality, slice) pairs of each class, in id-hash order."""
    marked, order = usable_labels(labels), F.xxhash64("doc_id")
    texts = pick(docs, "doc_id", "text").filter(F.length("text") > 0)
    out: list[tuple[int, bytes]] = []
    for quality in (0, 1):
        # Twice the bound: a label may name a document that is absent.  The ids are bounded, so they may be broadcast.
        ids = marked.filter(F.col("quality") == quality).orderBy(order, "doc_id").limit(2 * per_class).select("doc_id")
        start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.lit(1), F.length("text") - slice_bytes // 2))
        cut = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(slice_bytes // 2))
        found = texts.join(F.broadcast(ids), "doc_id").select(order.alias("h"), "doc_id", cut.alias("cut"))
        rows = found.orderBy("h", "doc_id", "cut").limit(per_class).collect()
        out += [(quality, r.cut.encode()[:slice_bytes]) for r in rows]
    return out


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: use it as it is
        return b"\n".join(samples)[-DICT_BYTES:]


class _Scorer:
    """Features and score of one text; holds the two compressors, so one is made per task."""

    def __init__(self, model: dict):
        self.pair = [self._compressor(model[d]) for d in ("good", "bad")]
        self.weights = model.get("weights", (0.0, 0.0, 0.0))

    @staticmethod
    def _compressor(raw: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)

    def features(self, text: bytes) -> tuple[float, float]:
        good = bad = 0
        for at in range(0, len(text), BLOCK_BYTES):
            block = text[at : at + BLOCK_BYTES]
            good += len(self.pair[0].compress(block))
            bad += len(self.pair[1].compress(block))
        return ((bad - good) / (bad + good), math.log(min(good, bad) / len(text))) if text else (0.0, 0.0)

    def score(self, text: bytes | None) -> float:
        x = self.features(text or b"")
        z = self.weights[0] * x[0] + self.weights[1] * x[1] + self.weights[2]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, odds: float) -> tuple[float, ...]:
    """Weights and intercept by damped Newton steps; the two classes count alike, ``odds`` restores their shares."""
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    m = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, damp = np.zeros(m.shape[1]), np.eye(m.shape[1]) * 1e-2
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        step = np.linalg.solve((m * (each * p * (1 - p))[:, None]).T @ m + damp, m.T @ (each * (y - p)) - damp @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return (*map(float, slopes), float(w[-1] - slopes @ mean + math.log(odds)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, slice_bytes: int = 4096) -> dict | None:
    """The two dictionaries and the curve; None when a class has fewer than two labelled texts."""
    rows = training_slices(docs, labels, per_class, slice_bytes)
    split: dict[tuple[int, int], list[bytes]] = {}
    for i, (quality, cut) in enumerate(rows):
        split.setdefault((quality, i % 2), []).append(cut)
    if any(not split.get((q, half)) for q in (0, 1) for half in (0, 1)):
        return None
    shares = dict(usable_labels(labels).groupBy("quality").count().collect())
    model = {"good": _dictionary(split[1, 0]), "bad": _dictionary(split[0, 0])}
    scorer = _Scorer(model)
    x = np.array([scorer.features(c) for q in (0, 1) for c in split[q, 1]])
    y = np.array([q for q in (0, 1) for _ in split[q, 1]], float)
    model["weights"] = _logistic(x, y, shares[1] / shares[0])
    return model


def score(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    if model is None:
        scored = rows.withColumn("score", F.lit(0.5))
    else:
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = _Scorer(shared.value)
            for b in batches:
                p = [scorer.score(t.as_py()) for t in b.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64())], ["doc_id", "held_out", "score"])

        scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict | None, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    if model is None:
        return docs
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for b in batches:
            keep = [scorer.score(t.as_py()) >= threshold for t in b.column(at).cast(pa.binary())]
            yield b.filter(pa.array(keep, pa.bool_()))

    return renamed.mapInArrow(run, renamed.schema).toDF(*docs.columns)
