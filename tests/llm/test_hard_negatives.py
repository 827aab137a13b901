"""Hard negatives against brute force, packed products against plain ones."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import hard_negatives


def brute(rows, anchor, relabel, positives=5, negatives=5):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (relabel(i, label), [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in kept.items():
        if not anchor(a):
            continue
        others = sorted((-score(v, w), i, lab) for i, (lab, w) in kept.items() if i != a)
        for s, p, _ in [x for x in others if x[2] == label][:positives]:
            hard = [x for x in others if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(hard, 1)]
    return sorted(out)


def fixture(dims=8):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, 1.0, rnd.uniform(-1, 1)]) for _ in range(dims)], rnd.randrange(3)) for i in range(0, 300)]
    rows += [(400, [0.5] * dims, 1), (401, [0.5] * dims, 2), (402, [0.5] * dims, 1), (400, [0.5] * dims, 1), (403, [0.25] * dims, 0), (403, [0.75] * dims, 0)]
    rows += [(410, None, 1), (411, [None] * dims, 1), (412, [float("nan")] * dims, 1), (413, [float("inf")] * dims, 1), (414, [0.5] * dims, None), (None, [0.5] * dims, 1)]
    return rows + [(500, [], 1), (501, [1.0, 1.0], 2), (502, [1.0] * (dims + 3), 1), (600, [0.0] * dims, 0), (700, [1.0] * dims, 77)]


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", block)
    df = spark.createDataFrame(fixture(), "vec_id long, embedding array<double>, label int").withColumn("q", F.lit(1)).withColumn("rank", F.lit("x"))
    label = F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label"))
    got = hard_negatives.mine(df.toDF(*df.columns[:-1], "Label").repartition(3), F.expr("vec_id % 20 = 0"), label)
    want = brute(fixture(), lambda i: i % 20 == 0, lambda i, lab: (lab + 1) % 10 if i % 7 == 0 else lab)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want
    assert hard_negatives.mine(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


@pytest.mark.parametrize("size", [3, 300, 10**5, 10**8, 2**40])
def test_packed_products_are_exact(size):
    rnd = np.random.default_rng(size)
    m, a = rnd.integers(-size, size, (37, 9)), rnd.integers(-size, size // 2 + 1, (5, 9))
    packed = hard_negatives.Packed(m, int(a.min()), int(a.max()))
    assert (packed.scores(a) == a.astype(object) @ m.astype(object).T).all()
    if size == 300:
        assert packed.fields >= 2


def test_unit_vectors_share_a_double_by_threes():
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(200, 64))
    m = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int16)
    a = np.concatenate([m[:20], -m[:5], np.zeros((1, 64), np.int16)])
    packed = hard_negatives.Packed(m, int(a.min()), int(a.max()), 264.5)
    assert packed.fields == 3
    assert (packed.scores(a) == a.astype(np.int64) @ m.astype(np.int64).T).all()


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("kind", ["ties", "spread", "rare", "equal", "wide"])
@pytest.mark.parametrize("crowded", [1, 32, 10**9])
def test_search_keeps_the_best_of_each_window(monkeypatch, same, kind, crowded):
    monkeypatch.setattr(hard_negatives, "CROWDED", crowded)
    monkeypatch.setattr(hard_negatives, "CHUNK", 64)
    monkeypatch.setattr(hard_negatives, "PAIRS", 1000)
    monkeypatch.setattr(hard_negatives, "WAITING", 300)
    rnd = np.random.default_rng(3)
    size = {"ties": 2, "equal": 1}.get(kind, 300)
    m = rnd.integers(-size, size + 1, (1200, 6))
    if kind == "equal":
        m[:] = 1
    labels = np.sort(rnd.integers(0, 300 if kind == "rare" else 4, len(m)))
    ids = rnd.permutation(5000)[: len(m)]
    order = np.lexsort((ids, labels))
    ids, labels = ids[order], labels[order]
    at = np.sort(rnd.choice(len(m), 40, replace=False))
    a = m[at].copy()
    if kind == "wide":  # sums that could, but do not, exceed a long
        m[:, 5], a[:, 5], a[:, 4], m[:, 4] = 2**62, 0, 2**40, rnd.integers(0, 3, len(m))
    exact = a.astype(object) @ m.astype(object).T
    tops = np.sort(np.array([[int(x) for x in rnd.choice(row, 3)] for row in exact]), axis=1)
    low, high = (np.full((40, 1), hard_negatives.LEAST), np.full((40, 1), hard_negatives.MOST)) if same else (tops - abs(tops) // 5, tops)
    search = hard_negatives.Search(ids[at], labels[at], a, low, high, 5, same)
    for i in range(0, len(m), 500):
        search.meet(ids[i : i + 500], labels[i : i + 500], m[i : i + 500])
    search.settle()
    row, found, score = search.found[0]
    for i in range(40):
        for w in range(low.shape[1]):
            fit = [(-exact[i, j], ids[j]) for j in range(len(m)) if (labels[j] == labels[at[i]]) == same and j != at[i] and low[i, w] <= exact[i, j] <= high[i, w]]
            mine = (row == i) & search.serves[:, w]
            assert sorted(zip(-score[mine], found[mine])) == sorted(fit)[:5]


def test_rows_handed_on_do_not_grow_with_the_blocks(spark, monkeypatch):
    """Positives come from an anchor's label and negatives from the rest, a few per part, not per block and positive."""
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randrange(3)) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    meet, handed = hard_negatives._meet, []

    def counted(*args, **kwargs):
        out = meet(*args, **kwargs)
        handed.append(out.count())
        return out

    monkeypatch.setattr(hard_negatives, "_meet", counted)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1000)  # 20 rows of 48 bytes
    found = hard_negatives.mine(df, F.expr("vec_id % 300 = 0")).count()
    parts = 4 * spark.sparkContext.defaultParallelism
    assert found > 300 and handed[0] <= 20 * 5 * (parts / 3 + 2) and handed[1] <= 20 * 25 * parts
    assert handed[1] < 6000
