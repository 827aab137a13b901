"""Repeated byte strings against brute force over all windows."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from kpiforge.llm import suffix_dedup


def brute(texts, window):
    """(n_bytes, n_removed, n_spans, sha256) of each text; equal (id, text) rows are one document."""
    once = dict.fromkeys((i, (t or "").encode()) for i, t in texts)
    starts = Counter(t[p : p + window] for _, t in once for p in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if starts[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def fixture():
    rnd = random.Random(3)

    def prose(n, alphabet="abcdefgh éß"):
        return "".join(rnd.choice(alphabet) for _ in range(n))

    passage, base = prose(260), prose(900)
    rows = [(1, None), (2, ""), (3, "short"), (4, base), (5, base), (5, base), (6, base[:450] + "#" + base[451:]), (7, "x" * 250), (8, "x" * 3000), (9, "ab" * 400)]
    rows += [(10, passage + prose(50) + passage), (11, prose(300) + passage[30:240] + prose(300)), (12, prose(100) + passage[:199] + prose(100)), (13, passage[60:]), (None, base[100:700]), (None, base[100:700])]
    rows += [(14, prose(400)), (14, prose(400)), (15, prose(199)), (16, passage[:200]), (17, "é" * 100), (18, "é" * 99 + "x" + "é" * 100)]
    rows += [(20 + i, prose(rnd.randrange(300)) + passage[rnd.randrange(40) : 200 + rnd.randrange(60)] + prose(rnd.randrange(300), "abc ")) for i in range(80)]
    return rows + [(200 + i, prose(rnd.randrange(400), "ab")) for i in range(40)]


def check(spark, rows, window, lengths):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("name", F.lit("extra"))
    docs = docs.withColumn("s", F.lit(1)).toDF("doc_id", "text", "sid", "TEXT")
    got = suffix_dedup.dedup(docs, window, lengths)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, window)


def test_removes_exactly_the_covered_bytes(spark):
    check(spark, fixture(), suffix_dedup.WINDOW, suffix_dedup.LENGTHS)


def test_other_windows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 300)
    check(spark, fixture(), 40, (16, 25, 40))
    check(spark, fixture(), 32, (32,))


def test_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "-" + "abc" * 100), (2, "abc" * 100 + "-")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in suffix_dedup.dedup(docs, with_spans=True).collect()}
    assert got == {1: [(1, 301)], 2: [(0, 300)]}
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0
