"""Repeated passages by window fingerprints dealt by prefixes (operator 3).

A window is ``WINDOW`` consecutive words of a document.  Every word that is
covered by a window whose words also start earlier (in a document with a smaller
id, or earlier in the same document) is removed; windows are judged on the input.

1. Only suffixes that can lie below a deep node are built.  Every window picks its
   smallest ``SEED``-word hash; equal windows pick equal seeds, so a window whose
   seed occurs once in the corpus starts no repeat.  Seeds are counted over all
   documents with partial aggregation; whole copies of an earlier text are set
   aside first (all their windows repeat).
2. The suffixes left are dealt by a prefix of their words.  The prefix has
   ``PREFIX`` words, and where the seed is frequent it is lengthened to the whole
   window and split further by document, so that no group outgrows a task.
3. Each task has the suffixes of its prefixes sorted by the hash of their window, not
   by their words: fingerprints stand in for the subtrees below a prefix.  Neighbours
   with equal hashes are the leaves under one node of depth ``WINDOW``; the first is the
   earliest occurrence and stays, the others are repeats.  No tree is built, no common
   prefix measured and no maximal repeat reported: a word goes if any repeated window
   covers it, so nodes of exactly ``WINDOW`` words decide all columns, and a repeat of
   any greater length is the union of its windows.  The order is Spark's external
   sort, and the pass holds one batch of leaves whatever the group's size.
4. The first leaves of a split node meet once more, so that one of them stays.

Edge cases: a NULL or empty text has no words; rows equal in id and text are one
document listed twice, each listing gets its result; two texts under one id are
two documents in the order of their hash; NULL ids come after all others; an empty
table gives an empty result.  Only ``doc_id`` and ``text`` are read, so extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, partitions, pick
from kpiforge.llm.wordhash import WordHasher, run_hashes
from kpiforge.session import materialize

WINDOW, SEED, PREFIX = 20, 5, 8
#: Occurrences of a seed from which the groups of its windows are split.
FREQUENT = 10_000
_LAST_ID = (1 << 63) - 1
_KEY = ["ord_id", "ver"]


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        "doc_id",
        F.coalesce("doc_id", F.lit(_LAST_ID)).alias("ord_id"),
        F.hash("text").alias("ver"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def copies(rows: DataFrame) -> DataFrame:
    """(ord_id, ver) of the documents whose whole text stands in an earlier document."""
    each = rows.filter("text <> ''").select(*_KEY, F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    each = each.distinct()
    first = each.groupBy("a", "b").agg(F.min(F.struct(*_KEY)).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialize(first.select("a", "b", "first"), "sub-first")
    return materialize(each.join(first, ["a", "b"]).filter(F.struct(*_KEY) > F.col("first")).select(*_KEY), "sub-copies")


def _seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds, and for each window the position of its seed (its leftmost smallest)."""
    grams = run_hashes(words, SEED)
    per_window = WINDOW - SEED + 1
    if len(grams) < per_window:
        return grams, np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, per_window)
    return grams, np.arange(len(view)) + view.argmin(axis=1)


def seed_rows(rows: DataFrame) -> DataFrame:
    """(seed, ord_id, ver, pos): the seeds that the windows of each document pick."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            found: list[tuple] = []
            for i, words in enumerate(hasher.texts(b.column("text"))):
                grams, at = _seeds(words)
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
                found.append((np.full(len(at), i), grams[at].view(np.int64), at.astype(np.int32)))
            if found:
                row, seed, pos = (np.concatenate(c) for c in zip(*found))
                ids = [b.column(c).to_numpy(zero_copy_only=False)[row] for c in _KEY]
                yield pa.RecordBatch.from_arrays([pa.array(seed), *map(pa.array, ids), pa.array(pos)], ["seed", *_KEY, "pos"])

    return rows.select(*_KEY, "text").mapInArrow(run, "seed long, ord_id long, ver int, pos int")


def suffixes(rows: DataFrame, whole_copies: DataFrame) -> DataFrame:
    """(prefix, part, parts, node, ord_id, ver, start): the suffixes that can start a repeat."""
    seeds = materialize(seed_rows(rows), "sub-seeds")
    shared = seeds.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(shared.select("seed", F.ceil(F.col("n") / FREQUENT).cast("int").alias("parts")), "sub-shared")
    kept = seeds.join(shared, "seed").join(whole_copies, _KEY, "left_anti")
    per_doc = kept.groupBy(*_KEY).agg(F.collect_list("pos").alias("at"), F.collect_list("parts").alias("parts"))
    texts = rows.select(*_KEY, "text").join(materialize(per_doc, "sub-seeded"), _KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        names = ["prefix", "part", "parts", "node", *_KEY, "start"]
        for b in batches:
            ids = [b.column(c).to_pylist() for c in _KEY]
            for ord_id, ver, words, at, parts in zip(*ids, hasher.texts(b.column("text")), b.column("at"), b.column("parts")):
                split = np.zeros(len(words), np.int32)
                split[at.values.to_numpy()] = parts.values.to_numpy()
                _, seed_at = _seeds(words)
                start = np.flatnonzero(split[seed_at])
                if not len(start):
                    continue
                n_parts = split[seed_at[start]]
                node = run_hashes(words, WINDOW)[start]
                prefix = run_hashes(words, PREFIX)[start]
                prefix = np.where(n_parts > 1, node, prefix) >> np.uint64(32)
                part = (ord_id & 0xFFFFFFFF) * 2654435761 % (1 << 32) % n_parts.astype(np.int64)
                columns = [prefix.astype(np.int64), part.astype(np.int32), n_parts, node.view(np.int64)]
                columns += [np.full(len(start), ord_id), np.full(len(start), ver, np.int32), start.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "prefix long, part int, parts int, node long, ord_id long, ver int, start int"
    return texts.mapInArrow(run, schema)


def repeats(found: DataFrame) -> DataFrame:
    """(ord_id, ver, start): every window whose words start earlier as well."""
    by = ["prefix", "part", "node", *_KEY, "start"]
    dealt = found.repartition(partitions(found.sparkSession), "prefix", "part").sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves in order: the first under a node stays (or goes on, if the node is split); the others are repeats."""
        before: np.ndarray | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by])
            shifted = np.concatenate([before if before is not None else ~rows[:, :1], rows[:, :-1]], axis=1)
            same_node = (rows[:3] == shifted[:3]).all(axis=0)
            listed_twice = same_node & (rows[3:] == shifted[3:]).all(axis=0)
            goes_on = ~same_node & (b.column("parts").to_numpy() > 1)
            before = rows[:, -1:]
            take = np.flatnonzero(same_node & ~listed_twice | goes_on)
            out = b.take(pa.array(take)).select(["prefix", "node", *_KEY, "start"])
            yield pa.RecordBatch.from_arrays([pa.array(goes_on[take]), *out.columns], ["first", *out.schema.names])

    schema = "first boolean, prefix long, node long, ord_id long, ver int, start int"
    seen = materialize(dealt.mapInArrow(run, schema), "sub-repeats")
    # One row per part of a split node; all but the earliest of a node are repeats after all.
    firsts = seen.filter("first")
    place = F.struct(*_KEY, "start")
    least = materialize(firsts.groupBy("prefix", "node").agg(F.min(place).alias("least")), "sub-least")
    later = firsts.join(least, ["prefix", "node"]).filter(place > F.col("least"))
    columns = [*_KEY, "start"]
    return seen.filter("not first").select(*columns).unionByName(later.select(*columns))


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row; the text is filled on request."""
    bounded_batches(docs.sparkSession)
    rows = _rows(docs)
    whole = copies(rows)
    again = repeats(suffixes(rows, whole)).groupBy(*_KEY).agg(F.collect_set("start").alias("starts"))
    marks = again.withColumn("copy", F.lit(False)).unionByName(
        whole.select(*_KEY, F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy"))
    )
    joined = rows.join(materialize(marks, "sub-marks"), _KEY, "left").select("doc_id", "text", "starts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for doc_id, text, starts, copy in zip(b.column("doc_id").to_pylist(), texts, b.column("starts"), b.column("copy").to_pylist()):
                words = text.split()
                n = len(words)
                if copy:
                    kept = words if n < WINDOW else []
                elif starts.is_valid:
                    step = np.zeros(n + 1, np.int64)
                    at = starts.values.to_numpy()
                    step[at] += 1
                    step[at + WINDOW] -= 1
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(step[:n]) == 0)]
                else:
                    kept = words
                joined_text = b" ".join(kept)
                digest = hashlib.sha256(joined_text).hexdigest()
                out.append((doc_id, n, n - len(kept), digest, joined_text.decode() if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*out) if out else [[]] * 5
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return joined.mapInArrow(run, _RESULT)
