"""Repeated byte strings by distributed prefix doubling over sampled positions (operator 11).

A window is ``WINDOW`` consecutive bytes of one text.  Every byte covered by a window
whose bytes also start anywhere else (another document or another place of the same)
is removed; windows are judged on the input.

Positions are ranked by ever longer prefixes (``LENGTHS``): the rank of a string is the
pair of the ranks of two shorter strings at a growing offset, Spark brings equal ranks
together, positions whose rank is unique drop out, and the others go on to the next
length until they pass the threshold.  Two things differ from the textbook form:

* Ranks are names (64-bit fingerprints built by doubling), not dense numbers.  Only
  equality of prefixes decides the result, so equal ranks are grouped and not put in
  lexicographic order, and no rank has to travel back before the next doubling.
* Not every position is a row.  At each length a window is stood for by the least
  rank among its substrings of that length; equal windows have equal least ranks.
  Consecutive windows with the same one are a segment, one row for some 70 windows at
  length 64.  A segment whose least rank is unique repeats nowhere.  Segments that are
  equal as a whole are repeats, all their windows, and only one of them goes on, to
  meet the unequal ones.  What remains are the surroundings of the ends of repeats;
  at the last length a segment is one window.

Equality is claimed only for whole segments under one least rank, by two independent
64-bit names, and for single windows by the same two, 128 bits.

Edge cases: NULL or texts shorter than ``WINDOW`` lose nothing; rows equal in id and
text are one document listed twice, each listing gets its result; two texts under one
id are two documents, as are rows with a NULL id and unequal texts; long texts are
ranked in blocks; in a run of one character every window is a segment; an empty table
gives an empty result.  Only ``doc_id`` and ``text`` are read, so extra
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, pick
from kpiforge.llm.wordhash import mixed
from kpiforge.session import materialize, scratch

WINDOW = 200
LENGTHS = (64, 150, 184, 200)
#: Bytes ranked at once.
BLOCK = 1 << 20
#: Bits of the filter that keeps most unique segments out of a shuffle; a fixed size, whatever the corpus.
FILTER_BITS = 1 << 25
_LAST_ID = (1 << 63) - 1
_DOC = ["ord_id", "ver"]
_SEGMENT = ["name", "f1", "f2", "run"]


def _constants(n: int, lane: int) -> np.ndarray:
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lane * 7919)
    return mixed(mixed(seeds)) | np.uint64(1)


_VALUES = [_constants(256, lane) for lane in (1, 2)]
_FACTORS = [_constants(16, lane) for lane in (3, 4)]


def ranks(data: np.ndarray, lane: int, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """For each length the rank of the string that starts at each byte (no more than ``len(data)`` - length + 1)."""
    h, n, at, out = _VALUES[lane][data], 1, 0, {}
    while True:
        for k in lengths:
            if n <= k < 2 * n:
                count = len(data) - k + 1
                pair = h[:count] if k == n else h[:count] * _FACTORS[lane][15] + h[k - n : k - n + count]
                out[k] = mixed(pair)
        if 2 * n > max(lengths):
            return [out[k] for k in lengths]
        h = h[:-n] * _FACTORS[lane][at] + h[n:]
        n, at = 2 * n, at + 1


def _least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``width`` consecutive values, and where its first copy stands."""
    n, at = 1, np.arange(len(h), dtype=np.int32)
    while n < width:
        step = min(n, width - n)
        later = h[step:] < h[:-step]
        h, at = np.where(later, h[step:], h[:-step]), np.where(later, at[step:], at[:-step])
        n += step
    return h, at


def segments(data: np.ndarray, valid: np.ndarray, k: int, window: int, whole: bool) -> dict[str, np.ndarray]:
    """The segments of the windows that start at the positions ``valid``: first and last start, names.

    A segment ends where the least rank moves, so equal windows are never in one, and it has ``window`` windows at most.
    """
    found = ranks(data, 0, (k, window) if whole else (k,))
    least, place = _least(found[0], window - k + 1)
    place = place[valid]
    at = np.flatnonzero(np.append(True, place[1:] != place[:-1]) | np.append(True, valid[1:] != valid[:-1] + 1)) if len(valid) else valid
    s, e = valid[at], valid[np.append(at[1:], len(valid)) - 1] if len(valid) else valid
    out = {"s": s, "e": e, "name": least[s].view(np.int64)}
    if whole:
        out |= {"f1": found[1][s].view(np.int64), "f2": ranks(data, 1, (window,))[0][e].view(np.int64)}
    return out


def _blocks(column: pa.Array, window: int, lists: list | None = None) -> Iterator[tuple]:
    """Texts (or long pieces of them) strung together: bytes, window starts, (row, place in the text) of each piece, cuts.

    ``lists`` restricts the window starts of each text to some ranges.
    """
    column = column.cast(pa.large_binary())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    parts, starts, owners, cuts, size = [], [], [], [], 0
    for row in range(len(column)):
        length = int(at[row + 1] - at[row])
        for low in range(0, max(0, length - window + 1), BLOCK):
            high = min(low + BLOCK, length - window + 1)  # window starts of this piece: low <= start < high
            parts.append(raw[at[row] + low : at[row] + high + window - 1])
            if lists is None:
                starts.append(np.arange(size, size + high - low))
            else:
                starts += [np.arange(size + s - low, size + e - low + 1) for s, e in lists[row]]
            owners.append((row, low))
            cuts.append(size)
            size += high - low + window - 1
            if size >= BLOCK:
                yield np.concatenate(parts), np.concatenate(starts), np.array(owners), np.array(cuts)
                parts, starts, owners, cuts, size = [], [], [], [], 0
    if size:
        yield np.concatenate(parts), np.concatenate(starts), np.array(owners), np.array(cuts)


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select(
        "doc_id", F.coalesce("doc_id", F.lit(_LAST_ID)).alias("ord_id"), F.xxhash64("text").alias("ver"), F.coalesce("text", F.lit("")).alias("text")
    )


def _filter(shared: DataFrame) -> list:
    """The bits of the names in ``shared``, in rows of 4 kB."""
    cell = F.pmod("name", F.lit(FILTER_BITS)) + 1  # bucket and bit numbers are those of positive numbers, from 1
    bits = shared.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    return bits.collect()  # FILTER_BITS / 32768 rows at most


def first_segments(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(sid, name, f1, f2, run, ord_id, ver, s, e): the segments of all texts whose least rank is not unique."""
    texts = rows.filter(F.octet_length("text") >= window)
    # A document listed several times is ranked once.
    twice = materialize(texts.groupBy(*_DOC).count().filter("count > 1").select(*_DOC), "suffix-twice")
    once = texts.join(twice, _DOC, "left_anti").unionByName(texts.join(twice, _DOC, "left_semi").dropDuplicates(_DOC))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, valid, _, _ in _blocks(b.column("text"), window):
                yield pa.RecordBatch.from_arrays([pa.array(segments(data, valid, k, window, False)["name"])], ["name"])

    counted = texts.select("text").mapInArrow(names, "name long").groupBy("name").count()
    shared = materialize(counted.filter("count > 1").select("name"), "suffix-shared")
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, row in _filter(shared):
        bits[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(row, np.uint8)
    known = rows.sparkSession.sparkContext.broadcast(bits)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(c).to_numpy() for c in _DOC]
            for data, valid, owners, cuts in _blocks(b.column("text"), window):
                found = segments(data, valid, k, window, True)
                cell = found["name"] % FILTER_BITS
                keep = np.flatnonzero(known.value[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
                found = {c: v[keep] for c, v in found.items()}
                piece = np.searchsorted(cuts, found["s"], "right") - 1
                row, shift = owners[piece, 0], owners[piece, 1] - cuts[piece]
                out = found | {"run": found["e"] - found["s"], "s": found["s"] + shift, "e": found["e"] + shift}
                out |= {c: v[row] for c, v in zip(_DOC, ids)}
                columns = [*_SEGMENT, *_DOC, "s", "e"]
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in columns], columns)

    schema = ", ".join(f"{c} long" for c in [*_SEGMENT, *_DOC, "s", "e"])
    # No aggregate stands above the join with the names, so Spark can split a frequent one.
    found = once.select(*_DOC, "text").mapInArrow(whole, schema).join(shared, "name", "left_semi")
    return materialize(found.withColumn("sid", F.monotonically_increasing_id()), "suffix-segments")


def _split(found: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(rows of segments that occur twice or more as a whole, rows of one of each that must go on to a longer rank)."""
    same = materialize(found.groupBy(*_SEGMENT).agg(F.count("*").alias("n"), F.min(at).alias(at)), "suffix-same")
    repeated = found.drop(at).join(materialize(same.filter("n > 1").select(*_SEGMENT), "suffix-equal"), _SEGMENT, "left_semi")
    classes = same.groupBy("name").agg(F.count("*").alias("unequal"), F.min("n").alias("least"))
    # Of a class whose segments are all repeated, or that has only one, nothing is left to learn.
    going = materialize(classes.filter("unequal > 1 and least = 1").select("name"), "suffix-open")
    return repeated, same.join(going, "name", "left_semi").select(at)


def _bytes_of(rows: DataFrame, found: DataFrame, window: int) -> DataFrame:
    """(sid, ord_id, ver, s, bytes) of some segments."""
    per_doc = found.groupBy(*_DOC).agg(F.collect_list(F.struct("sid", "s", "e")).alias("at"))
    texts = rows.select(*_DOC, "text").join(materialize(per_doc, "suffix-wanted"), _DOC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b.column(c).to_pylist() for c in _DOC]
            for ord_id, ver, text, at in zip(*ids, b.column("text").cast(pa.large_binary()), b.column("at").to_pylist()):
                data = memoryview(text.as_buffer())
                out = [(x["sid"], ord_id, ver, x["s"], bytes(data[x["s"] : x["e"] + window])) for x in at]
                types = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], ["sid", *_DOC, "s", "bytes"])

    found = texts.mapInArrow(run, "sid long, ord_id long, ver long, s long, bytes binary")
    return materialize(found.dropDuplicates(["sid"]), "suffix-bytes")


def _longer(pieces: DataFrame, ranges: DataFrame, k: int, window: int) -> DataFrame:
    """The segments at length ``k`` of the windows in ``ranges`` (sid, s, e) of the texts ``pieces``; ``at`` is sid * window + s."""
    listed = ranges.groupBy("sid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    texts = pieces.select("sid", "bytes").join(listed, "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sid = b.column("sid").to_numpy()
            lists = [[(x["s"], x["e"]) for x in row] for row in b.column("ranges").to_pylist()]
            for data, valid, owners, cuts in _blocks(b.column("bytes"), window, lists):
                found = segments(data, np.sort(valid), k, window, True)
                piece = np.searchsorted(cuts, found["s"], "right") - 1
                start = found["s"] - cuts[piece]
                columns = [found["name"], found["f1"], found["f2"], found["e"] - found["s"], sid[owners[piece, 0]] * window + start]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*_SEGMENT, "at"])

    schema = ", ".join(f"{c} long" for c in [*_SEGMENT, "at"])
    return materialize(texts.mapInArrow(run, schema), "suffix-longer")


def repeats(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(ord_id, ver, s, e): the ranges of window starts whose windows occur elsewhere, too (they may overlap)."""
    bounded_batches(docs.sparkSession)
    rows = _rows(docs)
    first = first_segments(rows, window, lengths[0])
    again, going = _split(first, "sid")
    out = again.select(*_DOC, "s", "e")
    pieces = _bytes_of(rows, first.join(materialize(going, "suffix-going"), "sid", "left_semi").select("sid", *_DOC, "s", "e"), window)
    ranges = pieces.select("sid", F.lit(0).cast("long").alias("s"), (F.octet_length("bytes") - window).cast("long").alias("e"))
    place = [F.expr(f"at div {window}").alias("sid"), F.pmod("at", F.lit(window)).alias("s")]
    ends = (F.col("s") + F.col("run")).alias("e")
    home = pieces.select("sid", *_DOC, F.col("s").alias("_s"))
    for k in lengths[1:]:
        found = _longer(pieces, ranges, k, window).withColumn("key", F.col("at"))
        again, going = _split(found, "key")
        again = again.select(*place, "run").select("sid", "s", ends)
        out = out.unionByName(home.join(again, "sid").select(*_DOC, (F.col("s") + F.col("_s")).alias("s"), (F.col("e") + F.col("_s")).alias("e")))
        if k < window:
            kept = found.join(materialize(going, "suffix-going"), "key", "left_semi")
            ranges = materialize(kept.select(*place, "run").select("sid", "s", ends), "suffix-ranges")
    return out


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, window: int = WINDOW, lengths: tuple[int, ...] = LENGTHS, with_spans: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row; ``with_spans`` adds the removed runs (from, to)."""
    with scratch(docs.sparkSession) as keep:
        found = repeats(docs, window, lengths).groupBy(*_DOC).agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
        marks = keep(found, "suffix-marks")
    joined = _rows(docs).join(marks, _DOC, "left").select("doc_id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, ranges in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.large_binary()), b.column("ranges")):
                data, spans = memoryview(text.as_buffer()), []
                if ranges.is_valid:
                    s, e = (ranges.values.field(c).to_numpy() for c in ("s", "e"))
                    order = np.argsort(s, kind="stable")
                    s, to = s[order], np.maximum.accumulate(e[order] + window)
                    new = np.flatnonzero(np.append(True, s[1:] > to[:-1]))
                    spans = list(zip(s[new].tolist(), to[np.append(new[1:], len(s)) - 1].tolist()))
                digest, at = hashlib.sha256(), 0
                for low, high in spans:
                    digest.update(data[at:low])
                    at = high
                digest.update(data[at:])
                gone = sum(high - low for low, high in spans)
                row = (doc_id, len(data), gone, len(spans), digest.hexdigest())
                out.append((*row, spans) if with_spans else row)
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.list_(pa.int64()))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"][: 6 if with_spans else 5]
            columns = list(zip(*out)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return joined.mapInArrow(run, _RESULT + (", spans array<array<long>>" if with_spans else ""))
