"""Language identification by cross-parsing (operator 10).

Per language a suffix automaton is built over labelled words.  A word of a new
text is parsed greedily into the longest pieces that occur in those words; the
language that needs the fewest pieces per character wins.  Pieces do not cross
word borders (the borders are characters of the automaton), so the count of a
text is the sum over its words and each task parses a word only once.

Learning reads a bounded sample: per language the ``per_lang`` documents with
the smallest id hash, one slice of ``slice_chars`` of each, of whose words the
most frequent fill ``max_chars``.  Every document is parsed over its whole text.

Edge cases: a NULL text or one without a letter is ``und`` with score 0; equal
counts go to the first language by code; NULL ids or languages are never learned
from; with no labelled text at all every document is ``und``; repeated rows are
predicted alike; an empty table gives an empty result.  Only ``doc_id``,
``text`` and (for learning) ``lang`` are read, so extra columns do not matter.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, held_out, pick

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\x02", "\x03"
#: Words that a task remembers the parses of.
REMEMBERED = 300_000


class SuffixAutomaton:
    """All substrings of the added words; transitions are one map (state, character) -> state."""

    def __init__(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self._out: list[dict[str, int]] = [{}]
        self._link, self._length = [-1], [0]

    def add(self, word: str) -> None:
        last = 0
        for c in word:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, out: dict[str, int]) -> int:
        self._length.append(length)
        self._link.append(link)
        self._out.append(out)
        return len(self._out) - 1

    def _extend(self, last: int, c: str) -> int:
        to = self._out[last].get(c)
        if to is not None and self._length[to] == self._length[last] + 1:
            return to  # the text so far is a substring already
        new = None if to is not None else self._state(self._length[last] + 1, 0, {})
        p = last
        while new is not None and p >= 0 and c not in self._out[p]:
            self._out[p][c] = new
            p = self._link[p]
        if p < 0:
            return new
        q = self._out[p][c]
        if self._length[q] == self._length[p] + 1:
            end = q
        else:
            end = self._state(self._length[p] + 1, self._link[q], dict(self._out[q]))
            self._link[q] = end
            while p >= 0 and self._out[p].get(c) == q:
                self._out[p][c] = end
                p = self._link[p]
        if new is None:
            return end
        self._link[new] = end
        return new

    def frozen(self) -> dict[tuple[int, str], int]:
        return {(s, c): t for s, out in enumerate(self._out) for c, t in out.items()}


def pieces(step: dict[tuple[int, str], int], word: str) -> int:
    """Pieces of the greedy parse of ``word``; a character that never occurs is a piece of its own."""
    n, state = 1, 0
    for c in word:
        to = step.get((state, c))
        if to is None:
            if state:
                n += 1
                to = step.get((0, c))
            if to is None:  # unknown character: it ends its own piece
                n, state = n + 1, 0
                continue
        state = to
    return n if state else n - 1


def _words(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def _built(words: Counter, max_chars: int) -> dict[tuple[int, str], int]:
    automaton, room = SuffixAutomaton(), max_chars
    for word, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        room -= len(word) + 2
        if room < 0:
            break
        automaton.add(_OPEN + word + _CLOSE)
    return automaton.frozen()


def fit(docs: DataFrame, per_lang: int = 400, slice_chars: int = 4000, max_chars: int = 60_000) -> dict[str, dict]:
    """language -> transitions, each built by one task from its bounded sample."""
    rows = pick(docs, "doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))
    )
    first = Window.partitionBy("lang").orderBy("_h", "doc_id")
    ids = rows.select("lang", "doc_id", F.xxhash64("doc_id").alias("_h")).withColumn("_n", F.row_number().over(first))
    ids = ids.filter(F.col("_n") <= per_lang).select("lang", "doc_id").distinct()
    start = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.greatest(F.lit(1), F.length("text") - slice_chars))
    cut = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(slice_chars))
    sample = rows.join(ids, ["lang", "doc_id"]).select("lang", cut.alias("cut"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        words: Counter = Counter()
        for t in group["cut"]:
            words.update(_words(t))
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "model": [pickle.dumps(_built(words, max_chars))]})

    built = sample.groupBy("lang").applyInPandas(build, "lang string, model binary").collect()
    return {r.lang: pickle.loads(r.model) for r in sorted(built, key=lambda r: r.lang)}


class _Parser:
    def __init__(self, models: dict[str, dict]):
        self.langs, self.steps = list(models), list(models.values())
        self.rows: dict[str, int] = {}
        self.counts = np.zeros((1024, len(self.steps)), np.int64)

    def _row(self, word: str) -> int:
        at = self.rows.get(word)
        if at is None:
            at = self.rows[word] = len(self.rows)
            if at >= len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
            marked = _OPEN + word + _CLOSE
            self.counts[at] = [pieces(s, marked) for s in self.steps]
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _words(text) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        total = np.zeros(len(self.langs), np.int64)
        for at in range(0, len(words), 50_000):
            idx = [self._row(w) for w in words[at : at + 50_000]]
            total = total + self.counts[idx].sum(axis=0)
        best = int(total.argmin())
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        second = float(np.delete(total, best).min())
        return self.langs[best], second / (second + float(total[best]))


def predict(docs: DataFrame, models: dict[str, dict]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; score: the share of the runner-up's pieces."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    shared = spark.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(shared.value)
        for b in batches:
            found = [parser.predict(t.as_py()) for t in b.column("text")]
            columns = [b.column("doc_id"), b.column("held_out")]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
