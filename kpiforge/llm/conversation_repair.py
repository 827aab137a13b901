"""Repair of conversation structure by auction shortest paths (operator 13).

Rows of a conversation, in the order of their turns, are edited at the least cost so
that the role initials read ``(s?(ua)+)?``: Keep costs 0, Rerole to user or assistant 2,
Delete 3 (required for blank and duplicate rows), Insert of an empty user or assistant
row 2 anywhere; truncated rows that stay add 1.  Edits are paths through a lattice of
(rows consumed, state of the pattern).

An auction finds the shortest paths: a path grows from the origin along the arc that
attains the least cost plus price; where the price of its end is below that least, the
price is raised to it and the path contracts by a node.  On arrival the prices are an
optimal dual: every shortest path consists of tight arcs (cost = difference of prices),
and the least sequence of edit initials is traced along those that lead on to the end.

A conversation may hold a large part of all rows, so it is cut into segments of
``SEGMENT`` rows that no task needs to see whole:

1. ``faults`` flags rows by aggregates and a join on text hashes, never by conversation.
2. ``segments``: rows dealt by ranges of their order; per segment one letter a row and
   the least cost from each state to each state, by auctions.
3. ``end_prices``: per conversation, backward over its segments (16 numbers each), the
   price of each state at each segment's end.
4. ``traces``: every segment by itself: auction and trace from each state, given these.
5. ``apply_edits``: per conversation, forward: the pieces are put together and the rows
   streamed into one SHA-256, which is sequential by nature; nothing but the edits' initials is held.

Edge cases: NULL role or text are one space; rows of equal turn are ordered by role, then
by a hash of the text, NULL turns first; a NULL conversation id is one conversation;
roles with other initials cannot be kept; repeated rows are duplicates; conversations
without rows after damage give zeros, an empty audit and the hash of the empty string;
an empty table gives an empty result.  Only the four columns are read, so extra columns
do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import bounded_batches, partitions, pick
from kpiforge.session import materialize

#: Rows of a segment; auctions on long lattices raise prices many times.
SEGMENT = 16
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
_NONE = 1 << 40
_LEGAL = {"su", "ua", "au"}
_ORDER = ["conv_id", "t", "role", "h", "tie"]
_FIRST_TURN = -(1 << 63)


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` with planted faults, chosen by crc32(conv_id:turn) % 20; ``copies`` is 0 for a dropped row and 2 for a repeated one."""
    df = pick(rows, "conv_id", "turn", "role", "text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    df = df.withColumn("kind", F.crc32(key.cast("binary")) % 20).fillna(" ", ["role", "text"])
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return df.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def numbered(rows: DataFrame) -> DataFrame:
    """One row per copy, with the columns of its place in the order; a row without copies stays as an absent one."""
    if "copies" not in rows.columns:
        rows = pick(rows, "conv_id", "turn", "role", "text").withColumn("copies", F.lit(1))
    df = rows.fillna(" ", ["role", "text"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))))
    t = F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST_TURN)).alias("t")
    columns = [F.col("conv_id").cast("long").alias("conv_id"), t, "role", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("tie")]
    return materialize(df.select(*columns, (F.col("copies") > 0).alias("present"), "text"), "repair-rows")


def faults(rows: DataFrame) -> DataFrame:
    """The order columns and ``letter``: b(lank), r(epeated), else the role's initial s, u, a or o(ther), upper case if truncated; x if absent."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    letter = F.when(last == "", F.lit("b")).when(last.isin(".", "!", "?"), letter).otherwise(F.upper(letter))
    second = F.xxhash64(F.lit(1), "text").alias("h2")
    narrow = rows.select(*_ORDER, second, F.coalesce("conv_id", F.lit(0)).alias("c"), F.isnull("conv_id").alias("no_c"), F.when(F.col("present"), letter).otherwise(F.lit("x")).alias("letter"))
    narrow = materialize(narrow, "repair-letters")
    same = ["c", "no_c", "role", "h", "h2"]
    seen = narrow.filter("letter not in ('b', 'x')").groupBy(*same)
    firsts = seen.agg(F.min(F.struct("t", "tie")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    # The table of firsts is written: the skew join then splits the rows of one text, however many there are.
    found = narrow.join(materialize(firsts.select(*same, "first"), "repair-firsts"), same, "left")
    repeated = F.coalesce(F.struct("t", "tie") > F.col("first"), F.lit(False)) & ~F.col("letter").isin("b", "x")
    return found.select(*_ORDER, F.when(repeated, F.lit("r")).otherwise(F.col("letter")).alias("letter"))


class Lattice:
    """Nodes (rows consumed, state) of one segment; the last layer leads to the end at the cost ``ends`` of its state."""

    def __init__(self, letters: str, ends: tuple[int, ...]):
        self.size = len(letters)
        self.goal = 4 * (self.size + 1)
        self.arcs: list[list[tuple[int, str, int]]] = [[] for _ in range(self.goal)]
        for i, letter in enumerate(letters):
            low, extra = letter.lower(), int(letter.isupper())
            for q in range(4):
                arcs = self.arcs[4 * i + q]
                arcs.append((0 if low == "x" else 3, "" if low == "x" else "D", 4 * (i + 1) + q))
                arcs.append((2, "I", 4 * i + _NEXT[q]))
                if low in _KEPT:
                    if q in _KEPT[low]:
                        arcs.append((extra, "K", 4 * (i + 1) + _KEPT[low][q]))
                    arcs.append((2 + extra, "R", 4 * (i + 1) + _NEXT[q]))
        for q in range(4):
            if ends[q] < _NONE:
                self.arcs[4 * self.size + q].append((ends[q], "", self.goal))
        self.live = self._leads([[j for _, _, j in arcs] for arcs in self.arcs])
        self.arcs = [[a for a in arcs if self.live[a[2]]] for arcs in self.arcs]
        self.price = [0] * (self.goal + 1)

    def _leads(self, follow: list[list[int]]) -> list[bool]:
        """The nodes from which the end can be reached; arcs stay in a layer or go to the next."""
        live = [False] * self.goal + [True]
        for i in range(self.size, -1, -1):
            for _ in range(4):  # a path within a layer has three arcs at most
                for node in range(4 * i, 4 * i + 4):
                    live[node] = live[node] or any(live[j] for j in follow[node])
        return live

    def auction(self, origin: int) -> int:
        """The least cost from ``origin`` (a state of the first layer) to the end; prices stay valid for further origins."""
        if not self.live[origin]:
            return _NONE
        path, price = [origin], self.price
        while path[-1] != self.goal:
            node = path[-1]
            least, to = min((cost + price[j], j) for cost, _, j in self.arcs[node])
            if price[node] < least:
                price[node] = least
                if node != origin:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def trace(self, origin: int) -> tuple[str, int]:
        """The least string of edit initials over all shortest paths from ``origin``, and the state in which it ends.

        Passing an absent row comes before any edit, as every edit is open after it, too.
        """
        price = self.price
        tight = [[(what, j) for cost, what, j in arcs if price[node] == cost + price[j]] for node, arcs in enumerate(self.arcs)]
        live = self._leads([[j for _, j in arcs] for arcs in tight])
        out, node = [], origin
        while node < 4 * self.size:
            what, node = min((what, j) for what, j in tight[node] if live[j])
            out.append(what)
        return "".join(out), node - 4 * self.size


@lru_cache(1 << 16)
def transfer(letters: str) -> tuple[int, ...]:
    """The least costs from each state before the rows to each state after them."""
    out = []
    for to in range(4):
        lattice = Lattice(letters, tuple(0 if q == to else _NONE for q in range(4)))
        out.append([lattice.auction(q) for q in range(4)])
    return tuple(out[to][q] for q in range(4) for to in range(4))


@lru_cache(1 << 16)
def traced(letters: str, ends: tuple[int, ...]) -> tuple[tuple[str, int], ...]:
    """Per state before the rows: the edits and the state after them (an empty string and START where there is no path)."""
    lattice = Lattice(letters, ends)
    return tuple(lattice.trace(q) if lattice.auction(q) < _NONE else ("", START) for q in range(4))


#: After the last row only insertions remain: an absent row stands for the end.
_CLOSING = (0, _NONE, _NONE, 0)


def closing_costs() -> list[int]:
    lattice = Lattice("x", _CLOSING)
    return [lattice.auction(q) for q in range(4)]


def segments(letters: DataFrame) -> DataFrame:
    """(conv_id, t, role, h, tie, seq, letters, costs): up to ``SEGMENT`` rows each, named by the place of the first."""
    dealt = letters.repartitionByRange(partitions(letters.sparkSession), *_ORDER).sortWithinPartitions(*_ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, held = TaskContext.get().partitionId() << 40, None, []

        def close() -> tuple:
            text = "".join(held).replace("x", "")
            return (*first, seq, text, list(transfer(text)))

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())], list(kinds))

        for b in batches:
            out = []
            for *place, letter in zip(*(b.column(c).to_pylist() for c in [*_ORDER, "letter"])):
                if first is not None and (first[0] != place[0] or len(held) == SEGMENT):
                    out.append(close())
                    seq, first, held = seq + 1, None, []
                first = first or place
                held.append(letter)
            yield rows(out)
        if first is not None:
            yield rows([close()])

    kinds = dict(zip(_ORDER, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]))
    kinds |= {"seq": pa.int64(), "letters": pa.string(), "costs": pa.list_(pa.int64())}
    schema = "conv_id long, t long, role string, h long, tie long, seq long, letters string, costs array<long>"
    return materialize(dealt.select(*_ORDER, "letter").mapInArrow(run, schema), "repair-segments")


def end_prices(found: DataFrame) -> DataFrame:
    """(seq, ends, total): the price of each state after each segment, and the least cost of the conversation on its first segment."""
    dealt = found.select("conv_id", "seq", "costs").repartition(partitions(found.sparkSession), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends = object(), None
        for b in batches:
            out = []
            for conv, seq, costs in zip(*(b.column(c).to_pylist() for c in ("conv_id", "seq", "costs"))):
                if conv != now:
                    now, ends = conv, closing_costs()
                before = [min(costs[4 * q + to] + ends[to] for to in range(4)) for q in range(4)]
                out.append((seq, ends, before[START]))
                ends = before
            columns = zip(*out) if out else [[]] * 3
            types = [pa.int64(), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["seq", "ends", "total"])

    ordered = dealt.sortWithinPartitions(F.col("conv_id"), F.col("seq").desc())
    return materialize(ordered.mapInArrow(run, "seq long, ends array<long>, total long"), "repair-prices")


def traces(found: DataFrame, prices: DataFrame) -> DataFrame:
    """The segments with ``pieces``: the edits from each state, and ``after``: the state in which each ends."""
    joined = found.drop("costs").join(prices, "seq")
    names = [*_ORDER, "letters", "total", "pieces", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, after = [], []
            for letters, ends in zip(b.column("letters").to_pylist(), b.column("ends").to_pylist()):
                least = min(ends)
                each = traced(letters, tuple(e - least if e < _NONE else _NONE for e in ends))
                pieces.append([p for p, _ in each])
                after.append([q for _, q in each])
            columns = [b.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.list_(pa.string())), pa.array(after, pa.list_(pa.int64()))], names)

    schema = "conv_id long, t long, role string, h long, tie long, letters string, total long, pieces array<string>, after array<long>"
    return joined.mapInArrow(run, schema)


class _Conversation:
    """What is known of one conversation while its rows stream by."""

    def __init__(self, conv: int | None, total: int):
        self.conv, self.total, self.state = conv, total, START
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.turns, self.low, self.high, self.initial = 0, None, None, None
        self.edits: Iterator[str] = iter("")

    def piece(self, letters: str, pieces: list[str], after: list[int]) -> None:
        self.counts["blank"] += letters.count("b")
        self.counts["duplicate"] += letters.count("r")
        self.counts["truncated"] += sum(map(str.isupper, letters))
        self.audit.append(pieces[self.state])
        self.edits, self.pending_state = iter(pieces[self.state]), after[self.state]
        self.at, self.state = self.state, self.pending_state

    def _line(self, line: str) -> None:
        self.digest.update(("\n" + line if self.lines else line).encode())
        self.lines += 1

    def _added(self) -> str:
        self.at = _NEXT[self.at]
        return "user" if self.at == USER else "assistant"

    def row(self, t: int, role: str, text: str) -> None:
        if t != _FIRST_TURN and t != self.high:
            self.turns, self.low, self.high = self.turns + 1, t if self.low is None else self.low, t
        if self.initial is not None:
            self.counts["illegal"] += self.initial + role[:1] not in _LEGAL
        self.initial = role[:1]
        for edit in self.edits:
            if edit == "I":
                self._line(self._added() + ":")
                continue
            if edit == "K":
                self.at = _KEPT[role[0]][self.at]
                self._line(f"{role}:{text}")
            elif edit == "R":
                self._line(f"{self._added()}:{text}")
            return

    def result(self) -> tuple:
        for edit in traced("x", _CLOSING)[self.state][0]:
            self.at = self.state
            self._line(self._added() + ":")
            self.state = self.at
            self.audit.append(edit)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.total, "".join(self.audit), self.digest.hexdigest())


_RESULT = {"conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def apply_edits(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """The result rows: each segment's piece stands before its rows."""
    own = rows.select(*_ORDER, F.when(F.col("present"), 1).otherwise(2).alias("part"), "text")
    both = pieces.withColumn("part", F.lit(0)).unionByName(own, allowMissingColumns=True)
    dealt = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*_ORDER, "part")
    names = ["conv_id", "t", "role", "part", "text", "letters", "total", "pieces", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for b in batches:
            out = []
            for conv, t, role, part, text, letters, total, edits, after in zip(*(b.column(c).to_pylist() for c in names)):
                if part == 0:
                    if now is None or now.conv != conv:
                        out += [now.result()] if now else []
                        now = _Conversation(conv, total)
                    now.piece(letters, edits, after)
                elif part == 1:
                    now.row(t, role, text)
            columns = zip(*out) if out else [[]] * len(_RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, _RESULT.values())], list(_RESULT))
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(now.result(), _RESULT.values())], list(_RESULT))

    schema = ", ".join(f"{c} {'string' if kind == pa.string() else 'long'}" for c, kind in _RESULT.items())
    return dealt.select(*names).mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation in ``rows``.

    ``rows``: conv_id, turn, role, text, and ``copies`` if they come from ``damage``.
    """
    bounded_batches(rows.sparkSession)
    each = numbered(rows)
    found = segments(faults(each))
    return apply_edits(each, traces(found, end_prices(found)))
