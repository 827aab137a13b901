"""K5/K6 on a stream: repeat suppression and typing-burst collapse with keyed state.

Rows of a visitor are compared in time order, but arrive in any order.  Each visitor's
state holds the rows that the watermark has not passed yet and, for K5, the last
row before them; a timer wakes the visitor when the watermark passes its first
waiting row, so rows come out without new ones arriving.  A row is decided once no
earlier row (K5), or no row within the gap after it (K6), can still come; the result
then equals the batch operators' (``operators.sessionize``).

Late rows: one that is behind the watermark of the micro-batch before is dropped by Spark
and counted in the query's progress (``numRowsDroppedByWatermark``), so ``delay`` must
cover how late rows can be.  One that is less late, but behind rows of its visitor that
are decided already, is kept and does not change what later rows are compared with.
Rows without a visitor or time have no neighbours and come out at once.  What waits is
bounded by a visitor's rows within the delay; rows of the last delay of a stream that
has ended wait for a later row to move the watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "waiting binary, before binary"


def _in_order(rows: DataFrame, visitor: str, ts: str, row_id: str, delay: str, settle_ms: int,
              keep: Callable[[pd.DataFrame, dict | None, int], tuple[pd.Series, dict | None]]) -> DataFrame:
    """Rows of each visitor that ``keep`` selects among those that the watermark has passed by ``settle_ms``.

    ``keep(waiting, before, n)``: of the rows waiting (in time order) the first n are decided.
    """
    names = rows.columns
    # watermarks need TIMESTAMP: the wall clock is read as if UTC, whatever the session time zone
    at = F.timestamp_micros((F.unix_timestamp(ts) * 1000000 + F.date_format(ts, "SSSSSS").cast("long")).cast("long"))
    marked = rows.withColumns({"_at": at, "_us": F.unix_micros(at)}).withWatermark("_at", delay)
    alone = rows.filter(F.col(visitor).isNull() | F.col(ts).isNull())
    schema = T.StructType([f for f in rows.schema.fields])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, before = (pickle.loads(x) for x in state.get) if state.exists else (None, None)
        held = [waiting] if waiting is not None and len(waiting) else []
        if not state.hasTimedOut:
            held += list(batches)
        mark = state.getCurrentWatermarkMs()
        if not held:
            return
        # astype(object) keeps whole numbers whole beside NULLs while they wait
        waiting = pd.concat([h.astype(object) for h in held], ignore_index=True).sort_values(["_us", row_id], kind="stable", ignore_index=True)
        n = int((waiting["_us"] < (mark - settle_ms) * 1000).sum())
        chosen, before = keep(waiting, before, n)
        out, waiting = waiting[:n][chosen.to_numpy(bool)], waiting[n:]
        if len(waiting):
            state.setTimeoutTimestamp(max(mark + 1, int(waiting["_us"].iloc[0]) // 1000 + settle_ms + 1))
        state.update((pickle.dumps(waiting), pickle.dumps(before)))
        if len(out):
            yield out[names]

    keyed = marked.filter(F.col(visitor).isNotNull() & F.col(ts).isNotNull()).groupBy(visitor)
    decided = keyed.applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return decided.unionByName(alone)


def suppress_repeats_stream(visits: DataFrame, within_s: int = 30, page_col: str = "page_path", visitor: str = "visitor_id",
                            ts: str = "visited_at", row_id: str = "id", delay: str = "1 hour") -> DataFrame:
    """K5: drop a visit that repeats the visitor's previous page within ``within_s`` seconds."""

    def keep(waiting: pd.DataFrame, before: dict | None, n: int) -> tuple[pd.Series, dict | None]:
        page, us = waiting[page_col][:n], waiting["_us"][:n].astype("int64")
        kept = pd.Series(True, page.index)
        if before is not None:
            page, us = page[us >= before["us"]], us[us >= before["us"]]
        if not len(page):
            return kept, before
        last = page.shift(), us.shift()
        if before is not None:
            last[0].iloc[0], last[1].iloc[0] = before["page"], before["us"]
        repeat = page.notna() & (page == last[0]) & (us <= last[1] + within_s * 1_000_000)
        kept[repeat.index[repeat]] = False
        return kept, {"page": page.iloc[-1], "us": int(us.iloc[-1])}

    return _in_order(visits, visitor, ts, row_id, delay, 0, keep)


def collapse_typing_stream(search: DataFrame, gap_s: int = 2, visitor: str = "visitor_id", ts: str = "searched_at",
                           row_id: str = "id", delay: str = "1 hour") -> DataFrame:
    """K6: keep the last search of each burst: those whose next one of the visitor is more than ``gap_s`` seconds later."""

    def keep(waiting: pd.DataFrame, before: dict | None, n: int) -> tuple[pd.Series, dict | None]:
        us = waiting["_us"].astype("int64")
        following = us.shift(-1)
        last = following.isna() | (following > us + gap_s * 1_000_000)
        return last[:n], None

    return _in_order(search, visitor, ts, row_id, delay, gap_s * 1000, keep)
