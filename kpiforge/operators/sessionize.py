"""K5/K6 in batch form: repeat suppression and typing-burst collapse.

Both compare each event with its neighbour of the same visitor in time
order.  The neighbour comes from ``scans.keyed_lag`` chunked by calendar day,
so an anonymous or bot visitor with a huge share of events is spread over
one task per day instead of one task.  Events without a visitor id have no
neighbour (each is its own key), and are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import never_null_key
from .scans import keyed_lag


def suppress_repeats(visits: DataFrame, within_s: int = 30, page_col: str = "page_path",
                     visitor: str = "visitor_id", ts: str = "visited_at", row_id: str = "id") -> DataFrame:
    """K5: drop a visit that repeats the visitor's previous page within ``within_s`` seconds.

    Not ``dropDuplicatesWithinWatermark``: that keys on values, not on the
    previous event, and only expires state between micro-batches.
    """
    keyed = visits.withColumn("_vk", never_null_key(F.col(visitor), F.col(row_id)))
    prev = keyed_lag(keyed, "_vk", [ts, row_id], F.struct(F.col(page_col).alias("p"), F.col(ts).alias("t")),
                     "_prev", chunk=F.to_date(F.col(ts)))
    repeat = ((F.col("_prev.p") == F.col(page_col))
              & (F.col(ts) <= F.timestamp_add("SECOND", F.lit(within_s), F.col("_prev.t"))))
    return prev.filter(~F.coalesce(repeat, F.lit(False))).drop("_vk", "_prev")


def collapse_typing(search: DataFrame, gap_s: int = 2, visitor: str = "visitor_id", ts: str = "searched_at",
                    row_id: str = "id") -> DataFrame:
    """K6: keep only the last search of each burst (next search of the visitor
    more than ``gap_s`` seconds later, or none)."""
    keyed = search.withColumn("_vk", never_null_key(F.col(visitor), F.col(row_id)))
    nxt = keyed_lag(keyed, "_vk", [ts, row_id], F.col(ts), "_next", chunk=F.to_date(F.col(ts)), lead=True)
    last = F.col("_next").isNull() | (F.col("_next") > F.timestamp_add("SECOND", F.lit(gap_s), F.col(ts)))
    return nxt.filter(last).drop("_vk", "_next")
