"""K5/K6: the streams equal the batch operators over several files in any order; what happens to late rows."""

import datetime as dt
import random

import pytest

from kpiforge.operators import sessionize
from kpiforge.session import scratch_path
from kpiforge.streaming import run_available
from kpiforge.streaming.sessionize import collapse_typing_stream, suppress_repeats_stream

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "id long, visitor_id string, page_path string, visited_at timestamp_ntz"


def files(spark, batches):
    """One file per batch, read in this order."""
    path = scratch_path(spark, "sessionize-in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream):
    out = scratch_path(spark, "sessionize-out")
    run_available(stream.writeStream.format("parquet").option("path", out), scratch_path(spark, "sessionize-ckpt"))
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(out).collect()), key=repr)


def fixture():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c", None]), rnd.choice(["/x", "/y", None]), BASE + dt.timedelta(seconds=7 * i + rnd.randrange(5), microseconds=rnd.randrange(10**6)))
            for i in range(240)]
    rows += [(1000, "a", "/x", None), (1001, "a", "/x", rows[5][3]), (1002, "a", "/x", rows[5][3])]
    end = [(9999, "end", "/end", BASE + dt.timedelta(days=9))]  # moves the watermark past everything else
    # each file holds rows that are up to some minutes out of order, within the delay
    rows = sorted(rows, key=lambda r: ((r[3] or BASE) + dt.timedelta(seconds=rnd.randrange(300)), r[0]))
    return [rows[:80], rows[80:90], rows[90:170], rows[170:], end]


@pytest.mark.parametrize("kind", ["repeats", "typing"])
def test_stream_equals_batch(spark, kind):
    batches = fixture()
    every = spark.createDataFrame([r for b in batches[:-1] for r in b], SCHEMA)
    names = every.columns
    if kind == "repeats":
        want = sessionize.suppress_repeats(every, 20)
        got = suppress_repeats_stream(files(spark, batches), 20, delay="20 minutes")
    else:
        want = sessionize.collapse_typing(every, 15, ts="visited_at")
        got = collapse_typing_stream(files(spark, batches), 15, ts="visited_at", delay="20 minutes")
    want = sorted(map(tuple, want.select(names).collect()), key=repr)
    assert 50 < len(want) < 243 and run(spark, got) == want


def test_late_rows(spark):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    # 3 comes when the watermark of the batch before is still behind it: kept, though 2 is decided
    batches = [[(1, "a", "/x", at(0))], [(2, "a", "/y", at(120))], [(3, "a", "/x", at(1)), (4, "a", "/y", at(119))], [(5, "end", "/", at(10**5))]]
    assert [r[0] for r in run(spark, suppress_repeats_stream(files(spark, batches), 30, delay="10 minutes"))] == [1, 2, 3, 4]
    # 3 is behind the watermark of the batch before: left out; 4 and 5 come while 2 still waits
    batches = [[(1, "a", "/x", at(0))], [(2, "a", "/y", at(120))], [(9, "z", "/", at(125))], [(3, "a", "/x", at(0.1)), (4, "a", "/y", at(120.2)), (5, "a", "/y", at(120.4))],
               [(8, "end", "/", at(10**5))]]
    assert [r[0] for r in run(spark, suppress_repeats_stream(files(spark, batches), 30, delay="2 minutes"))] == [1, 2, 9]
    got = run(spark, collapse_typing_stream(files(spark, batches), 30, ts="visited_at", delay="2 minutes"))
    assert [r[0] for r in got] == [1, 5, 9]
