"""Tables that micro-batches append to, without a file or folder per epoch for ever.

Each epoch writes one part and publishes it in a commit log (``sources.commits``)
together with the run (one per checkpoint) and the epoch number: a retried
epoch that was published changes nothing, an epoch out of turn or of another run
stops the job.  Parts are merged in tiers: when ``fan`` parts of one tier stand
together they become one part of the next, so a table of n epochs has at most
fan * log(n) parts and a row is rewritten log(n) times, not once per epoch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.commits import CommitLog
from ..sources.sinks import by_day

FAN = 8


def next_version(log: CommitLog, run: str, epoch: int) -> tuple[int, dict | None] | None:
    """(version to publish, newest entry) for ``epoch``; None if it is published already."""
    last = log.last()
    if last is not None and last["run"] != run:
        raise RuntimeError(f"{log.path} holds versions of another run; use a new folder")
    done = -1 if last is None else last["epoch"]
    if epoch == done:
        return None
    if epoch != done + 1:
        raise RuntimeError(f"the version of epoch {epoch - 1} is missing under {log.path}: the newest is that of epoch {done}")
    return (0 if last is None else last["version"] + 1), last


def write_epoch(df: DataFrame, path: str, run: str, epoch: int, partition: str | None = None,
                merge: Callable[[DataFrame], DataFrame] | None = None, fan: int = FAN) -> None:
    """Append the rows of one epoch; ``merge`` folds the rows of merged parts (default: keeps them)."""
    spark = df.sparkSession
    log = CommitLog(spark, path)
    found = next_version(log, run, epoch)
    if found is None:
        return
    version, last = found
    parts, tiers = ([], []) if last is None else (last["parts"], last["tiers"])

    def write(rows: DataFrame) -> str:
        part = log.fresh_part()
        if partition is None:
            rows.write.parquet(part)
        else:
            by_day(rows, partition).write.partitionBy(partition).parquet(part)
        return part

    parts, tiers = [*parts, write(df)], [*tiers, 0]
    while len(tiers) >= fan and len(set(tiers[-fan:])) == 1:
        rows = _read(spark, parts[-fan:], df.schema)
        parts, tiers = [*parts[:-fan], write(rows if merge is None else merge(rows))], [*tiers[:-fan], tiers[-1] + 1]
    log.publish(version - 1, parts, tiers=tiers, run=run, epoch=epoch, schema=df.schema.json())


def _read(spark: SparkSession, parts: list[str], schema: T.StructType) -> DataFrame:
    """The parts side by side: Spark finds partition folders under one root at a time."""
    out = None
    for part in parts:
        rows = spark.read.schema(schema).parquet(part).select(schema.names)
        out = rows if out is None else out.unionByName(rows)
    return out


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all epochs; a partition column is kept, so bounds on it skip folders."""
    last = CommitLog(spark, path).last()
    if last is None:
        raise FileNotFoundError(f"no epoch was published under {path}")
    return _read(spark, last["parts"], T.StructType.fromJson(json.loads(last["schema"])))
