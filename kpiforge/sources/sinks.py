"""Writing results.

* ``append_events`` adds rows to a day-partitioned Parquet table (the
  source's INSERT per request becomes an append of a whole batch).
* ``write_snapshot`` never overwrites the folder a job may be reading: each
  version goes to its own folder and is published in a commit log
  (``commits``); readers take the newest, and two writers cannot both
  publish from one parent.
* ``export_csv`` writes a headered CSV folder for spreadsheet users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog


def by_day(df: DataFrame, partition: str) -> DataFrame:
    """Rows dealt for a write partitioned by day: few files a day, however many tasks made the rows.

    Spark deals the rows by day and then evens the tasks out by size (``REBALANCE``, adaptive
    execution): a hot day is split over several tasks of
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``, small days share one.
    """
    return df.hint("rebalance", partition)


def append_events(df: DataFrame, path: str, ts: str, partition: str = "day") -> None:
    """Append, partitioned by calendar day of ``ts`` (so day filters prune folders)."""
    by_day(df.withColumn(partition, F.to_date(F.col(ts))), partition).write.mode("append").partitionBy(partition).parquet(path)


def write_snapshot(df: DataFrame, path: str, parent: int | None = None) -> int:
    """A10: write a new version of the whole table and publish it; returns its number.

    With ``parent`` (the version that ``df`` was made from, -1 for none) the new version is published
    only if that is still the newest one; else ``CommitConflict`` is raised and nothing changes.
    """
    log = CommitLog(df.sparkSession, path)
    if parent is None:
        parent = log.last_version()
    part = log.fresh_part()
    df.write.parquet(part)
    return log.publish(parent, [part])


def snapshot_version(spark: SparkSession, path: str) -> int:
    """The newest version, -1 if none was published."""
    return CommitLog(spark, path).last_version()


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest (or the given) published version."""
    log = CommitLog(spark, path)
    found = log.last() if version is None else log.entry(version)
    if found is None:
        raise FileNotFoundError(f"no version was published under {path}")
    return spark.read.parquet(*found["parts"])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header row."""
    df.write.mode("overwrite").option("header", True).csv(path)
