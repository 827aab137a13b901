"""Streaming jobs built from the batch operators.

* Sources are file streams (``readStream`` with an explicit schema); in
  production the same code reads a directory that ingest keeps appending to.
* Every job writes through ``foreachBatch`` into fresh folders and publishes them
  in a commit log with the run and the epoch (``epochs``).  A retried epoch that
  was published changes nothing, so together with the checkpoint the output is
  exactly-once even though the writes themselves are plain Parquet.
* Checkpoints and outputs live under the shared checkpoint folder
  (``spark.checkpoint.dir``), never on a machine-local path.
* Event time: the driver tables carry ``TIMESTAMP_NTZ``; watermarks need
  ``TIMESTAMP``, so the stream converts the wall clock as if UTC (independent
  of the session time zone).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intake, lives, subscribers
from ..session import checkpoint_dir, materialize
from ..sources import events as bodies
from ..sources.commits import CommitLog
from .epochs import next_version, read_epochs, write_epoch


def _base(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def event_stream(spark: SparkSession, directory: str, name: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """Stream the rows of ``<directory>/<name>.parquet`` (and any later files of that name).

    A micro-batch takes all files that are there, unless the caller sets a limit.
    """
    schema = spark.read.parquet(os.path.join(directory, f"{name}.parquet")).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    if files_per_trigger is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(directory)


def run_available(writer, checkpoint: str) -> None:
    """Process everything available now, then stop (the batch-style trigger)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:  # surface failures of the micro-batch function
        raise RuntimeError(str(q.exception()))


def _intake_stream(kind: str, spark: SparkSession, events: DataFrame, sessions: DataFrame, regions: DataFrame,
                   home: str, country_width: int, out: str | None) -> str:
    base = out or _base(spark, f"{kind}-intake")
    checkpoint = os.path.join(base, "_checkpoint")
    run = run_identity(spark, checkpoint)
    fn = intake.visit_intake if kind == "visit" else intake.search_intake
    ts_col = "visited_at" if kind == "visit" else "searched_at"

    def per_batch(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            rows, unread = (batch, None) if "_corrupt" not in batch.columns else bodies.split_bodies(batch)
            good, bad = fn(rows, sessions, regions, home, country_width)
            bad = bad if unread is None else bad.unionByName(unread, allowMissingColumns=True)
            write_epoch(good.withColumn("day", F.to_date(ts_col)), os.path.join(base, "table"), run, epoch, "day")
            write_epoch(bad, os.path.join(base, "quarantine"), run, epoch)
        finally:
            batch.unpersist()

    run_available(events.writeStream.foreachBatch(per_batch), checkpoint)
    return base


def visit_intake_stream(spark, events, sessions, regions, home, country_width=2, out=None) -> str:
    """K1: raw visit events, or JSON bodies as ``sources.events`` reads them -> visits table + quarantine, per micro-batch."""
    return _intake_stream("visit", spark, events, sessions, regions, home, country_width, out)


def search_intake_stream(spark, events, sessions, regions, home, country_width=2, out=None) -> str:
    """K2: raw search events or JSON bodies -> search log + quarantine, per micro-batch."""
    return _intake_stream("search", spark, events, sessions, regions, home, country_width, out)


def read_table(spark: SparkSession, base: str, part: str = "table", with_day: bool = False) -> DataFrame:
    """All epochs of a job's output; ``with_day`` keeps the partition column, so that bounds on it skip folders."""
    df = read_epochs(spark, os.path.join(base, part))
    return df if with_day else df.drop("day")


def live_daily_counts(spark: SparkSession, events: DataFrame, ts: str = "ts", out: str | None = None) -> str:
    """K3: rows per calendar day, kept current.

    Each epoch writes the counts of its own rows per day; merged parts add them up, and so
    does ``read_daily_counts``.  There is no watermark and no state, so rows that come
    late count like all others, and a retried epoch changes nothing.
    """
    base = out or _base(spark, "daily-counts")
    checkpoint = os.path.join(base, "_checkpoint")
    run = run_identity(spark, checkpoint)

    def added(counts: DataFrame) -> DataFrame:
        return counts.groupBy("label").agg(F.sum("value").alias("value"))

    def per_batch(batch: DataFrame, epoch: int) -> None:
        # unix_timestamp reads NTZ as UTC, so days are wall-clock days whatever the session time zone
        day = F.date_from_unix_date(F.floor(F.unix_timestamp(F.col(ts)) / 86400).cast("int"))
        rows = batch.filter(F.col(ts).isNotNull()).select(F.date_format(day, "yyyy-MM-dd").alias("label"))
        write_epoch(rows.groupBy("label").agg(F.count("*").alias("value")), os.path.join(base, "table"), run, epoch, merge=added)

    run_available(events.writeStream.foreachBatch(per_batch), checkpoint)
    return base


def read_daily_counts(spark: SparkSession, base: str) -> DataFrame:
    """The day counts over all epochs of K3."""
    return read_table(spark, base).groupBy("label").agg(F.sum("value").alias("value"))


#: Parts of the subscriber table (a whole one and the changes since) from which the next version is written whole again.
COMPACT_PARTS = 16


def run_identity(spark: SparkSession, checkpoint: str) -> str:
    """The name of the run that owns ``checkpoint``, made once and kept beside the stream's own state."""
    log = CommitLog(spark, os.path.join(checkpoint, "_run"))
    found = log.last()
    if found is None:
        log.publish(-1, [], run=uuid.uuid4().hex)
        found = log.last()
    return found["run"]


def _current(rows: DataFrame) -> DataFrame:
    """The newest row of each e-mail over all parts, without those that are gone."""
    columns = [c for c in rows.columns if c not in ("_version", "_gone")]
    newest = rows.groupBy("email").agg(F.max_by(F.struct(*[c for c in columns if c != "email"], "_gone"), "_version").alias("_r"))
    return newest.filter("not _r._gone").select(*[F.col(c) if c == "email" else F.col(f"_r.{c}").alias(c) for c in columns])


def read_subscribers(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The subscriber table of K4 at its newest (or the given) version."""
    log = CommitLog(spark, base)
    found = log.last() if version is None else log.entry(version)
    if found is None:
        raise FileNotFoundError(f"no version was published under {base}")
    return _current(spark.read.parquet(*found["parts"]))


def subscriber_batch_writer(base: str, users: DataFrame | None, salt: str, run: str, compact_parts: int = COMPACT_PARTS):
    """The K4 micro-batch function: fold this batch onto the table and publish what changed as the next version.

    A version is a change log: the parts of the table written so far and one with the rows of the
    e-mails that this batch touches (a tombstone for those that have no row now), so what is written
    follows the batch, not the table.  Reading takes the newest row of each e-mail.  Every
    ``compact_parts`` versions the table is written whole.

    Epoch e is published by run ``run`` (one per checkpoint, ``run_identity``) right after its epoch
    e - 1; a retried epoch that was published before changes nothing.  Anything else stops the job:
    versions of another run, a version that is missing, or an epoch out of turn would
    lose subscribers.
    """
    def per_batch(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        log = CommitLog(spark, base)
        found = next_version(log, run, epoch)
        if found is None:
            return
        version, last = found
        parts = [] if last is None else last["parts"]
        batch = batch.persist()
        try:
            good, bad = subscribers.validate_actions(batch)
            prev = None
            if parts:
                rows = spark.read.parquet(*parts)
                named = good.filter(F.col("email").isNull())
                by_token = rows.join(named.select(F.col("token").alias("confirm_token")), "confirm_token", "left_semi")
                by_id = rows.join(named.filter("token is null").select("id"), "id", "left_semi")
                touched = good.select("email").union(by_token.select("email")).union(by_id.select("email")).filter("email is not null")
                prev = materialize(_current(rows.join(touched.distinct(), "email", "left_semi")), "subscribers-before")
            counted, stale = lives.resolve_actions(good, salt, prev)
            counted = materialize(counted, "subscribers-actions")
            before = None if prev is None else prev.join(counted.select("email").distinct(), "email", "left_semi")
            now = subscribers.fold_subscribers(counted, users, salt, snapshot=before).withColumn("_gone", F.lit(False))
            if before is not None:
                now = materialize(now, "subscribers-now")
                gone = before.join(now.select("email"), "email", "left_anti").withColumn("_gone", F.lit(True))
                now = now.unionByName(gone.select(now.columns))
            now = now.withColumn("_version", F.lit(version).cast("bigint"))
            if len(parts) + 1 > compact_parts:
                whole = _current(rows.unionByName(now)).withColumn("_gone", F.lit(False))
                now, parts = whole.withColumn("_version", F.lit(version).cast("bigint")), []
            part = log.fresh_part()
            now.write.parquet(part)
            bad = bad.unionByName(stale.withColumn("reason", F.lit("no such row")), allowMissingColumns=True)
            bad.write.mode("overwrite").parquet(os.path.join(base, "quarantine", f"batch={epoch}"))
            log.publish(version - 1, [*parts, part], run=run, epoch=epoch)
        finally:
            batch.unpersist()

    return per_batch


def live_subscribers(spark: SparkSession, actions: DataFrame, users: DataFrame | None, salt: str,
                     out: str | None = None, compact_parts: int = COMPACT_PARTS) -> tuple[str, DataFrame]:
    """K4: keep the subscriber table current from a stream of actions (by e-mail, token or id).

    Returns the output folder and the table at its newest version.
    """
    base = out or _base(spark, "subscribers")
    checkpoint = os.path.join(base, "_checkpoint")
    writer = subscriber_batch_writer(base, users, salt, run_identity(spark, checkpoint), compact_parts)
    run_available(actions.writeStream.foreachBatch(writer), checkpoint)
    if CommitLog(spark, base).last_version() < 0:
        raise RuntimeError("the action stream delivered no batch")
    return base, read_subscribers(spark, base)
