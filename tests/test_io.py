"""Sources, sinks and streaming jobs."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, ts
from kpiforge import streaming
from kpiforge.operators import intake, lives, subscribers
from kpiforge.plans.catalog import AS_OF, HOME
from kpiforge.session import checkpoint_dir
from kpiforge.sources import adapters as A
from kpiforge.sources import events, sinks
from kpiforge.sources.commits import CommitConflict, CommitLog
from kpiforge.sources.tables import seed_regions
from kpiforge.streaming import epochs


def _scratch(spark):
    base = os.path.join(checkpoint_dir(spark), "test-io")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(dir=base)


def test_snapshot_versions_and_csv(spark):
    root = _scratch(spark)
    df1 = spark.createDataFrame([(1, "a")], "id long, v string")
    df2 = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    snap = os.path.join(root, "snap")
    assert sinks.snapshot_version(spark, snap) == -1
    assert sinks.write_snapshot(df1, snap) == 0 and sinks.read_snapshot(spark, snap).count() == 1
    assert sinks.write_snapshot(df2, snap, parent=0) == 1 and sinks.read_snapshot(spark, snap).count() == 2
    assert sinks.read_snapshot(spark, snap, version=0).count() == 1
    sinks.export_csv(df2, os.path.join(root, "csv"))
    back = spark.read.option("header", True).csv(os.path.join(root, "csv"))
    assert back.columns == ["id", "v"] and back.count() == 2


def test_two_writers_from_one_parent_cannot_both_publish(spark):
    snap = os.path.join(_scratch(spark), "snap")
    sinks.write_snapshot(spark.range(1), snap)
    parent = sinks.snapshot_version(spark, snap)
    sinks.write_snapshot(spark.range(2), snap, parent=parent)
    with pytest.raises(CommitConflict):
        sinks.write_snapshot(spark.range(3), snap, parent=parent)
    assert sinks.read_snapshot(spark, snap).count() == 2
    # data that was prepared and never published is not seen
    spark.range(9).write.parquet(CommitLog(spark, snap).fresh_part())
    assert sinks.read_snapshot(spark, snap).count() == 2


def test_append_events_partitions_by_day(spark):
    root = _scratch(spark)
    df = spark.createDataFrame([(1, ts("2024-01-01 10:00:00")), (2, ts("2024-01-02 10:00:00"))],
                               "id long, visited_at timestamp_ntz")
    sinks.append_events(df, os.path.join(root, "visits"), "visited_at")
    sinks.append_events(df, os.path.join(root, "visits"), "visited_at")
    back = spark.read.parquet(os.path.join(root, "visits"))
    assert back.count() == 4 and back.filter(F.col("day") == dt.date(2024, 1, 2)).count() == 2


def test_append_writes_few_files_a_day(spark):
    """However many tasks made the rows; a hot day is split by size, not into a file per task."""
    root = _scratch(spark)
    hot = F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5)
    df = spark.range(0, 40000, 1, 40).select("id", F.timestamp_add("DAY", hot.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("visited_at"))
    path = os.path.join(root, "visits")
    sinks.append_events(df, path, "visited_at")
    files = {d: len([f for f in os.listdir(os.path.join(path, d)) if f.endswith(".parquet")]) for d in os.listdir(path) if d.startswith("day=")}
    assert len(files) == 4 and max(files.values()) <= 2
    assert spark.read.parquet(path).count() == 40000
    split = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    before = {k: spark.conf.get(k) for k in split}
    try:
        for k, v in split.items():
            spark.conf.set(k, v)
        sinks.append_events(df, path + "-split", "visited_at")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {d: len([f for f in os.listdir(os.path.join(path + "-split", d)) if f.endswith(".parquet")]) for d in os.listdir(path + "-split") if d.startswith("day=")}
    assert 2 <= max(files.values()) < 40


def test_epochs_are_merged_in_tiers_and_keep_the_day(spark):
    path = os.path.join(_scratch(spark), "table")
    for epoch in range(11):
        rows = spark.createDataFrame([(epoch, dt.date(2024, 1, 1 + epoch % 3))] if epoch != 5 else [], "id long, day date")
        epochs.write_epoch(rows, path, "run", epoch, "day", fan=3)
        epochs.write_epoch(rows, path, "run", epoch, "day", fan=3)  # a retry changes nothing
    assert CommitLog(spark, path).last()["tiers"] == [2, 0, 0]
    back = epochs.read_epochs(spark, path)
    assert sorted(r.id for r in back.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    one = back.filter(F.col("day") == dt.date(2024, 1, 2))
    assert sorted(r.id for r in one.collect()) == [1, 4, 7, 10] and "PartitionFilters: [isnotnull(day" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(RuntimeError, match="another run"):
        epochs.write_epoch(back, path, "other", 11, "day")
    with pytest.raises(RuntimeError, match="missing"):
        epochs.write_epoch(back, path, "run", 13, "day")


def test_json_bodies_and_claims(spark):
    root = _scratch(spark)
    path = os.path.join(root, "bodies.json")
    with open(path, "w") as f:
        good = {"event_id": 1, "received_at": "2024-01-01T10:00:00.123456", "token": "t1", "country": "sa", "path": "/x", "schema_version": 1}
        for line in (good, "not json", good | {"schema_version": 2}, good | {"event_id": None}, good | {"event_id": "many"}, {"path": "/y"}):
            f.write((line if isinstance(line, str) else json.dumps(line)) + "\n")
    ok, bad = events.split_bodies(events.read_visit_events(spark, path))
    assert [(r.event_id, r.received_at, r.token) for r in ok.collect()] == [(1, dt.datetime(2024, 1, 1, 10, 0, 0, 123456), "t1")]
    assert sorted(r.reason for r in bad.collect()) == ["no event id or time", "unreadable body", "unreadable body", "unsupported schema version", "unsupported schema version"]
    assert [r.body for r in bad.filter("body = 'not json'").collect()] == ["not json"]
    c = spark.createDataFrame([(1, '{"aud": "x", "email": "A@B"}')], "seq long, claim_json string")
    got = events.read_claims(c).first()
    assert got["aud"] == "x" and got["email"] == "A@B" and got["iss"] is None


def test_visit_stream_equals_batch(spark):
    d = SF_SMALL
    sess, regions = A.sessions(spark, d), seed_regions(spark)
    base = streaming.visit_intake_stream(spark, A.visit_events(spark, d, events=streaming.event_stream(spark, d)),
                                         sess, regions, HOME, 10)
    streamed = streaming.jobs.read_table(spark, base)
    batch, bad = intake.visit_intake(A.visit_events(spark, d), sess, regions, HOME, 10)
    assert streamed.count() == batch.count()
    assert streamed.select(batch.columns).exceptAll(batch).count() == 0
    q = streaming.jobs.read_table(spark, base, "quarantine")
    assert q.count() == bad.count()


def _batches(actions, bounds):
    return [actions.filter((F.col("seq") >= a) & (F.col("seq") < b)) for a, b in zip(bounds, bounds[1:])]


@pytest.mark.parametrize("keyed", [False, True])
def test_subscriber_stream_equals_batch_fold(spark, keyed):
    """K4 over several micro-batches, each version a change log, equals one fold of everything; a compacted one, too."""
    acts = (A.keyed_actions if keyed else A.actions)(spark, SF_SMALL).cache()
    counted, _ = lives.resolve_actions(subscribers.validate_actions(acts)[0], "newsletter")
    full = subscribers.fold_subscribers(counted, None, "newsletter").cache()
    for compact in (3, 16):
        root = _scratch(spark)
        write = streaming.subscriber_batch_writer(root, None, "newsletter", "run", compact)
        for epoch, batch in enumerate(_batches(acts, [0, 300, 500, 510, 1 << 40])):
            write(batch, epoch)
            write(batch, epoch)  # a retried epoch changes nothing
        log = CommitLog(spark, root)
        assert log.last_version() == 3 and len(log.last()["parts"]) == (1 if compact == 3 else 4)
        streamed = streaming.read_subscribers(spark, root)
        assert streamed.count() == full.count() > 0
        assert streamed.select(full.columns).exceptAll(full).count() == 0


def test_subscriber_stream_writes_only_what_changed(spark):
    root = _scratch(spark)
    names = "seq long, ts timestamp_ntz, action string, email string, token string, id long, name string, status string"
    day = dt.datetime(2024, 1, 1)
    write = streaming.subscriber_batch_writer(root, None, "newsletter", "run")
    write(spark.createDataFrame([(i, day, "add", f"u{i}@x", None, None, None, None) for i in range(500)], names), 0)
    write(spark.createDataFrame([(500, day, "delete", None, None, 7, None, None), (501, day, "add", "new@x", None, None, None, None),
                                 (502, day, "delete", None, None, 7, None, None)], names), 1)
    parts = CommitLog(spark, root).last()["parts"]
    assert spark.read.parquet(parts[1]).count() == 2 and streaming.read_subscribers(spark, root).count() == 500
    stale = spark.read.parquet(os.path.join(root, "quarantine", "batch=1")).collect()
    assert [(r.seq, r.reason) for r in stale] == [(502, "no such row")]


def test_subscriber_stream_refuses_a_foreign_or_truncated_folder(spark):
    """K4 must not fold onto nothing, nor onto another run's versions."""
    acts = A.actions(spark, SF_SMALL).limit(10).cache()
    root = _scratch(spark)
    write = streaming.subscriber_batch_writer(root, None, "newsletter", "run")
    with pytest.raises(RuntimeError, match="missing"):
        write(acts, 2)
    write(acts, 0)
    other = streaming.subscriber_batch_writer(root, None, "newsletter", "other run")
    for epoch in (0, 1):
        with pytest.raises(RuntimeError, match="another run"):
            other(acts, epoch)
    with pytest.raises(RuntimeError, match="missing"):
        write(acts, 2)
    write(acts, 1)
    write(acts, 2)
    commits = os.path.join(root, "_commits")
    middle = os.path.join(commits, f"{1:020d}.json")
    os.rename(middle, os.path.join(root, "lost"))
    with pytest.raises(RuntimeError, match="truncated"):
        write(acts, 3)
    os.rename(os.path.join(root, "lost"), middle)
    os.rename(os.path.join(commits, f"{0:020d}.json"), os.path.join(root, "lost"))
    with pytest.raises(RuntimeError, match="truncated"):
        write(acts, 3)


def test_run_identity_belongs_to_the_checkpoint(spark):
    a, b = _scratch(spark), _scratch(spark)
    assert streaming.run_identity(spark, a) == streaming.run_identity(spark, a) != streaming.run_identity(spark, b)


def test_daily_counts_keep_late_rows(spark, tmp_path):
    """K3 over several files, the last of which is days late."""
    for day in (10, 12, 9):
        rows = [(dt.datetime(2024, 1, day, 5),), (dt.datetime(2024, 1, day, 6),), (None,)]
        spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    base = streaming.live_daily_counts(spark, stream, out=str(tmp_path / "out"))
    found = {r.label: r.value for r in streaming.read_daily_counts(spark, base).collect()}
    assert found == {"2024-01-09": 2, "2024-01-10": 2, "2024-01-12": 2}
