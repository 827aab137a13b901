"""The window-free subscriber fold against a plain Python state machine."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kpiforge import schemas
from kpiforge.operators import lives, scans, subscribers

BASE = dt.datetime(2024, 1, 1)


def machine(actions):
    """Apply actions one by one, as the request handlers did."""
    rows = {}
    for seq, ts, action, email, name, status in sorted(actions):
        r = rows.get(email)
        if action == "subscribe":
            if r is None:
                rows[email] = dict(id=seq, full_name=name, status="active", source="website", subscribed_at=ts,
                                   unsubscribed_at=None)
            elif r["status"] == "unsubscribed":
                r.update(status="active", unsubscribed_at=None, subscribed_at=ts,
                         full_name=name if name is not None else r["full_name"])
        elif action == "add":
            if r is None:
                rows[email] = dict(id=seq, full_name=name, status="active", source="admin", subscribed_at=ts,
                                   unsubscribed_at=None)
            else:
                r.update(status="active", unsubscribed_at=None, full_name=name if name is not None else r["full_name"])
        elif action == "unsubscribe":
            if r is not None and r["status"] == "active":
                r.update(status="unsubscribed", unsubscribed_at=ts)
        elif action == "set_status":
            if r is not None:
                r.update(status=status, unsubscribed_at=ts if status == "unsubscribed" else None)
        elif action == "delete":
            rows.pop(email, None)
    return rows


def random_log(rng, n, emails=3, start=0):
    out = []
    for i in range(start, start + n):
        action = rng.choice(["subscribe", "subscribe", "unsubscribe", "add", "set_status", "delete"])
        name = rng.choice([None, f"n{i}"])
        status = rng.choice(["active", "unsubscribed"]) if action == "set_status" else None
        out.append((i, BASE + dt.timedelta(seconds=i), action, f"e{rng.randrange(emails)}@x", name, status))
    return out


def to_df(spark, log):
    rows = [(s, t, a, e, None, None, n, st) for s, t, a, e, n, st in log]
    return spark.createDataFrame(rows, schemas.ACTIONS)


def spark_fold(spark, log, chunk, snapshot=None):
    good, _ = subscribers.validate_actions(to_df(spark, log))
    return subscribers.fold_subscribers(good, None, "newsletter", chunk_size=chunk, snapshot=snapshot)


def as_dict(df):
    keep = ["id", "full_name", "status", "source", "subscribed_at", "unsubscribed_at"]
    return {r["email"]: {k: r[k] for k in keep} for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_fold_equals_state_machine(spark, seed):
    rng = random.Random(seed)
    log = random_log(rng, 40)
    assert as_dict(spark_fold(spark, log, chunk=4)) == machine(log)


def test_snapshot_continuation_equals_full_fold(spark):
    rng = random.Random(7)
    first, second = random_log(rng, 30), random_log(rng, 30, start=30)
    snap = spark_fold(spark, first, chunk=8)
    cont = spark_fold(spark, second, chunk=8, snapshot=snap)
    assert as_dict(cont) == machine(first + second)


@pytest.mark.parametrize("lead", [False, True])
def test_keyed_lag_matches_plain_window(spark, lead):
    rng = random.Random(11)
    rows = [(rng.choice("abc"), i, rng.randrange(100)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r["o"]: r["x"] for r in scans.keyed_lag(df, "k", "o", "v", "x", chunk_size=5, lead=lead).collect()}
    w = Window.partitionBy("k").orderBy("o")
    fn = F.lead if lead else F.lag
    want = {r["o"]: r["x"] for r in df.withColumn("x", fn("v").over(w)).collect()}
    assert got == want


def machine_outcomes(actions):
    rows, out = {}, {}
    for seq, ts, action, email, name, status in sorted(actions):
        r = rows.get(email)
        if action == "subscribe":
            out[seq] = "subscribed" if r is None else ("reactivated" if r == "unsubscribed" else "already_subscribed")
            rows[email] = "active"
        elif action == "add":
            out[seq] = "added" if r is None else "updated"
            rows[email] = "active"
        elif action == "unsubscribe":
            out[seq] = "unsubscribed" if r == "active" else "not_active"
            if r == "active":
                rows[email] = "unsubscribed"
        elif action == "set_status":
            out[seq] = "no_row" if r is None else "status_set"
            if r is not None:
                rows[email] = status
        else:
            out[seq] = "no_row" if r is None else "deleted"
            rows.pop(email, None)
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_outcomes_equal_state_machine(spark, seed):
    log = random_log(random.Random(seed), 40)
    good, _ = subscribers.validate_actions(to_df(spark, log))
    got = {r["seq"]: r["outcome"] for r in subscribers.action_outcomes(good, chunk_size=4).collect()}
    assert got == machine_outcomes(log)


def test_keyed_last_before_matches_plain_window(spark):
    rng = random.Random(13)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, rng.randrange(100)])) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r["o"]: r["x"] for r in scans.keyed_last_before(df, "k", "o", "v", "x", chunk_size=4).collect()}
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    want = {r["o"]: r["x"] for r in df.withColumn("x", F.last("v", ignorenulls=True).over(w)).collect()}
    assert got == want


def keyed_log(rng, n, start=0, known=()):
    """A log in which unsubscribes carry tokens, status changes and deletes ids: real, stale and invented ones."""
    out, made = [], list(known)
    for i in range(start, start + n):
        action = rng.choice(["subscribe", "subscribe", "add", "unsubscribe", "set_status", "delete", "delete"])
        email = f"e{rng.randrange(3)}@x"
        status = rng.choice(["active", "unsubscribed"]) if action == "set_status" else None
        token = row_id = None
        if action in ("unsubscribe", "set_status", "delete") and rng.random() < 0.85:
            of, seq = rng.choice(made) if made and rng.random() < 0.9 else ("none@x", 10**6 + i)
            email = None
            if action == "unsubscribe":
                token = hashlib.sha256(f"newsletter|{of}|{seq}".encode()).hexdigest()
            else:
                row_id = seq
        out.append((i, BASE + dt.timedelta(seconds=i), action, email, token, row_id, rng.choice([None, f"n{i}"]), status))
        if action in ("subscribe", "add"):
            made.append((email, i))
    return out, made


def by_mail(log):
    """The same log as handlers saw it: each key looked up among the rows of that moment (None: no such row)."""
    rows, out, missed = {}, [], set()
    for seq, t, action, email, token, row_id, name, status in log:
        if email is None:
            found = [e for e, i in rows.items() if i == row_id or hashlib.sha256(f"newsletter|{e}|{i}".encode()).hexdigest() == token]
            if not found:
                missed.add(seq)
                continue
            email = found[0]
        if action in ("subscribe", "add"):
            rows.setdefault(email, seq)
        elif action == "delete":
            rows.pop(email, None)
        out.append((seq, t, action, email, name, status))
    return out, missed


@pytest.mark.parametrize("seed", range(6))
def test_actions_by_token_and_id_equal_state_machine(spark, seed):
    rng = random.Random(100 + seed)
    log, made = keyed_log(rng, 60)
    plain, missed = by_mail(log)
    good, _ = subscribers.validate_actions(spark.createDataFrame(log, schemas.ACTIONS))
    counted, stale = lives.resolve_actions(good, "newsletter", chunk_size=8)
    assert {r["seq"] for r in stale.collect()} == missed
    assert {r["seq"]: r["email"] for r in counted.collect()} == {a[0]: a[3] for a in plain}
    assert as_dict(subscribers.fold_subscribers(counted, None, "newsletter", chunk_size=8)) == machine(plain)
    # continued from a snapshot, whose tokens and ids are those issued before
    first = subscribers.fold_subscribers(counted, None, "newsletter", chunk_size=8)
    more, _ = keyed_log(rng, 40, 60, made)
    plain, missed = by_mail(log + more)
    good, _ = subscribers.validate_actions(spark.createDataFrame(more, schemas.ACTIONS))
    counted, stale = lives.resolve_actions(good, "newsletter", first, chunk_size=8)
    assert {r["seq"] for r in stale.collect()} == {s for s in missed if s >= 60}
    assert as_dict(subscribers.fold_subscribers(counted, None, "newsletter", chunk_size=8, snapshot=first)) == machine(plain)
