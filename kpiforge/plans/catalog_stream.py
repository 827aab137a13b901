"""Catalog, part 4: the streaming jobs, each run to completion (availableNow) and read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import schemas
from .. import streaming as ST
from ..operators import subscribers as SUB
from ..session import scratch_path
from ..sources import adapters as A
from ..sources import events as EV
from ..sources import sinks
from ..sources.adapters import with_views
from ..sources.tables import seed_categories, seed_regions
from .catalog import AS_OF, HOME, register
from .catalog_more import INTAKE_COUNTRY_WIDTH, SALT, SEARCH_INTAKE_SQL, VISIT_INTAKE_SQL, _fold_with, _visit_reason


def _visit_stream(s, d):
    ev = A.visit_events(s, d, events=ST.event_stream(s, d))
    base = ST.visit_intake_stream(s, ev, A.sessions(s, d), seed_regions(s), HOME, INTAKE_COUNTRY_WIDTH)
    return ST.jobs.read_table(s, base)


def _search_stream(s, d):
    ev = A.search_events(s, d, events=ST.event_stream(s, d))
    base = ST.search_intake_stream(s, ev, A.sessions(s, d), seed_regions(s), HOME, INTAKE_COUNTRY_WIDTH)
    return ST.jobs.read_table(s, base)


def _daily_stream(s, d):
    base = ST.live_daily_counts(s, ST.event_stream(s, d))
    return ST.read_daily_counts(s, base)


def _subs_stream(s, d):
    acts = A.actions(s, d, events=ST.event_stream(s, d))
    return ST.live_subscribers(s, acts, A.users(s, d), SALT)[1]


register("visit_intake_stream", VISIT_INTAKE_SQL)(_visit_stream)
register("search_intake_stream", SEARCH_INTAKE_SQL)(_search_stream)
# ----------------------------------------------------------- JSON bodies --
# The events as JSON lines, some of them spoilt: cut off in the middle, of an unknown format version, with an over-long token.
def _spoilt(s, events):
    """(text lines) of ``events``; the fault of a line follows its event_id."""
    i = F.col("event_id")
    rows = events.withColumn("token", F.when(i % 89 == 0, F.repeat(F.lit("t"), 300)).otherwise(F.col("token")))
    body = F.to_json(F.struct(*rows.columns, F.when(i % 83 == 0, 9).otherwise(EV.SCHEMA_VERSION).alias("schema_version")),
                     {"timestampNTZFormat": EV.TIMES})
    return rows.select(F.when(i % 97 == 0, F.substring(body, 1, 40)).otherwise(body).alias("value"))


def _body_stream(s, d, kind):
    events = (A.visit_events if kind == "visit" else A.search_events)(s, d)
    path = scratch_path(s, f"{kind}-bodies")
    _spoilt(s, events).write.text(path)
    read = EV.read_visit_events if kind == "visit" else EV.read_search_events
    job = ST.visit_intake_stream if kind == "visit" else ST.search_intake_stream
    return job(s, read(s, path, stream=True), A.sessions(s, d), seed_regions(s), HOME, INTAKE_COUNTRY_WIDTH)


_READABLE = "event_id % 97 <> 0 AND event_id % 83 <> 0 AND event_id % 89 <> 0"
register("visit_bodies_stream", VISIT_INTAKE_SQL + f" AND e.{_READABLE.replace('AND event', 'AND e.event')}")(
    lambda s, d: ST.jobs.read_table(s, _body_stream(s, d, "visit")))
register("search_bodies_stream", SEARCH_INTAKE_SQL + f" AND e.{_READABLE.replace('AND event', 'AND e.event')}")(
    lambda s, d: ST.jobs.read_table(s, _body_stream(s, d, "search")))
register("body_quarantine", with_views(
    "SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN event_id % 97 = 0 THEN 'unreadable body' WHEN event_id % 83 = 0 "
    "THEN 'unsupported schema version' ELSE reason END AS reason FROM (SELECT *, "
    f"{_visit_reason(INTAKE_COUNTRY_WIDTH)} AS reason FROM (SELECT * REPLACE (CASE WHEN event_id % 89 = 0 THEN repeat('t', 300) "
    "ELSE token END AS token) FROM visit_events) v) e) q WHERE reason IS NOT NULL GROUP BY 1", "visit_events"))(
    lambda s, d: ST.jobs.read_table(s, _body_stream(s, d, "visit"), "quarantine").groupBy("reason").agg(F.count("*").alias("rows")))


# A10: the subscriber table through the snapshot store, the second version made from the first.
def _stored_subscribers(s, d):
    path = scratch_path(s, "subscriber-snapshots")
    good, _ = SUB.validate_actions(A.actions(s, d))
    half = F.col("seq") < 5000
    first = sinks.write_snapshot(SUB.fold_subscribers(good.filter(half), A.users(s, d), SALT), path)
    more = SUB.fold_subscribers(good.filter(~half), A.users(s, d), SALT, snapshot=sinks.read_snapshot(s, path))
    sinks.write_snapshot(more, path, parent=first)
    return sinks.read_snapshot(s, path)


register("stored_subscribers", _fold_with("SELECT * FROM subs"))(_stored_subscribers)

# The category seed through a CSV export.
def _exported_categories(s, d):
    path = scratch_path(s, "categories-csv")
    sinks.export_csv(seed_categories(s), path)
    return s.read.option("header", True).schema(schemas.CATEGORIES).csv(path)


register("exported_categories", with_views("SELECT * FROM categories_seed", "categories_seed"))(_exported_categories)

register("live_daily_counts",
         "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS label, count(*) AS value FROM events GROUP BY 1")(
    _daily_stream)
register("live_subscribers", _fold_with("SELECT * FROM subs"))(_subs_stream)
