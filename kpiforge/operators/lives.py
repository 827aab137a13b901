"""H2, H4, H5: actions that name a subscriber by token or id.

An unsubscribe link carries the token of a row, an admin's status change or delete
its id; both belong to one *life* of an e-mail: from the action that created the row
until the delete that ended it.  The action counts only if that very life is the
current one when it arrives, so an old link, or an id of a deleted and later re-added
subscriber, does nothing.  Tokens and ids may have been issued earlier in the same batch.

Which lives exist depends on which deletes by id count, and the other way round.
``resolve_actions`` starts from all deletes that may count (the first for each id,
with no delete by e-mail in between) and drops those whose id turns out not to be
that of a created row.  Dropping a delete can only turn later creations into
updates, so the set shrinks to the true one; a log whose ids were all real is
settled in the first round.  Each round is one chunked scan (``scans.keyed_last_before``)
over the e-mails that such actions touch, never a window over a whole e-mail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .scans import DEFAULT_CHUNK, keyed_last_before

_MAKING = ("subscribe", "add")


def names_row(token: str = "token", row_id: str = "id") -> Column:
    """Does an action without e-mail name a row: an unsubscribe by token, a status change or delete by id?"""
    act = F.col("action")
    return ((act == "unsubscribe") & F.col(token).isNotNull()) | (act.isin("set_status", "delete") & F.col(row_id).isNotNull())


def issued_token(salt: str, email: Column, seq: Column) -> Column:
    """The token of the row that action ``seq`` creates for ``email``."""
    return F.sha2(F.concat_ws("|", F.lit(salt), email, seq.cast("string")), 256)


def _created(rows: DataFrame, chunk_size: int) -> DataFrame:
    """``rows`` (email, seq, act, want) with ``_new``: does the action create a row, given the deletes among them?"""
    life = F.when(F.col("act").isin(*_MAKING, "state", "delete"), F.col("act"))
    found = keyed_last_before(rows, "email", "seq", life, "_life", chunk_size)
    free = F.col("_life").isNull() | (F.col("_life") == "delete")
    return found.withColumn("_new", F.col("act").isin(*_MAKING, "state") & free).drop("_life")


def resolve_actions(actions: DataFrame, salt: str, snapshot: DataFrame | None = None,
                    chunk_size: int = DEFAULT_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(actions that count, with their e-mail filled in; actions by token or id that name no current row).

    ``actions`` as accepted by ``subscribers.validate_actions``, ``seq`` unique and above those of
    ``snapshot`` (the subscriber table before them).
    """
    plain = actions.filter(F.col("email").isNotNull())
    named = materialize(actions.filter(F.col("email").isNull()), "named-actions")
    if named.isEmpty():
        return plain, named
    key = F.when(F.col("action") == "unsubscribe", F.concat(F.lit("t:"), "token")).otherwise(F.concat(F.lit("i:"), F.col("id").cast("string")))
    made = plain.filter(F.col("action").isin(*_MAKING)).select(
        "email", F.col("seq").alias("want"), F.col("seq").alias("made_at"), issued_token(salt, F.col("email"), F.col("seq")).alias("_t"))
    if snapshot is not None:
        made = made.unionByName(snapshot.select("email", F.col("id").alias("want"), F.lit(-1).cast("bigint").alias("made_at"), F.col("confirm_token").alias("_t")))
    keys = F.array(F.concat(F.lit("t:"), "_t"), F.concat(F.lit("i:"), F.col("want").cast("string")))
    made = made.select("email", "want", "made_at", F.explode(keys).alias("_key"))
    hits = (named.drop("email").withColumn("_key", key).join(made.filter("_key is not null"), "_key")
            .filter(F.col("made_at") < F.col("seq")).drop("_key"))
    hits = materialize(hits, "named-hits")

    touched = hits.select("email").distinct()
    log = plain.join(touched, "email", "left_semi").select("email", "seq", F.col("action").alias("act"), F.col("seq").alias("want"))
    if snapshot is not None:
        log = log.unionByName(snapshot.join(touched, "email", "left_semi").select(
            "email", F.lit(-1).cast("bigint").alias("seq"), F.lit("state").alias("act"), F.col("id").alias("want")))
    log = materialize(log, "named-log")

    probes = hits.select("email", "seq", F.lit("probe").alias("act"), "want")
    by_mail = F.when(F.col("act") == "delete", F.col("seq"))
    gone = keyed_last_before(log.unionByName(probes), "email", "seq", by_mail, "_gone", chunk_size).filter("act = 'probe'")
    open_ = hits.filter("action = 'delete'").join(gone.select("seq", "_gone"), "seq").filter("_gone is null or _gone < made_at")
    deletes = materialize(open_.groupBy("want").agg(F.min_by(F.struct("seq", "email"), "seq").alias("_d")).select(
        F.col("_d.email").alias("email"), F.col("_d.seq").alias("seq"), F.lit("delete").alias("act"), "want"), "named-deletes")
    left = deletes.count()
    while True:
        rows = _created(log.unionByName(deletes), chunk_size)
        real = materialize(deletes.join(rows.filter("_new").select("want"), "want", "left_semi").select(deletes.columns), "named-deletes")
        n = real.count()
        deletes, settled, left = real, n == left, n
        if settled:
            break
    # The current life of an e-mail before each action: the last creation, unless a delete came after it.
    others = probes.join(deletes.select("seq"), "seq", "left_anti").select(probes.columns)
    rows = _created(log.unionByName(deletes).unionByName(others), chunk_size)
    current = F.when(F.col("_new"), F.col("want")).when(F.col("act") == "delete", F.lit(-1).cast("bigint"))
    alive = keyed_last_before(rows, "email", "seq", current, "_now", chunk_size).filter((F.col("act") == "probe") & (F.col("_now") == F.col("want")))
    # Deletes that did not make it into the set are not alive either: the first one ended the life.
    real = materialize(alive.join(hits.filter("action = 'delete'").select("seq"), "seq", "left_anti").select("seq").unionByName(deletes.select("seq")), "named-real")
    counted = hits.join(real, "seq", "left_semi").select(*actions.columns)
    return plain.unionByName(counted), named.join(real, "seq", "left_anti").select(*actions.columns)
