"""H1-H6: newsletter subscriber state as a fold over an ordered action log.

The source system mutates one row per request (subscribe, unsubscribe by
token, admin add, set status, delete, save campaign).  Here the input is an
action log ``(seq, ts, action, email, name, status)`` with e-mails already
resolved (``lives.resolve_actions`` maps unsubscribe tokens and admin ids to
the e-mails of the rows that they name), and the output is the resulting
subscriber table.

Why it is a set computation (two statuses only, guarded at intake):
* after any delete the e-mail has no row, so only actions after the last
  delete matter, and the row is created by the first subscribe/add after it;
* the status after an action on an existing row depends only on the action;
  so the status *before* an action is the previous action's result (a lag);
* every other field is "the last action of some kind" (a ``max_by``),
  valid only when that action comes after the creating one.

Plan: two keyed scans (``scans.keyed_lag`` and ``keyed_last_before``, chunked so
a hot e-mail is spread over tasks) and one aggregate per e-mail with conditional
``max_by`` columns, the creating action among them: the last subscribe or add
that found no row.  No window or join is partitioned by the log's raw e-mail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SUBSCRIBER_STATUSES
from .filters import optional_equals, text_search
from .joins import link_user_by_email
from .lives import issued_token, names_row
from .scans import DEFAULT_CHUNK, keyed_lag, keyed_last_before

ACTIONS = ["subscribe", "unsubscribe", "add", "set_status", "delete"]


def normalise_email(c):
    return F.lower(F.trim(c))


def validate_actions(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into (accepted, quarantined with reason).  E-mail normalised to lower(trim()).

    An action without e-mail is accepted if it names a row by token or id
    (``lives.resolve_actions`` finds the row).
    """
    email = normalise_email(F.col("email"))
    reason = (F.when(~F.col("action").isin(*ACTIONS) | F.col("action").isNull(), F.lit("unknown action"))
              .when(email.isNull() & ~names_row(), F.lit("no email"))
              .when(F.locate("@", email) == 0, F.lit("invalid email"))
              .when((F.col("action") == "set_status") & ~F.coalesce(F.col("status").isin(*SUBSCRIBER_STATUSES), F.lit(False)),
                    F.lit("unsupported status")))
    tagged = actions.withColumn("email", email).withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


_CARRY = [("_sid", "bigint"), ("_stoken", "string"), ("_ssource", "string"), ("_suser", "bigint"),
          ("_sunsub", "timestamp_ntz")]


def snapshot_as_actions(snapshot: DataFrame) -> DataFrame:
    """A subscriber table as 'state' actions (seq -1, before any new action) that
    recreate each row with its id, token, source, user and times."""
    return snapshot.select(
        F.lit(-1).cast("bigint").alias("seq"), F.col("subscribed_at").alias("ts"), F.lit("state").alias("action"),
        F.col("email"), F.col("full_name").alias("name"), F.col("status"),
        F.col("id").alias("_sid"), F.col("confirm_token").alias("_stoken"), F.col("source").alias("_ssource"),
        F.col("user_id").alias("_suser"), F.col("unsubscribed_at").alias("_sunsub"))


def fold_subscribers(actions: DataFrame, users: DataFrame | None, salt: str,
                     chunk_size: int = DEFAULT_CHUNK, snapshot: DataFrame | None = None) -> DataFrame:
    """Subscriber table after applying validated actions in ``seq`` order.

    With ``snapshot`` (the table before these actions, new seq values all
    >= 0), the result equals folding the whole history: each snapshot row
    enters as a 'state' action that creates the row as it was.
    """
    a = actions.select("seq", "ts", "action", "email", "name", "status",
                       *[F.lit(None).cast(t).alias(c) for c, t in _CARRY])
    if snapshot is not None:
        a = a.unionByName(snapshot_as_actions(snapshot))
    after = (F.when(F.col("action").isin("subscribe", "add"), F.lit("active"))
             .when(F.col("action") == "state", F.col("status"))
             .when(F.col("action") == "unsubscribe", F.lit("unsubscribed"))
             .when(F.col("action") == "set_status", F.col("status"))
             .otherwise(F.lit("deleted")))
    a = keyed_lag(a.withColumn("_after", after), "email", "seq", "_after", "_prev", chunk_size)
    life = F.when(F.col("action").isin("subscribe", "add", "state", "delete"), F.col("action"))
    a = keyed_last_before(a, "email", "seq", life, "_life", chunk_size)

    act, prev = F.col("action"), F.col("_prev")
    creating = act.isin("subscribe", "add", "state") & (F.col("_life").isNull() | (F.col("_life") == "delete"))
    resub = (act == "subscribe") & (prev == "unsubscribed")
    named = ((act == "add") | resub) & F.col("name").isNotNull()
    touch = (act.isin("set_status", "add")) | resub | ((act == "unsubscribe") & (prev == "active"))
    unsub_value = F.when((act == "unsubscribe") | ((act == "set_status") & (F.col("status") == "unsubscribed")), F.col("ts"))

    def last_where(cond, *fields):
        return F.max_by(F.when(cond, F.struct(F.col("seq").alias("seq"), *fields)), F.when(cond, F.col("seq")))

    per_mail = a.groupBy("email").agg(
        F.max(F.when(act == "delete", F.col("seq"))).alias("last_del"),
        F.max_by(F.col("_after"), F.col("seq")).alias("status"),
        last_where(named, F.col("name").alias("v")).alias("_name"),
        last_where(resub, F.col("ts").alias("v")).alias("_resub"),
        last_where(touch, unsub_value.alias("v")).alias("_touch"),
        last_where(creating, "ts", "action", "name", *[c for c, _ in _CARRY]).alias("_c"),
    )
    c = F.col("_c")
    s = per_mail.filter(F.col("last_del").isNull() | (c["seq"] > F.col("last_del"))).filter(c.isNotNull())

    def since_creation(field):
        return F.col(field)["seq"] > c["seq"]

    state = c["action"] == "state"
    out = s.select(
        F.coalesce(c["_sid"], c["seq"]).alias("id"),
        F.col("email"),
        F.when(since_creation("_name"), F.col("_name")["v"]).otherwise(c["name"]).alias("full_name"),
        c["action"].alias("_created_by"),
        c["_suser"].alias("_state_user"),
        F.col("status"),
        F.coalesce(c["_stoken"], issued_token(salt, F.col("email"), c["seq"])).alias("confirm_token"),
        F.when(state, c["_ssource"]).when(c["action"] == "subscribe", F.lit("website")).otherwise(F.lit("admin")).alias("source"),
        F.when(since_creation("_resub"), F.col("_resub")["v"]).otherwise(c["ts"]).alias("subscribed_at"),
        F.when(since_creation("_touch"), F.col("_touch")["v"]).otherwise(c["_sunsub"]).alias("unsubscribed_at"),
    )
    if users is None:
        linked = out.withColumn("linked_user_id", F.lit(None).cast("bigint"))
    else:
        wanted = actions.select(normalise_email(F.col("email")).alias("_mail"))
        linked = link_user_by_email(out, users, wanted=wanted)
    return linked.select(
        "id", "email", "full_name",
        F.when(F.col("_created_by") == "subscribe", F.col("linked_user_id"))
        .when(F.col("_created_by") == "state", F.col("_state_user")).alias("user_id"),
        "status", "confirm_token", "source", "subscribed_at", "unsubscribed_at")


def action_outcomes(actions: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """The handler's answer to every validated action, in the action log's terms.

    A row exists right before an action when the last subscribe/add/delete
    before it is a subscribe or add; its status then is the result of the
    previous action.  Outcomes: subscribe -> subscribed / reactivated /
    already_subscribed; add -> added / updated; unsubscribe -> unsubscribed /
    not_active (invalid or used link); set_status -> status_set / no_row;
    delete -> deleted / no_row.
    """
    a = actions.select("seq", "ts", "action", "email", "status")
    after = (F.when(F.col("action").isin("subscribe", "add"), F.lit("active"))
             .when(F.col("action") == "unsubscribe", F.lit("unsubscribed"))
             .when(F.col("action") == "set_status", F.col("status"))
             .otherwise(F.lit("deleted")))
    a = keyed_lag(a.withColumn("_after", after), "email", "seq", "_after", "_prev", chunk_size)
    life = F.when(F.col("action").isin("subscribe", "add", "delete"), F.col("action"))
    a = keyed_last_before(a, "email", "seq", life, "_life", chunk_size)
    act, prev = F.col("action"), F.col("_prev")
    exists = F.coalesce(F.col("_life").isin("subscribe", "add"), F.lit(False))
    outcome = (F.when(act == "subscribe", F.when(~exists, F.lit("subscribed"))
                      .when(prev == "unsubscribed", F.lit("reactivated")).otherwise(F.lit("already_subscribed")))
               .when(act == "add", F.when(exists, F.lit("updated")).otherwise(F.lit("added")))
               .when(act == "unsubscribe", F.when(exists & (prev == "active"), F.lit("unsubscribed"))
                     .otherwise(F.lit("not_active")))
               .when(act == "set_status", F.when(exists, F.lit("status_set")).otherwise(F.lit("no_row")))
               .otherwise(F.when(exists, F.lit("deleted")).otherwise(F.lit("no_row"))))
    return a.select("seq", "email", "action", outcome.alias("outcome"))


def stale_outcomes(stale: DataFrame) -> DataFrame:
    """The answers to actions by token or id that name no current row."""
    answer = F.when(F.col("action") == "unsubscribe", F.lit("not_active")).otherwise(F.lit("no_row"))
    return stale.select("seq", F.lit(None).cast("string").alias("email"), "action", answer.alias("outcome"))


def subscriber_list(subs: DataFrame, query: str | None = None, status: str | None = None, n: int = 300) -> DataFrame:
    """Newest first, at most ``n``; literal case-insensitive search on e-mail or name."""
    df = optional_equals(text_search(subs, ["email", "full_name"], query), "status", status)
    return df.orderBy(F.col("id").desc()).limit(n).select(
        "id", "email", F.col("full_name").alias("name"), "status", "source",
        F.date_format("subscribed_at", "yyyy-MM-dd HH:mm").alias("at"),
        F.when(F.col("user_id").isNotNull(), 1).otherwise(0).alias("registered"))


def save_campaigns(campaigns: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """H6: apply (edit_id, id?, subject, body_html, created_by) edits.

    An edit with an id updates subject and body when that campaign is a
    draft (the last edit wins) and changes nothing otherwise; an edit without
    an id inserts a new draft (id = max id + edit_id).  The source's update
    branch could never run (S27); this implements its evident intent.
    """
    from .joins import one_row_join
    from ..functions import lit_ts

    drafts = campaigns.filter(F.col("status") == "draft").select(F.col("id").alias("_did"))
    e = edits.join(drafts, edits["id"] == drafts["_did"], "left")
    upd = e.filter(F.col("_did").isNotNull()).groupBy("_did").agg(
        F.max_by(F.struct("subject", "body_html"), "edit_id").alias("_u"))
    updated = (campaigns.join(upd, campaigns["id"] == upd["_did"], "left")
               .withColumn("subject", F.coalesce(F.col("_u.subject"), F.col("subject")))
               .withColumn("body_html", F.when(F.col("_u").isNotNull(), F.col("_u.body_html")).otherwise(F.col("body_html")))
               .select(*campaigns.columns))
    ins = e.filter(F.col("id").isNull())
    max_id = campaigns.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    inserted = one_row_join(ins, max_id).select(
        (F.col("_max") + F.col("edit_id")).cast("bigint").alias("id"), "subject", "body_html",
        F.lit("draft").alias("status"), F.lit(0).cast("bigint").alias("recipients"),
        F.lit(0).cast("bigint").alias("sent_count"), F.lit(0).cast("bigint").alias("fail_count"),
        lit_ts(as_of).alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("sent_at"),
        F.coalesce(F.col("created_by"), F.lit("admin")).alias("created_by"))
    return updated.unionByName(inserted)
