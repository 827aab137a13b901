"""Lookups and key joins.

Broadcast hints are only placed on tables whose size is fixed (the 13-row
region seed, the category seed, one-row aggregates).  Lookups whose size
grows with the data (sessions per token, users per e-mail) are joined
without a hint: the planner broadcasts them only when their estimated size
is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks with runtime
sizes) and otherwise shuffles both sides on the key; AQE splits
a hot key on the large side only if the lookup was written first: an aggregate
between the join and its shuffle rules that out.  Sessions are not looked up but
swept in time order together with the events (``attach_user``).

Lookups are pre-aggregated to one row per key before the join, so a lookup
can never duplicate an event.  NULL join keys are replaced by a per-row value
that can never match, so rows without a key do not all hash into one
shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .scans import keyed_running


def one_row_join(base: DataFrame, *ones: DataFrame) -> DataFrame:
    """Attach the columns of one-row aggregates (no GROUP BY) to every row of ``base``.

    Each right side has exactly one row by construction, so broadcasting it
    is bounded; the output has as many rows as ``base``.
    """
    out = base.withColumn("_one", F.lit(0))
    for o in ones:
        out = out.join(F.broadcast(o.withColumn("_one", F.lit(0))), "_one", "inner")
    return out.drop("_one")


def never_null_key(key: Column, row_id: Column) -> Column:
    """``key``, or for NULL a unique value no real key can equal (spreads NULL rows)."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), row_id.cast("string")))


def never_null_id(key: Column, row_id: Column) -> Column:
    """Numeric form of ``never_null_key`` for non-negative id keys: NULL -> -1 - row id."""
    return F.coalesce(key, -1 - F.abs(row_id.cast("bigint")))


#: Seconds of a chunk of the session sweep: what one task sees of a token at most.
SWEEP_CHUNK_S = 3600


def session_edges(sessions: DataFrame) -> DataFrame:
    """(_tok, _t, _dn, _dx, _du): what changes at each start and end of an active session.

    ``_dn`` counts sessions, ``_dx`` holds the user id, ``_du`` counts sessions without a user.  A session
    counts from ``created_at`` (NULL: always) until before ``expires_at`` (S19).
    """
    begin = F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))
    active = sessions.filter((F.col("is_active") == 1) & F.col("token").isNotNull() & (begin < F.col("expires_at")))
    edge = [F.struct(t.alias("t"), F.lit(d).cast("bigint").alias("d")) for t, d in ((begin, 1), (F.col("expires_at"), -1))]
    return active.select(F.col("token").alias("_tok"), "user_id", F.explode(F.array(*edge)).alias("_e")).select(
        "_tok", F.col("_e.t").alias("_t"), F.col("_e.d").alias("_dn"), F.col("user_id").cast("bigint").alias("_dx"),
        F.when(F.col("user_id").isNull(), F.col("_e.d")).otherwise(0).cast("bigint").alias("_du"))


def attach_user(events: DataFrame, sessions: DataFrame, at: str = "received_at", token: str = "token",
                row_id: str = "event_id", chunk_s: int = SWEEP_CHUNK_S) -> DataFrame:
    """Add ``session_user_id``, NULL unless the token has exactly one session valid at the event's own time.

    One sweep in time order over the starts and ends of a token's sessions and its events: the
    running count says whether exactly one session is open, and the running exclusive-or of the
    user ids then is its user.  So an event meets its session without a range join, sessions
    that start later or have ended do not count, and two open ones give no user, as the
    source's single-row lookup failed on TOO_MANY_ROWS.  The sweep is chunked by time, so a hot
    token is spread over tasks.  Events without a time have no user.
    """
    keyed = events.select(F.struct(*events.columns).alias("_row"), never_null_key(F.col(token), F.col(row_id)).alias("_tok"),
                          F.col(at).alias("_t"), F.lit(1).alias("_kind"))
    edges = session_edges(sessions).withColumn("_kind", F.lit(0))
    # unix_timestamp reads NTZ as UTC: chunks follow the wall clock whatever the session time zone
    chunk = F.coalesce(F.floor(F.unix_timestamp("_t") / chunk_s), F.lit(-(1 << 62))).cast("bigint")
    swept = keyed_running(keyed.unionByName(edges, allowMissingColumns=True), "_tok", ["_t", "_kind"],
                          {"_n": ("sum", "_dn"), "_x": ("bit_xor", "_dx"), "_u": ("sum", "_du")}, chunk)
    alone = (F.col("_n") == 1) & (F.col("_u") == 0)
    return swept.filter("_kind = 1").select("_row.*", F.when(alone, F.col("_x")).alias("session_user_id"))


def attach_region(events: DataFrame, regions: DataFrame, home: str, country: str = "country_code",
                  code: str = "region_code") -> DataFrame:
    """Region name for home-country rows with a known code (S20), else NULL."""
    r = F.broadcast(regions.select(F.col("code").alias("_rc"), F.col("name").alias("region_name_lookup")))
    cond = (F.col(country) == F.lit(home)) & (F.col(code) == F.col("_rc"))
    return events.join(r, cond, "left").drop("_rc")


def has_email(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions whose user exists and has an e-mail (EXISTS -> left semi join)."""
    with_mail = users.filter(F.col("email").isNotNull()).select(F.col("id").alias("user_id"))
    return sessions.join(with_mail, "user_id", "left_semi")


def oldest_user_by_email(users: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """lower(email) -> oldest (minimum) user id; one row per key.

    With ``wanted`` (a column ``_mail`` of keys to look up) only those keys are kept.
    Users are counted up per key first, in every task, so an e-mail that many
    users share is one row per task; if the wanted keys are few enough to be broadcast, the
    optimizer moves their semi join below the aggregate, and the users table is not shuffled.
    """
    u = users.filter(F.col("email").isNotNull()).select(F.lower("email").alias("_mail"), "id")
    oldest = u.groupBy("_mail").agg(F.min("id").alias("linked_user_id"))
    if wanted is None:
        return oldest
    return oldest.join(wanted.select("_mail").filter(F.col("_mail").isNotNull()).distinct(), "_mail", "left_semi")


def link_user_by_email(rows: DataFrame, users: DataFrame, email: str = "email",
                       wanted: DataFrame | None = None) -> DataFrame:
    """Add ``linked_user_id`` by case-insensitive e-mail; oldest account wins.

    ``wanted`` (column ``_mail``, cheap to compute) narrows the users lookup
    to those keys first; pass it when the key set is small next to the users
    table (a micro-batch), and build it from the input, not from ``rows``
    itself when ``rows`` is expensive (it would be computed twice).
    """
    keyed = rows.withColumn("_mail", F.lower(F.trim(F.col(email))))
    return keyed.join(oldest_user_by_email(users, wanted), "_mail", "left").drop("_mail")


def _user_keys(users: DataFrame) -> DataFrame:
    """Unpivot users into (kind, key, user_id): e-mail and username lower-cased, phone raw."""
    keys = users.select(
        "id",
        F.explode(F.array(
            F.struct(F.lit("email").alias("kind"), F.lower(F.trim("email")).alias("key")),
            F.struct(F.lit("username").alias("kind"), F.lower(F.trim("username")).alias("key")),
            F.struct(F.lit("phone").alias("kind"), F.trim(F.col("phone")).alias("key")),
        )).alias("k"))
    return keys.select("k.kind", "k.key", F.col("id").alias("user_id")).filter(F.col("key").isNotNull())


def availability(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Is each (kind, value) candidate still free?  Keys are normalised like the users'."""
    norm = F.when(F.col("kind") == "phone", F.trim("value")).otherwise(F.lower(F.trim("value")))
    keyed = candidates.withColumn("key", norm)
    # only keys of some candidate matter; grouped first, a key that many users hold is one row per task
    taken = (_user_keys(users).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_holders"))
             .join(keyed.select("kind", "key").distinct(), ["kind", "key"], "left_semi"))
    # written, so that the skew join below can split a value that many candidates ask for
    taken = materialize(taken, "taken-keys")
    return (keyed.join(taken, ["kind", "key"], "left")
            .select(*candidates.columns, F.col("_holders").isNull().alias("available")))


def resolve_identity(logins: DataFrame, users: DataFrame, identifier: str = "identifier",
                     login_id: str = "login_id") -> DataFrame:
    """C11: login identifier -> user by e-mail, username or phone.

    The OR over three columns becomes one equi-join against the unpivoted
    key table (no nested-loop join).  Several matches: e-mail beats username
    beats phone, then the oldest id.  Unmatched logins keep a NULL user.
    """
    raw = F.trim(F.col(identifier))
    probe = logins.select(
        login_id, identifier,
        F.explode(F.array(F.lower(raw), raw)).alias("key")).distinct()
    prio = F.when(F.col("kind") == "email", 0).when(F.col("kind") == "username", 1).otherwise(2)
    keys = (_user_keys(users).join(probe.select("key").distinct(), "key", "left_semi")
            .groupBy("kind", "key").agg(F.min("user_id").alias("user_id")).withColumn("_prio", prio))
    matched = probe.join(keys, "key", "inner")
    best = matched.groupBy(login_id).agg(
        F.min_by(F.struct("user_id", "kind"), F.struct("_prio", "user_id")).alias("_m"))
    return (logins.select(login_id, identifier).join(best, login_id, "left")
            .select(login_id, identifier, F.col("_m.user_id").alias("user_id"), F.col("_m.kind").alias("matched_by")))
