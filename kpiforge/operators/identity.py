"""Account identity (dedupe, session repointing, merges, sign-in upsert).

Everything here groups by a normalised key with an aggregate (partial
aggregation absorbs a hot key such as a shared placeholder e-mail) and joins
the one-row-per-key result back; no window is partitioned by a raw key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GOOGLE_ISSUERS, REFRESH_DAYS, SESSION_DAYS
from ..session import materialize
from .joins import never_null_id, never_null_key, oldest_user_by_email, one_row_join


# ---------------------------------------------------------------- H9, H10 --
def account_mapping(users: DataFrame) -> DataFrame:
    """id -> canonical id (oldest id sharing the lower-cased e-mail); e-mail users only."""
    # Written first: AQE splits a hot e-mail only if no aggregate stands between the join and its shuffle.
    canon = materialize(oldest_user_by_email(users), "oldest-users")
    return (users.filter(F.col("email").isNotNull())
            .withColumn("_mail", F.lower("email"))
            .join(canon, "_mail", "inner")
            .select("id", F.col("linked_user_id").alias("canonical_id")))


def dedupe_accounts(users: DataFrame) -> DataFrame:
    """H9: keep the oldest account per e-mail ignoring case; NULL e-mails untouched."""
    m = account_mapping(users)
    return (users.join(m, "id", "left")
            .filter(F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("id")))
            .drop("canonical_id"))


def repoint_sessions(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions of duplicate accounts follow the canonical account."""
    m = account_mapping(users).select(F.col("id").alias("_uk"), "canonical_id")
    keyed = sessions.withColumn("_uk", never_null_id(F.col("user_id"), F.col("session_id")))
    return (keyed.join(m, "_uk", "left")
            .withColumn("user_id", F.coalesce("canonical_id", "user_id"))
            .select(*sessions.columns))


# -------------------------------------------------------------------- H11 --
def resolve_chains(mapping: DataFrame) -> DataFrame:
    """Follow src -> dst -> dst2 ... to the final destination by pointer jumping.

    Each round replaces dst by dst's own destination, doubling the resolved
    chain length, so a chain of length L needs log2(L) rounds.  The loop stops
    when a round resolves nothing more; rows still pointing at a source then
    lie on (or lead into) a cycle and are returned with status 'rejected'.
    Duplicate sources (two destinations for one id) are rejected too.  Each
    round is written to the shared checkpoint folder, once, and read from there.
    """
    m = mapping.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    dup = m.groupBy("src").agg(F.count_distinct("dst").alias("_n")).filter(F.col("_n") > 1).select("src")
    m = m.join(dup, "src", "left_anti").filter(F.col("src") != F.col("dst")).distinct()
    cur = materialize(m.select("src", "dst"), "merge-chains")
    srcs = cur.select(F.col("src").alias("_s"))

    def unresolved(df: DataFrame) -> int:
        return df.join(srcs, df.dst == srcs._s, "left_semi").count()

    left = unresolved(cur)
    while left:
        nxt = cur.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        cur = materialize(cur.join(nxt, cur.dst == nxt._s, "left").select("src", F.coalesce("_d", "dst").alias("dst")), "merge-chains")
        now = unresolved(cur)
        if now >= left:
            break
        left = now
    cycle = cur.join(srcs, cur.dst == srcs._s, "left_semi").select("src")
    status = (cur.join(cycle.withColumn("_cyc", F.lit(True)), "src", "left")
              .select("src", F.when(F.col("_cyc").isNull(), F.col("dst")).alias("dst"),
                      F.when(F.col("_cyc"), F.lit("rejected: cycle")).otherwise(F.lit("ok")).alias("status")))
    rejected_dup = (mapping.select("src").join(dup, "src", "left_semi").distinct()
                    .select("src", F.lit(None).cast(mapping.schema["dst"].dataType).alias("dst"),
                            F.lit("rejected: several destinations").alias("status")))
    return status.unionByName(rejected_dup)


def merge_accounts(users: DataFrame, sessions: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move sessions of each source account to its final destination, drop the source,
    and give the destination the e-mail of its oldest merged source (when it has one).

    Returns (users, sessions, resolved mapping with status).
    """
    resolved = resolve_chains(mapping)
    ok = resolved.filter(F.col("status") == "ok").select("src", "dst")
    keyed = sessions.withColumn("_uk", never_null_id(F.col("user_id"), F.col("session_id")))
    moved = (keyed.join(ok.withColumnRenamed("src", "_uk"), "_uk", "left")
             .withColumn("user_id", F.coalesce("dst", "user_id")).select(*sessions.columns))
    src_mail = (ok.join(users.select(F.col("id").alias("src"), F.col("email").alias("_m")), "src", "inner")
                .filter(F.col("_m").isNotNull())
                .groupBy("dst").agg(F.min_by("_m", "src").alias("_new_mail")))
    kept = users.join(ok.select(F.col("src").alias("id")), "id", "left_anti")
    merged = (kept.join(src_mail.withColumnRenamed("dst", "id"), "id", "left")
              .withColumn("email", F.coalesce("_new_mail", "email")).select(*users.columns))
    return merged, moved, resolved


# -------------------------------------------------------------------- H12 --
def stitch_visitors(visits: DataFrame) -> DataFrame:
    """Tie every visit of a visitor to the user that visitor last signed in as."""
    known = (visits.filter(F.col("user_id").isNotNull() & F.col("visitor_id").isNotNull())
             .groupBy("visitor_id").agg(F.max_by("user_id", F.struct("visited_at", "id")).alias("_known")))
    known = materialize(known, "known-visitors")  # written first, as in account_mapping
    keyed = visits.withColumn("_vk", never_null_key(F.col("visitor_id"), F.col("id")))
    return (keyed.join(known.withColumnRenamed("visitor_id", "_vk"), "_vk", "left")
            .select("id", "visitor_id", "user_id", F.coalesce("user_id", "_known").alias("stitched_user_id")))


# ------------------------------------------------------------ A6, B10, H7, H8 --
def read_claims(df: DataFrame, json_col: str = "claim_json") -> DataFrame:
    """Parse identity claims from JSON text (fields absent in the text are NULL)."""
    from ..sources.events import read_claims as parse

    return parse(df, json_col)


def claim_checks(audiences: list[str], issuers: list[str] = GOOGLE_ISSUERS) -> F.Column:
    """TRUE only when every check is TRUE; a NULL aud/iss/verified fails."""
    ok = (F.col("aud").isin(*audiences) & F.col("iss").isin(*issuers)
          & (F.col("email_verified") == "true") & F.col("email").isNotNull())
    return F.coalesce(ok, F.lit(False))


def valid_signins(claims: DataFrame, audiences: list[str], issuers: list[str] = GOOGLE_ISSUERS) -> tuple[DataFrame, DataFrame]:
    """Split parsed sign-ins into (valid with normalised e-mail, rejected with a reason)."""
    ok = claim_checks(audiences, issuers)
    reason = (F.when(F.col("email").isNull(), F.lit("no email"))
              .when(~F.coalesce(F.col("aud").isin(*audiences), F.lit(False)), F.lit("audience"))
              .when(~F.coalesce(F.col("iss").isin(*issuers), F.lit(False)), F.lit("issuer"))
              .otherwise(F.lit("email not verified")))
    good = claims.filter(ok).withColumn("email", F.lower(F.trim("email")))
    bad = claims.filter(~ok).withColumn("reason", reason)
    return good, bad


def sign_in_upsert(users: DataFrame, signins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H7: apply valid sign-ins (seq, ts, email, name, picture) to the users table.

    Known e-mail (ignoring case, oldest id wins): avatar filled only when
    empty (first non-NULL picture), last_login_at = latest sign-in.  Unknown
    e-mail: one new user per e-mail, created from its earliest sign-in, type
    user_normal, status active, username = part before '@', or that plus
    '-' and the new id when the name is taken by an existing user or by an
    earlier new e-mail of the same batch (S30); where somebody has that made-up
    name, too, the id is padded with zeros beyond the longest name there is, so
    all names are distinct.
    New ids are max(existing id) + first sign-in seq + 1: unique, repeatable
    and computed without a global row numbering.

    Returns (users after the batch, sign-ins with resolved ``user_id``).
    """
    per_mail = signins.groupBy("email").agg(
        F.min("seq").alias("first_seq"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.min_by("name", "seq").alias("first_name"),
        F.min_by("picture", F.when(F.col("picture").isNotNull(), F.col("seq"))).alias("first_picture"),
    )
    wanted = per_mail.select(F.col("email").alias("_mail"))
    existing = oldest_user_by_email(users, wanted).withColumnRenamed("_mail", "email")
    # one row per signing-in e-mail, read by the insert, update and id branches
    matched = materialize(per_mail.join(existing, "email", "left"), "signin-per-mail")
    known = matched.filter(F.col("linked_user_id").isNotNull())
    new = matched.filter(F.col("linked_user_id").isNull())

    # usernames: taken set from existing users, first-come within the batch
    prefix = F.substring_index(F.col("email"), "@", 1)
    new = new.withColumn("_prefix", prefix).withColumn("_pk", F.lower(prefix))
    # only usernames equal to a new prefix matter: semi join before the distinct
    taken = (users.filter(F.col("username").isNotNull()).select(F.lower("username").alias("_pk"))
             .join(new.select("_pk"), "_pk", "left_semi").distinct())
    first_in_batch = new.groupBy("_pk").agg(F.min_by("email", "first_seq").alias("_winner"))
    new = (new.join(first_in_batch, "_pk", "left")
           .join(taken.withColumn("_taken", F.lit(True)), "_pk", "left"))
    plain_ok = (F.col("_winner") == F.col("email")) & F.col("_taken").isNull()
    max_id = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    new = one_row_join(new, max_id).withColumn("new_id", F.col("_max") + F.col("first_seq") + 1)
    # Made-up names end in their own id, so they only meet existing names and the new plain ones.
    new = new.withColumn("_plain", plain_ok).withColumn("_made", F.concat_ws("-", "_prefix", F.col("new_id").cast("string")))
    plain_names = new.filter("_plain").select("_pk").unionByName(users.filter(F.col("username").isNotNull()).select(F.lower("username").alias("_pk")))
    made = new.filter("not _plain").select(F.lower("_made").alias("_mk"))
    met = plain_names.join(made, F.col("_pk") == F.col("_mk"), "left_semi").distinct().select(F.col("_pk").alias("_mk"), F.lit(True).alias("_met"))
    longest = plain_names.agg(F.coalesce(F.max(F.length("_pk")), F.lit(0)).alias("_longest"))
    new = one_row_join(new.withColumn("_mk", F.lower("_made")).join(met, "_mk", "left"), longest)
    padded = F.concat_ws("-", F.col("_prefix"), F.lpad(F.col("new_id").cast("string"), F.col("_longest") + 20, F.lit("0")))
    username = F.when(F.col("_plain"), F.col("_prefix")).when(F.col("_met"), padded).otherwise(F.col("_made"))

    inserted = new.select(
        F.col("new_id").alias("id"), F.col("email"), F.col("first_name").alias("full_name"),
        username.alias("username"), F.col("first_picture").alias("avatar"),
        F.lit("user_normal").alias("user_type"), F.lit("active").alias("account_status"),
        *[F.lit(None).cast(users.schema[c].dataType).alias(c) for c in
          ("password_hash", "phone", "gender", "country", "city", "university", "degree",
           "research_field", "specialty", "birth_date")],
        F.col("first_ts").alias("registered_at"), F.col("last_ts").alias("last_login_at"),
    ).select(*users.columns)

    upd = known.select(F.col("linked_user_id").alias("id"), F.col("first_picture").alias("_pic"),
                       F.col("last_ts").alias("_last"))
    updated = (users.join(upd, "id", "left")
               .withColumn("avatar", F.when(F.col("_last").isNotNull(), F.coalesce("avatar", "_pic")).otherwise(F.col("avatar")))
               .withColumn("last_login_at", F.coalesce("_last", "last_login_at"))
               .select(*users.columns))
    ids = (known.select("email", F.col("linked_user_id").alias("user_id"))
           .unionByName(new.select("email", F.col("new_id").alias("user_id"))))
    resolved = signins.join(ids, "email", "left")
    return updated.unionByName(inserted), resolved


def open_sessions(resolved_signins: DataFrame, salt: str) -> DataFrame:
    """H8: one session per sign-in: expires +30 days, refresh +60 days, active.

    The session key is a hash of (salt, user, time, seq): repeatable, and no
    bearer secret is minted or stored here.
    """
    ts = F.col("ts")
    return resolved_signins.select(
        F.sha2(F.concat_ws("|", F.lit(salt), F.col("user_id").cast("string"),
                           F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
                           F.col("seq").cast("string")), 256).alias("session_key"),
        "user_id",
        F.timestamp_add("DAY", F.lit(SESSION_DAYS), ts).alias("expires_at"),
        F.timestamp_add("DAY", F.lit(REFRESH_DAYS), ts).alias("refresh_expires_at"),
        F.lit(1).alias("is_active"),
        ts.alias("created_at"),
        ts.alias("last_used_at"),
    )
