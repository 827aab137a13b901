"""Views of the product's tables derived from the driver tables.

Each view is a per-row projection of one driver table, joined only to
dimensions.  ``nation`` and ``region`` have a fixed row count (25 and 5), so
they are broadcast by hint.  ``customer`` grows with the data, so its join is
left to the planner: with statistics under ``autoBroadcastJoinThreshold`` (or
AQE's runtime sizes) it becomes a broadcast, otherwise a shuffle join.

Every view has a twin in ``VIEW_SQL`` (DuckDB dialect) used by the oracle.
The two must stay equal column for column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load

def _k():
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("k", _k())


def customer_geo(spark: SparkSession, d: str) -> DataFrame:
    """customer with its nation and region names (dimension of the events).

    Deduplicated on the key (a no-op on data, c_custkey is the primary key):
    this tells Catalyst the side is distinct on the join key, so a left join
    whose columns a query never uses is removed from the plan, and when it
    is used the aggregate's hash partitioning is reused by the join.
    """
    customer = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = F.broadcast(load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    region = F.broadcast(load(spark, d, "region").select("r_regionkey", "r_name"))
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
        .join(region, F.col("n_regionkey") == region.r_regionkey, "left")
        .select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_regionkey", "r_name")
        .dropDuplicates(["c_custkey"])
    )


def _with_geo(spark: SparkSession, d: str, ev: DataFrame) -> DataFrame:
    """Events left-joined to their customer's geography.

    Events without a user get a per-row negative key (customer keys are
    non-negative), so they never match and do not all hash into one shuffle
    partition.
    """
    geo = customer_geo(spark, d).select("c_custkey", "c_mktsegment", "n_name", "r_regionkey", "r_name")
    key = F.coalesce(F.col("user_id"), -1 - F.col("event_id"))
    return ev.withColumn("_ck", key).join(geo, F.col("_ck") == geo.c_custkey, "left").drop("_ck")


def _case(expr, mapping: dict, default=None):
    out = None
    for key, val in mapping.items():
        out = F.when(expr == key, F.lit(val)) if out is None else out.when(expr == key, F.lit(val))
    return out.otherwise(F.lit(default))


def _device(k):
    return _case(k % 4, {0: "mobile", 1: "desktop", 2: "tablet"}, None)


def _browser(k):
    return _case(k % 5, {0: "Chrome", 1: "Safari", 2: "Firefox", 3: "Edge"}, None)


def _os(uid):
    return _case(uid % 4, {0: "Android", 1: "iOS", 2: "Windows"}, " ")


def visits(spark: SparkSession, d: str) -> DataFrame:
    ev = _with_geo(spark, d, _events(spark, d))
    k, uid = F.col("k"), F.col("user_id")
    visitor = F.concat(F.lit("v"), uid.cast("string"))
    return ev.select(
        F.col("event_id").alias("id"),
        visitor.alias("visitor_id"),
        F.when(uid % 3 == 0, uid).alias("user_id"),
        F.when(uid % 3 == 0, 1).otherwise(0).alias("is_registered"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), k.cast("string")).alias("page_path"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/[id]")).alias("page_pattern"),
        F.col("event_type").alias("page_title"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://ref"), (k % 3).cast("string"), F.lit(".example/")))
        .alias("referrer"),
        F.col("n_name").alias("country_code"),
        F.col("r_regionkey").cast("string").alias("region_code"),
        F.col("r_name").alias("region_name"),
        F.col("c_mktsegment").alias("city"),
        _device(k).alias("device_type"),
        _browser(k).alias("browser"),
        _os(uid).alias("os"),
        F.concat(visitor, F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_key"),
        F.col("ts").alias("visited_at"),
    )


def search_log(spark: SparkSession, d: str) -> DataFrame:
    ev = _with_geo(spark, d, _events(spark, d).filter(F.col("event_type").isin("view", "click")))
    k, uid = F.col("k"), F.col("user_id")
    term = F.concat(F.when(k % 2 == 0, F.lit(" ")).otherwise(F.lit("")), F.lit("Term "), k.cast("string"))
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("v"), uid.cast("string")).alias("visitor_id"),
        F.when(uid % 3 == 0, uid).alias("user_id"),
        term.alias("term"),
        F.lower(F.trim(term)).alias("term_norm"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit(0)).otherwise(k).cast("bigint").alias("results_cnt"),
        F.lit("/search").alias("page_path"),
        F.col("n_name").alias("country_code"),
        F.col("r_name").alias("region_name"),
        F.col("ts").alias("searched_at"),
    )


def users(spark: SparkSession, d: str) -> DataFrame:
    customer = load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = F.broadcast(load(spark, d, "nation").select("n_nationkey", "n_name"))
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    i = F.col("c_custkey")

    def mail(x):
        return F.concat(F.lit("user"), x.cast("string"), F.lit("@example.com"))

    reg = F.timestamp_add("DAY", i % 91, F.lit("2023-11-01 00:00:00").cast("timestamp_ntz"))
    return c.select(
        i.alias("id"),
        F.when(i % 50 == 0, F.lit(None)).when(i % 5 == 4, F.upper(mail(i - 1))).otherwise(mail(i)).alias("email"),
        F.when(i % 10 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("full_name"),
        F.concat(F.lit("u"), i.cast("string")).alias("username"),
        F.when(i % 3 == 0, F.concat(F.lit("/avatars/"), i.cast("string"), F.lit(".png"))).alias("avatar"),
        _case(i % 3, {0: "user_normal", 1: "user_researcher"}, "user_entity").alias("user_type"),
        F.when(i % 7 == 0, F.lit("suspended")).otherwise(F.lit("active")).alias("account_status"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("h"), i.cast("string"))).alias("password_hash"),
        F.when(i % 4 == 1, F.concat(F.lit("+9665"), F.lpad(i.cast("string"), 8, "0"))).alias("phone"),
        _case(i % 5, {0: "M", 1: "male", 2: "F", 3: "Female"}, None).alias("gender"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("city"),
        F.when(i % 6 == 5, F.lit(None)).otherwise(F.concat(F.lit("University "), (i % 6).cast("string"))).alias("university"),
        _case(i % 4, {0: "bachelor", 1: "master", 2: "phd"}, None).alias("degree"),
        F.when(i % 11 == 10, F.lit(None)).otherwise(F.concat(F.lit("Field "), (i % 11).cast("string"))).alias("research_field"),
        F.when(i % 13 == 12, F.lit(None)).otherwise(F.concat(F.lit("Specialty "), (i % 13).cast("string"))).alias("specialty"),
        F.date_add(F.lit("1960-01-01").cast("date"), ((i * 37) % 18000).cast("int")).alias("birth_date"),
        reg.alias("registered_at"),
        F.timestamp_add("DAY", i % 17, reg).alias("last_login_at"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    ev = _events(spark, d)
    k = F.col("k")
    return ev.select(
        F.col("event_id").alias("session_id"),
        F.col("user_id"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 2).cast("string")).alias("token"),
        F.lit(None).cast("string").alias("refresh_token"),
        F.timestamp_add("DAY", F.lit(5), F.col("ts")).alias("expires_at"),
        F.timestamp_add("DAY", F.lit(10), F.col("ts")).alias("refresh_expires_at"),
        (k % 2).cast("int").alias("is_active"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("last_used_at"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("ip_address"),
    )


def actions(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Subscriber action log: one action per event, views mostly dropped (batch or stream)."""
    ev = _events(spark, d) if events is None else events.withColumn("k", _k())
    k, et = F.col("k"), F.col("event_type")
    action = (
        F.when(et == "signup", F.lit("subscribe"))
        .when(et == "error", F.lit("unsubscribe"))
        .when(et == "purchase", F.lit("add"))
        .when(et == "click", F.lit("set_status"))
        .when((et == "view") & (k % 25 == 0), F.lit("delete"))
    )
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        action.alias("action"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("token"),
        F.lit(None).cast("bigint").alias("id"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Name "), k.cast("string"))).alias("name"),
        F.when(et == "click", F.when(k % 17 == 0, F.lit("paused")).when(k % 3 == 0, F.lit("unsubscribed"))
               .otherwise(F.lit("active"))).alias("status"),
    ).filter(F.col("action").isNotNull())


def keyed_actions(spark: SparkSession, d: str, events: DataFrame | None = None, salt: str = "newsletter") -> DataFrame:
    """``actions`` as handlers receive them: unsubscribes mostly by token, status changes and deletes by id.

    The key is that of the row which the e-mail's last subscribe or add before would have created; where a row was
    there already, or has gone since, the key is stale.  Every eleventh token was never issued.
    """
    from ..operators.lives import issued_token
    from ..operators.scans import keyed_last_before

    acts = actions(spark, d, events)
    made = F.when(F.col("action").isin("subscribe", "add"), F.col("seq"))
    acts = keyed_last_before(acts.filter(F.col("email").isNotNull()), "email", "seq", made, "_made").unionByName(
        acts.filter(F.col("email").isNull()), allowMissingColumns=True)
    act, seq, known = F.col("action"), F.col("seq"), F.col("_made").isNotNull()
    by_token = (act == "unsubscribe") & known & (seq % 4 != 0)
    by_id = act.isin("set_status", "delete") & known & ~((act == "delete") & (seq % 6 == 0))
    forged = F.concat(F.lit("forged-"), seq.cast("string"))
    token = F.when(by_token, F.when(seq % 11 == 0, forged).otherwise(issued_token(salt, F.col("email"), F.col("_made"))))
    return acts.select("seq", "ts", "action", F.when(~(by_token | by_id), F.col("email")).alias("email"), token.alias("token"),
                       F.when(by_id, F.col("_made")).alias("id"), "name", "status")


def campaigns(spark: SparkSession, d: str) -> DataFrame:
    r = load(spark, d, "region")
    i = F.col("r_regionkey").cast("bigint")
    sent = i % 2 == 0
    created = F.timestamp_add("DAY", i, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return r.select(
        i.alias("id"),
        F.col("r_name").alias("subject"),
        F.concat(F.lit("<p>News for "), F.col("r_name"), F.lit("</p>")).alias("body_html"),
        F.when(sent, F.lit("sent")).otherwise(F.lit("draft")).alias("status"),
        F.lit(0).cast("bigint").alias("recipients"),
        F.lit(0).cast("bigint").alias("sent_count"),
        F.lit(0).cast("bigint").alias("fail_count"),
        created.alias("created_at"),
        F.when(sent, F.timestamp_add("DAY", F.lit(1), created)).alias("sent_at"),
        F.lit("admin").alias("created_by"),
    )


def send_log(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    failed = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 5).alias("campaign_id"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("sent")).alias("status"),
        F.when(failed, F.lit("HTTP 429 busy")).alias("error_msg"),
        F.col("o_orderdate").alias("sent_at"),
    )


def responses(spark: SparkSession, d: str) -> DataFrame:
    """Mail-service responses, one per (campaign, recipient)."""
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    st = F.col("o_orderstatus")
    code = F.when(st == "O", F.lit(202)).when(st == "F", F.lit(429)).when(F.col("o_orderkey") % 2 == 0, F.lit(None)).otherwise(F.lit(500))
    return o.select(
        F.col("o_orderkey").alias("response_id"),
        (F.col("o_custkey") % 5).alias("campaign_id"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        code.cast("int").alias("http_code"),
        F.when(st == "F", F.lit("busy")).when(st == "P", F.concat(F.lit("server error "), F.col("o_orderkey").cast("string"))).alias("body"),
        F.when(code.isNull(), F.lit("connection reset")).alias("error"),
    )


def categories(spark: SparkSession, d: str) -> DataFrame:
    """Distinct part types as categories (a handful of rows after the aggregate)."""
    p = load(spark, d, "part").select("p_type").distinct()
    t = F.col("p_type")
    return p.select(
        t.alias("code"),
        F.initcap(t).alias("name"),
        F.lower(t).alias("icon"),
        F.concat(F.lit("#"), F.lpad(F.length(t).cast("string"), 6, "0")).alias("color"),
        F.length(t).cast("int").alias("display_order"),
    )


def achievements(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    i = F.col("p_partkey")
    fig = F.when(i % 3 == 0, F.floor(F.col("p_retailprice")).cast("bigint").cast("string"))
    return p.select(
        i.alias("id"),
        (F.lit(2020) + F.col("p_size") % 6).cast("int").alias("year_no"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("summary"),
        fig.alias("figure_value"),
        F.when(fig.isNotNull(), F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("figure_label"),
        F.concat(F.lit("https://example.org/a/"), i.cast("string")).alias("source_url"),
        (i % 2).cast("int").alias("is_featured"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("int").alias("display_order"),
        F.when(i % 7 == 0, F.lit(0)).otherwise(F.lit(1)).cast("int").alias("is_published"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )


def visit_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Raw visit POST bodies (intake input) derived from events (a batch or a stream)."""
    src = _events(spark, d) if events is None else events.withColumn("k", _k())
    ev = _with_geo(spark, d, src)
    k, uid = F.col("k"), F.col("user_id")
    long_tail = F.when(k % 50 == 49, F.repeat(F.lit("x"), 600)).otherwise(F.lit(""))
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("received_at"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.floor(F.col("event_id") / 2).cast("string"))).alias("token"),
        F.lower(F.col("n_name")).alias("country"),
        F.lpad((k % 15).cast("string"), 2, "0").alias("region"),
        F.concat(F.lit("v"), uid.cast("string")).alias("visitor_id"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), k.cast("string"), long_tail).alias("path"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/[id]")).alias("pattern"),
        F.initcap(F.col("event_type")).alias("title"),
        F.lit(None).cast("string").alias("referrer"),
        F.col("c_mktsegment").alias("city"),
        F.when(k == 97, F.lit("smart-refrigerator-display")).otherwise(_device(k)).alias("device"),
        _browser(k).alias("browser"),
        _os(uid).alias("os"),
        F.concat(F.lit("v"), uid.cast("string"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd")).alias("session_key"),
    )


def search_events(spark: SparkSession, d: str, events: DataFrame | None = None) -> DataFrame:
    """Raw search POST bodies derived from view/click events (a batch or a stream)."""
    src = _events(spark, d) if events is None else events.withColumn("k", _k())
    ev = _with_geo(spark, d, src.filter(F.col("event_type").isin("view", "click")))
    k, uid = F.col("k"), F.col("user_id")
    term = F.when(k % 17 == 0, F.lit("   ")).otherwise(
        F.concat(F.when(k % 2 == 0, F.lit("  ")).otherwise(F.lit("")), F.lit("Term "), k.cast("string"), F.lit(" ")))
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("received_at"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), F.floor(F.col("event_id") / 2).cast("string"))).alias("token"),
        F.lower(F.col("n_name")).alias("country"),
        F.lpad((k % 15).cast("string"), 2, "0").alias("region"),
        F.concat(F.lit("v"), uid.cast("string")).alias("visitor_id"),
        term.alias("term"),
        F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.lit(0)).otherwise(k).cast("bigint").alias("results"),
        F.lit("/search").alias("path"),
    )


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Campaign edits (save requests) derived from nations."""
    n = load(spark, d, "nation")
    return n.select(
        F.col("n_nationkey").cast("bigint").alias("edit_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("bigint")).alias("id"),
        F.col("n_name").alias("subject"),
        F.concat(F.lit("<p>"), F.col("n_name"), F.lit("</p>")).alias("body_html"),
        F.lit(None).cast("string").alias("created_by"),
    )


def logins(spark: SparkSession, d: str) -> DataFrame:
    """Login attempts by e-mail, username or phone, derived from click events."""
    ev = _events(spark, d).filter(F.col("event_type") == "click")
    k, uid = F.col("k"), F.col("user_id").cast("string")
    mail = F.concat(F.lit("user"), uid, F.lit("@example.com"))
    ident = (F.when(k % 3 == 0, F.when(k % 2 == 0, F.upper(mail)).otherwise(mail))
             .when(k % 3 == 1, F.concat(F.lit("U"), uid))
             .otherwise(F.concat(F.lit("+9665"), F.lpad(uid, 8, "0"))))
    return ev.select(F.col("event_id").alias("login_id"), ident.alias("identifier"))


def merge_map(spark: SparkSession, d: str) -> DataFrame:
    """Account merge requests (src -> dst) with chains, a cycle and a conflict."""
    u = users(spark, d).select("id")
    i = F.col("id")
    return (u.filter(i % 5 == 4).select(i.alias("src"), (i - 1).alias("dst"))
            .unionByName(u.filter(i % 10 == 3).select(i.alias("src"), (i - 3).alias("dst")))
            .unionByName(u.filter(i % 100 == 98).select(i.alias("src"), (i + 1).alias("dst")))
            .unionByName(u.filter(i % 100 == 49).select(i.alias("src"), (i - 9).alias("dst"))))


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Identity claims of sign-ins, as JSON text plus sequence and time."""
    ev = _events(spark, d).filter(F.col("event_type") == "signup")
    k, uid = F.col("k"), F.col("user_id")
    n = (uid * 11 + k).cast("string")
    mail = (F.when(k % 3 == 0, F.concat(F.lit("u"), n, F.lit("@mail.example")))
            .when(k % 4 == 1, F.concat(F.lit("u"), n, F.lit("@post.example")))
            .otherwise(F.concat(F.lit("user"), n, F.lit("@example.com"))))
    body = F.struct(
        F.when(k % 10 == 0, F.lit("other-client")).when(k % 2 == 0, F.lit("client-main")).otherwise(F.lit("client-mini")).alias("aud"),
        F.when(k % 9 == 0, F.lit("issuer.example")).when(k % 2 == 0, F.lit("accounts.google.com")).otherwise(F.lit("https://accounts.google.com")).alias("iss"),
        F.when(k % 5 == 0, F.upper(mail)).otherwise(mail).alias("email"),
        F.when(k % 13 == 0, F.lit(None)).when(k % 7 == 0, F.lit("false")).otherwise(F.lit("true")).alias("email_verified"),
        F.concat(F.lit("Member "), uid.cast("string")).alias("name"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://img.example/"), k.cast("string"), F.lit(".png"))).alias("picture"),
        F.concat(F.lit("sub-"), uid.cast("string")).alias("sub"),
    )
    return ev.select(F.col("event_id").alias("seq"), F.col("ts"), F.to_json(body).alias("claim_json"))


# ---------------------------------------------------------------------------
# DuckDB twins.  Tables region nation customer orders part events are views in
# the oracle connection.
# ---------------------------------------------------------------------------
_EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
_GEO = """(SELECT c.c_custkey, c.c_name, c.c_mktsegment, n.n_name, r.r_regionkey, r.r_name
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)"""
_DEVICE = "CASE k % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'desktop' WHEN 2 THEN 'tablet' END"
_BROWSER = "CASE k % 5 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Firefox' WHEN 3 THEN 'Edge' END"
_OS = "CASE user_id % 4 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Windows' ELSE ' ' END"

VIEW_SQL: dict[str, str] = {
    "visits": f"""
SELECT event_id AS id, 'v' || CAST(user_id AS VARCHAR) AS visitor_id,
  CASE WHEN user_id % 3 = 0 THEN user_id END AS user_id,
  CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS is_registered,
  '/' || event_type || '/' || CAST(k AS VARCHAR) AS page_path,
  '/' || event_type || '/[id]' AS page_pattern,
  event_type AS page_title,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'https://ref' || CAST(k % 3 AS VARCHAR) || '.example/' END AS referrer,
  g.n_name AS country_code, CAST(g.r_regionkey AS VARCHAR) AS region_code, g.r_name AS region_name,
  g.c_mktsegment AS city, {_DEVICE} AS device_type, {_BROWSER} AS browser, {_OS} AS os,
  'v' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_key,
  ts AS visited_at
FROM {_EV} e LEFT JOIN {_GEO} g ON e.user_id = g.c_custkey""",
    "search_log": f"""
SELECT event_id AS id, 'v' || CAST(user_id AS VARCHAR) AS visitor_id,
  CASE WHEN user_id % 3 = 0 THEN user_id END AS user_id,
  (CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END) || 'Term ' || CAST(k AS VARCHAR) AS term,
  lower(trim((CASE WHEN k % 2 = 0 THEN ' ' ELSE '' END) || 'Term ' || CAST(k AS VARCHAR))) AS term_norm,
  CAST(CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 0 ELSE k END AS BIGINT) AS results_cnt,
  '/search' AS page_path, g.n_name AS country_code, g.r_name AS region_name, ts AS searched_at
FROM {_EV} e LEFT JOIN {_GEO} g ON e.user_id = g.c_custkey
WHERE event_type IN ('view', 'click')""",
    "users": """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 50 = 0 THEN NULL
       WHEN c_custkey % 5 = 4 THEN upper('user' || CAST(c_custkey - 1 AS VARCHAR) || '@example.com')
       ELSE 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS full_name,
  'u' || CAST(c_custkey AS VARCHAR) AS username,
  CASE WHEN c_custkey % 3 = 0 THEN '/avatars/' || CAST(c_custkey AS VARCHAR) || '.png' END AS avatar,
  CASE c_custkey % 3 WHEN 0 THEN 'user_normal' WHEN 1 THEN 'user_researcher' ELSE 'user_entity' END AS user_type,
  CASE WHEN c_custkey % 7 = 0 THEN 'suspended' ELSE 'active' END AS account_status,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'h' || CAST(c_custkey AS VARCHAR) END AS password_hash,
  CASE WHEN c_custkey % 4 = 1 THEN '+9665' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
  CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'male' WHEN 2 THEN 'F' WHEN 3 THEN 'Female' END AS gender,
  n.n_name AS country, c_mktsegment AS city,
  CASE WHEN c_custkey % 6 = 5 THEN NULL ELSE 'University ' || CAST(c_custkey % 6 AS VARCHAR) END AS university,
  CASE c_custkey % 4 WHEN 0 THEN 'bachelor' WHEN 1 THEN 'master' WHEN 2 THEN 'phd' END AS degree,
  CASE WHEN c_custkey % 11 = 10 THEN NULL ELSE 'Field ' || CAST(c_custkey % 11 AS VARCHAR) END AS research_field,
  CASE WHEN c_custkey % 13 = 12 THEN NULL ELSE 'Specialty ' || CAST(c_custkey % 13 AS VARCHAR) END AS specialty,
  CAST(DATE '1960-01-01' + CAST((c_custkey * 37) % 18000 AS INTEGER) AS DATE) AS birth_date,
  TIMESTAMP '2023-11-01 00:00:00' + to_days(CAST(c_custkey % 91 AS INTEGER)) AS registered_at,
  TIMESTAMP '2023-11-01 00:00:00' + to_days(CAST(c_custkey % 91 + c_custkey % 17 AS INTEGER)) AS last_login_at
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "sessions": f"""
SELECT event_id AS session_id, user_id,
  't' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR) AS token,
  CAST(NULL AS VARCHAR) AS refresh_token,
  ts + INTERVAL 5 DAY AS expires_at, ts + INTERVAL 10 DAY AS refresh_expires_at,
  CAST(k % 2 AS INTEGER) AS is_active, ts AS created_at, ts AS last_used_at,
  '10.0.0.' || CAST(k AS VARCHAR) AS ip_address
FROM {_EV} e""",
    "actions": f"""
SELECT * FROM (
SELECT event_id AS seq, ts,
  CASE WHEN event_type = 'signup' THEN 'subscribe' WHEN event_type = 'error' THEN 'unsubscribe'
       WHEN event_type = 'purchase' THEN 'add' WHEN event_type = 'click' THEN 'set_status'
       WHEN event_type = 'view' AND k % 25 = 0 THEN 'delete' END AS action,
  'user' || CAST(user_id AS VARCHAR) || '@example.com' AS email,
  CAST(NULL AS VARCHAR) AS token, CAST(NULL AS BIGINT) AS id,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'Name ' || CAST(k AS VARCHAR) END AS name,
  CASE WHEN event_type = 'click' THEN (CASE WHEN k % 17 = 0 THEN 'paused' WHEN k % 3 = 0 THEN 'unsubscribed'
       ELSE 'active' END) END AS status
FROM {_EV} e) WHERE action IS NOT NULL""",
    # ``home`` is the e-mail that the key was made from, ``want`` the row that it names (-1: none).
    "keyed_actions": """
SELECT seq, ts, action, CASE WHEN by_token OR by_id THEN NULL ELSE email END AS email,
  CASE WHEN by_token THEN CASE WHEN seq % 11 = 0 THEN 'forged-' || CAST(seq AS VARCHAR)
    ELSE sha256('newsletter|' || email || '|' || CAST(made AS VARCHAR)) END END AS token,
  CASE WHEN by_id THEN made END AS id, name, status, email AS home,
  CASE WHEN by_token AND seq % 11 = 0 THEN -1 WHEN by_token OR by_id THEN made END AS want
FROM (SELECT *, coalesce(action = 'unsubscribe' AND made IS NOT NULL AND seq % 4 <> 0, false) AS by_token,
    coalesce(action IN ('set_status', 'delete') AND made IS NOT NULL AND NOT (action = 'delete' AND seq % 6 = 0), false) AS by_id
  FROM (SELECT *, CASE WHEN email IS NOT NULL THEN last_value(CASE WHEN action IN ('subscribe', 'add') THEN seq END IGNORE NULLS)
      OVER (PARTITION BY email ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS made FROM actions) m) k""",
    "campaigns": """
SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS subject, '<p>News for ' || r_name || '</p>' AS body_html,
  CASE WHEN r_regionkey % 2 = 0 THEN 'sent' ELSE 'draft' END AS status,
  CAST(0 AS BIGINT) AS recipients, CAST(0 AS BIGINT) AS sent_count, CAST(0 AS BIGINT) AS fail_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(r_regionkey AS INTEGER)) AS created_at,
  CASE WHEN r_regionkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(r_regionkey + 1 AS INTEGER)) END AS sent_at,
  'admin' AS created_by
FROM region""",
    "send_log": """
SELECT o_orderkey AS id, o_custkey % 5 AS campaign_id, 'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS email,
  CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'sent' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN 'HTTP 429 busy' END AS error_msg, o_orderdate AS sent_at
FROM orders""",
    "responses": """
SELECT o_orderkey AS response_id, o_custkey % 5 AS campaign_id,
  'user' || CAST(o_custkey AS VARCHAR) || '@example.com' AS email,
  CAST(CASE WHEN o_orderstatus = 'O' THEN 202 WHEN o_orderstatus = 'F' THEN 429
       WHEN o_orderkey % 2 = 0 THEN NULL ELSE 500 END AS INTEGER) AS http_code,
  CASE WHEN o_orderstatus = 'F' THEN 'busy' WHEN o_orderstatus = 'P' THEN 'server error ' || CAST(o_orderkey AS VARCHAR) END AS body,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'connection reset' END AS error
FROM orders""",
    "categories": """
SELECT p_type AS code,
  upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS name,
  lower(p_type) AS icon, '#' || lpad(CAST(length(p_type) AS VARCHAR), 6, '0') AS color,
  CAST(length(p_type) AS INTEGER) AS display_order
FROM (SELECT DISTINCT p_type FROM part)""",
    "achievements": """
SELECT p_partkey AS id, CAST(2020 + p_size % 6 AS INTEGER) AS year_no, p_type AS category, p_name AS title,
  p_brand AS summary,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) END AS figure_value,
  CASE WHEN p_partkey % 3 = 0 THEN 'size ' || CAST(p_size AS VARCHAR) END AS figure_label,
  'https://example.org/a/' || CAST(p_partkey AS VARCHAR) AS source_url,
  CAST(p_partkey % 2 AS INTEGER) AS is_featured,
  CAST(CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size END AS INTEGER) AS display_order,
  CAST(CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_published,
  TIMESTAMP '2024-01-01 00:00:00' AS created_at
FROM part""",
    "visit_events": f"""
SELECT event_id, ts AS received_at,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 't' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR) END AS token,
  lower(g.n_name) AS country, lpad(CAST(k % 15 AS VARCHAR), 2, '0') AS region,
  'v' || CAST(user_id AS VARCHAR) AS visitor_id,
  '/' || event_type || '/' || CAST(k AS VARCHAR) || (CASE WHEN k % 50 = 49 THEN repeat('x', 600) ELSE '' END) AS path,
  '/' || event_type || '/[id]' AS pattern,
  upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS title,
  CAST(NULL AS VARCHAR) AS referrer, g.c_mktsegment AS city,
  CASE WHEN k = 97 THEN 'smart-refrigerator-display' ELSE {_DEVICE} END AS device,
  {_BROWSER} AS browser, {_OS} AS os,
  'v' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_key
FROM {_EV} e LEFT JOIN {_GEO} g ON e.user_id = g.c_custkey""",
    "search_events": f"""
SELECT event_id, ts AS received_at,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 't' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS VARCHAR) END AS token,
  lower(g.n_name) AS country, lpad(CAST(k % 15 AS VARCHAR), 2, '0') AS region,
  'v' || CAST(user_id AS VARCHAR) AS visitor_id,
  CASE WHEN k % 17 = 0 THEN '   ' ELSE (CASE WHEN k % 2 = 0 THEN '  ' ELSE '' END) || 'Term ' || CAST(k AS VARCHAR) || ' ' END AS term,
  CAST(CASE WHEN k % 11 = 0 THEN NULL WHEN k % 7 = 0 THEN 0 ELSE k END AS BIGINT) AS results,
  '/search' AS path
FROM {_EV} e LEFT JOIN {_GEO} g ON e.user_id = g.c_custkey
WHERE event_type IN ('view', 'click')""",
    "claims": f"""
SELECT event_id AS seq, ts,
  CASE WHEN k % 10 = 0 THEN 'other-client' WHEN k % 2 = 0 THEN 'client-main' ELSE 'client-mini' END AS aud,
  CASE WHEN k % 9 = 0 THEN 'issuer.example' WHEN k % 2 = 0 THEN 'accounts.google.com' ELSE 'https://accounts.google.com' END AS iss,
  CASE WHEN k % 5 = 0 THEN upper(mail) ELSE mail END AS email,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 7 = 0 THEN 'false' ELSE 'true' END AS email_verified,
  'Member ' || CAST(user_id AS VARCHAR) AS name,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'https://img.example/' || CAST(k AS VARCHAR) || '.png' END AS picture,
  'sub-' || CAST(user_id AS VARCHAR) AS sub
FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'u' || CAST(user_id * 11 + k AS VARCHAR) || '@mail.example'
                     WHEN k % 4 = 1 THEN 'u' || CAST(user_id * 11 + k AS VARCHAR) || '@post.example'
                     ELSE 'user' || CAST(user_id * 11 + k AS VARCHAR) || '@example.com' END AS mail
      FROM {_EV} x) e WHERE event_type = 'signup'""",
    "edits": """
SELECT CAST(n_nationkey AS BIGINT) AS edit_id,
  CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_regionkey AS BIGINT) END AS id,
  n_name AS subject, '<p>' || n_name || '</p>' AS body_html, CAST(NULL AS VARCHAR) AS created_by
FROM nation""",
    "logins": f"""
SELECT event_id AS login_id,
  CASE k % 3 WHEN 0 THEN (CASE WHEN k % 2 = 0 THEN upper('user' || CAST(user_id AS VARCHAR) || '@example.com')
                               ELSE 'user' || CAST(user_id AS VARCHAR) || '@example.com' END)
             WHEN 1 THEN 'U' || CAST(user_id AS VARCHAR)
             ELSE '+9665' || lpad(CAST(user_id AS VARCHAR), 8, '0') END AS identifier
FROM {_EV} e WHERE event_type = 'click'""",
    "merge_map": """
SELECT id AS src, id - 1 AS dst FROM users WHERE id % 5 = 4
UNION ALL SELECT id AS src, id - 3 AS dst FROM users WHERE id % 10 = 3
UNION ALL SELECT id AS src, id + 1 AS dst FROM users WHERE id % 100 = 98
UNION ALL SELECT id AS src, id - 9 AS dst FROM users WHERE id % 100 = 49""",
    "regions_seed": None,  # filled below from the fixed values
    "categories_seed": None,
}


def _values_sql(rows, names) -> str:
    def q(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)

    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def _fill_seeds() -> None:
    from .. import schemas

    VIEW_SQL["regions_seed"] = _values_sql(schemas.HOME_REGIONS, ["code", "name"])
    VIEW_SQL["categories_seed"] = _values_sql(
        schemas.ACHIEVEMENT_CATEGORIES, ["code", "name", "icon", "color", "display_order"])


_fill_seeds()

VIEWS = {
    "visits": visits, "search_log": search_log, "users": users, "sessions": sessions, "actions": actions,
    "keyed_actions": keyed_actions, "campaigns": campaigns, "send_log": send_log, "responses": responses, "categories": categories,
    "achievements": achievements, "visit_events": visit_events, "search_events": search_events, "claims": claims,
    "edits": edits, "logins": logins, "merge_map": merge_map,
}


def with_views(sql: str, *names: str, ctes: str = "", recursive: bool = False) -> str:
    """Prefix ``sql`` with a WITH clause defining the named views, then extra CTE text."""
    parts = [f"{n} AS ({VIEW_SQL[n]})" for n in names]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + sql
