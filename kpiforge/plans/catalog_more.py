"""Catalog, part 2: achievements, identity, quality, newsletter, campaigns, intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..operators import achievements as ACH
from ..operators import campaigns as CMP
from ..operators import identity as ID
from ..operators import intake as INT
from ..operators import joins as J
from ..operators import kpis, quality
from ..operators import lives
from ..operators import subscribers as SUB
from ..sources import adapters as A
from ..sources.tables import seed_regions
from ..sources.adapters import with_views
from .catalog import AS_OF, HOME, C, register

AUDIENCES = ["client-main", "client-mini"]
FROM_NAME = "The Newsletter Team"
UNSUB_BASE = "https://example.org/newsletter/unsubscribe/"
INTAKE_COUNTRY_WIDTH = 10
SALT = "newsletter"

# ----------------------------------------------------------- achievements --
_YEAR = ("(SELECT CAST(coalesce(TRY_CAST({req} AS INTEGER), (SELECT max(year_no) FROM achievements "
         "WHERE is_published = 1), 2025) AS INTEGER) AS year)")


def _year_sql(req: str | None) -> str:
    return _YEAR.format(req="NULL" if req is None else f"'{req}'")


register("latest_year", with_views(
    "SELECT CAST(coalesce(max(year_no), 2025) AS INTEGER) AS year FROM achievements WHERE is_published = 1",
    "achievements"))(lambda s, d: kpis.latest_year(A.achievements(s, d)))
register("distinct_years", with_views(
    "SELECT DISTINCT year_no AS year FROM achievements WHERE is_published = 1", "achievements"))(
    lambda s, d: kpis.distinct_years(A.achievements(s, d)))

_ITEMS_SQL = """
SELECT a.id, a.category, c.name AS category_name, c.icon, c.color, a.title, a.summary, a.figure_value,
  a.figure_label, a.source_url, a.is_featured = 1 AS featured
FROM achievements a JOIN categories c ON c.code = a.category, {year} y
WHERE a.is_published = 1 AND a.year_no = y.year {cat}"""
register("achievement_items", with_views(
    _ITEMS_SQL.format(year=_year_sql("abc"), cat=""), "achievements", "categories"))(
    lambda s, d: ACH.achievement_items(A.achievements(s, d), A.categories(s, d),
                                       ACH.resolve_year(A.achievements(s, d), "abc"), "all"))
register("achievement_items_small_2022", with_views(
    _ITEMS_SQL.format(year=_year_sql("2022"), cat="AND a.category = 'SMALL'"), "achievements", "categories"))(
    lambda s, d: ACH.achievement_items(A.achievements(s, d), A.categories(s, d),
                                       ACH.resolve_year(A.achievements(s, d), "2022"), "SMALL"))
register("achievement_stats", with_views(f"""
SELECT a.id, a.figure_value AS value, a.figure_label AS label, a.category, c.color
FROM achievements a JOIN categories c ON c.code = a.category, {_year_sql('2023')} y
WHERE a.is_published = 1 AND a.year_no = y.year AND a.is_featured = 1 AND a.figure_value IS NOT NULL""",
    "achievements", "categories"))(
    lambda s, d: ACH.achievement_stats(A.achievements(s, d), A.categories(s, d),
                                       ACH.resolve_year(A.achievements(s, d), "2023")))
register("category_counts", with_views(f"""
SELECT c.code, c.name, c.icon, c.color, q.n AS count FROM categories c JOIN (
  SELECT a.category, count(*) AS n FROM achievements a, {_year_sql(None)} y
  WHERE a.is_published = 1 AND a.year_no = y.year GROUP BY 1) q ON q.category = c.code""",
    "achievements", "categories"))(
    lambda s, d: ACH.category_counts(A.achievements(s, d), A.categories(s, d),
                                     ACH.resolve_year(A.achievements(s, d), None)))
_LAST = 2**31 - 1
_DOC_CTES = f"""
pub AS (SELECT a.*, c.name AS category_name, c.icon, c.color, coalesce(c.display_order, {_LAST}) AS co,
          coalesce(a.display_order, {_LAST}) AS io
        FROM achievements a JOIN categories c ON c.code = a.category WHERE a.is_published = 1 AND a.year_no = 2024),
it AS (SELECT co, category, io, id, '{{"id":' || CAST(id AS VARCHAR) || ',"category":' || to_json(category)::VARCHAR
          || ',"categoryName":' || to_json(category_name)::VARCHAR || ',"icon":' || to_json(icon)::VARCHAR
          || ',"color":' || to_json(color)::VARCHAR || ',"title":' || to_json(title)::VARCHAR
          || CASE WHEN summary IS NOT NULL THEN ',"summary":' || to_json(summary)::VARCHAR ELSE '' END
          || CASE WHEN figure_value IS NOT NULL THEN ',"figureValue":' || to_json(figure_value)::VARCHAR ELSE '' END
          || CASE WHEN figure_label IS NOT NULL THEN ',"figureLabel":' || to_json(figure_label)::VARCHAR ELSE '' END
          || ',"sourceUrl":' || to_json(source_url)::VARCHAR
          || ',"featured":' || CASE WHEN is_featured = 1 THEN 'true' ELSE 'false' END || '}}' AS j FROM pub),
st AS (SELECT co, category, io, id, '{{"value":' || to_json(figure_value)::VARCHAR
          || CASE WHEN figure_label IS NOT NULL THEN ',"label":' || to_json(figure_label)::VARCHAR ELSE '' END
          || ',"category":' || to_json(category)::VARCHAR || ',"color":' || to_json(color)::VARCHAR || '}}' AS j
        FROM pub WHERE is_featured = 1 AND figure_value IS NOT NULL),
ca AS (SELECT co, category, '{{"code":' || to_json(category)::VARCHAR || ',"name":' || to_json(category_name)::VARCHAR
          || ',"icon":' || to_json(icon)::VARCHAR || ',"color":' || to_json(color)::VARCHAR || ',"count":'
          || CAST(count(*) AS VARCHAR) || '}}' AS j FROM pub GROUP BY co, category, category_name, icon, color),
yr AS (SELECT to_json(list(y ORDER BY y DESC))::VARCHAR AS j FROM (SELECT DISTINCT year_no AS y FROM achievements
       WHERE is_published = 1))
"""
register("achievements_document", with_views(
    "SELECT 2024 AS year, '{\"year\":2024,\"years\":' || (SELECT coalesce(j, '[]') FROM yr) "
    "|| ',\"stats\":[' || coalesce((SELECT string_agg(j, ',' ORDER BY co, category, io, id) FROM st), '') "
    "|| '],\"categories\":[' || coalesce((SELECT string_agg(j, ',' ORDER BY co, category) FROM ca), '') "
    "|| '],\"items\":[' || coalesce((SELECT string_agg(j, ',' ORDER BY co, category, io, id) FROM it), '') "
    "|| ']}' AS document", "achievements", "categories", ctes=_DOC_CTES))(
    lambda s, d: ACH.achievements_document(A.achievements(s, d), A.categories(s, d), "2024", None))

# The same document in parts of 4 kB.
_PART = 4096
register("achievements_parts", with_views(
    f"SELECT off // {_PART} AS part, min(off) AS offset, string_agg(x, '' ORDER BY off) AS text FROM ("
    "SELECT x, coalesce(sum(strlen(x)) OVER (ORDER BY sec, listed, co, category, io, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM ("
    "SELECT *, CASE WHEN listed AND row_number() OVER (PARTITION BY sec, listed ORDER BY co, category, io, id) > 1 THEN ',' ELSE '' END || t AS x FROM ("
    "SELECT 0 AS sec, false AS listed, 0 AS co, '' AS category, 0 AS io, 0 AS id, '{\"year\":2024,\"years\":' || (SELECT coalesce(j, '[]') FROM yr) AS t "
    "UNION ALL SELECT 1, false, 0, '', 0, 0, ',\"stats\":[' UNION ALL SELECT 1, true, co, category, io, id, j FROM st "
    "UNION ALL SELECT 2, false, 0, '', 0, 0, '],\"categories\":[' UNION ALL SELECT 2, true, co, category, 0, 0, j FROM ca "
    "UNION ALL SELECT 3, false, 0, '', 0, 0, '],\"items\":[' UNION ALL SELECT 3, true, co, category, io, id, j FROM it "
    "UNION ALL SELECT 4, false, 0, '', 0, 0, ']}') f) c) o GROUP BY 1", "achievements", "categories", ctes=_DOC_CTES))(
    lambda s, d: ACH.achievements_parts(A.achievements(s, d), A.categories(s, d), "2024", None, _PART))

# --------------------------------------------------------------- identity --
_CANON = ("(SELECT lower(email) AS mail, min(id) AS cid FROM users WHERE email IS NOT NULL GROUP BY 1)")
register("duplicate_emails", with_views(
    "SELECT lower(email) AS key, count(*) AS rows FROM users WHERE email IS NOT NULL GROUP BY 1 "
    "HAVING count(*) > 1", "users"))(
    lambda s, d: kpis.duplicate_keys(A.users(s, d), F.lower("email")))
register("dedupe_accounts", with_views(
    f"SELECT u.* FROM users u LEFT JOIN {_CANON} c ON lower(u.email) = c.mail "
    "WHERE u.email IS NULL OR u.id = c.cid", "users"))(lambda s, d: ID.dedupe_accounts(A.users(s, d)))
register("repoint_sessions", with_views(
    f"SELECT s.session_id, coalesce(m.cid, s.user_id) AS user_id FROM sessions s LEFT JOIN ("
    f"SELECT u.id, c.cid FROM users u JOIN {_CANON} c ON lower(u.email) = c.mail) m ON s.user_id = m.id",
    "sessions", "users"))(
    lambda s, d: ID.repoint_sessions(A.sessions(s, d), A.users(s, d)).select("session_id", "user_id"))
register("sessions_with_email", with_views(
    "SELECT session_id, user_id FROM sessions WHERE user_id IN (SELECT id FROM users WHERE email IS NOT NULL)",
    "sessions", "users"))(
    lambda s, d: J.has_email(A.sessions(s, d), A.users(s, d)).select("session_id", "user_id"))
register("unique_email_violations", with_views(
    "SELECT lower(email) AS key, count(*) AS rows FROM users WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "users"))(lambda s, d: quality.unique_violations(A.users(s, d), F.lower("email")))
register("orphan_sessions_after_dedupe", with_views(
    f"SELECT s.session_id, s.user_id FROM sessions s WHERE s.user_id IS NOT NULL AND s.user_id NOT IN ("
    f"SELECT u.id FROM users u LEFT JOIN {_CANON} c ON lower(u.email) = c.mail "
    "WHERE u.email IS NULL OR u.id = c.cid)", "sessions", "users"))(
    lambda s, d: quality.orphans(A.sessions(s, d), ID.dedupe_accounts(A.users(s, d)), "user_id", "id", derived=True)
    .select("session_id", "user_id"))
register("user_not_null_violations", with_views(
    "SELECT id, 'email' AS \"column\" FROM users WHERE email IS NULL UNION ALL "
    "SELECT id, 'full_name' FROM users WHERE full_name IS NULL UNION ALL "
    "SELECT id, 'gender' FROM users WHERE gender IS NULL", "users"))(
    lambda s, d: quality.not_null_violations(A.users(s, d), ["email", "full_name", "gender"]))
_WIDTH_COLS = {"visitor_id": 64, "path": 500, "pattern": 200, "title": 300, "referrer": 500, "city": 100,
               "device": 20, "browser": 50, "os": 50, "session_key": 64, "region": 10}
register("intake_length_violations", with_views(" UNION ALL ".join(
    f"SELECT event_id, '{c}' AS \"column\", CAST(length({c}) AS INTEGER) AS length, {w} AS \"limit\" "
    "FROM visit_events "
    f"WHERE length({c}) > {w}" for c, w in _WIDTH_COLS.items()), "visit_events"))(
    lambda s, d: quality.length_violations(A.visit_events(s, d), _WIDTH_COLS, "event_id"))

register("username_taken", with_views(
    "SELECT c.username, coalesce(t.n, 0) AS taken FROM (SELECT DISTINCT split_part(lower(trim(email)), '@', 1) "
    "AS username FROM claims WHERE email IS NOT NULL) c LEFT JOIN (SELECT lower(username) AS k, count(*) AS n "
    "FROM users WHERE username IS NOT NULL GROUP BY 1) t ON lower(c.username) = t.k", "claims", "users"))(
    lambda s, d: kpis.name_taken_count(
        ID.read_claims(A.claims(s, d)).filter(F.col("email").isNotNull())
        .select(F.substring_index(F.lower(F.trim("email")), "@", 1).alias("username")).distinct(), A.users(s, d)))

_MERGE_CTES = """
m AS (SELECT DISTINCT src, dst FROM merge_map WHERE src <> dst
                     AND src NOT IN (SELECT src FROM merge_map GROUP BY src HAVING count(DISTINCT dst) > 1)),
walk(src, dst, depth) AS (SELECT src, dst, 1 FROM m UNION ALL
  SELECT w.src, m.dst, w.depth + 1 FROM walk w JOIN m ON w.dst = m.src WHERE w.depth < 40),
fin AS (SELECT src, dst FROM walk WHERE dst NOT IN (SELECT src FROM m)),
res AS (SELECT m.src, fin.dst, CASE WHEN fin.dst IS NULL THEN 'rejected: cycle' ELSE 'ok' END AS status
        FROM m LEFT JOIN fin ON m.src = fin.src
        UNION ALL SELECT DISTINCT src, CAST(NULL AS BIGINT), 'rejected: several destinations' FROM merge_map
        WHERE src IN (SELECT src FROM merge_map GROUP BY src HAVING count(DISTINCT dst) > 1))
"""


def _merge(s, d):
    return ID.merge_accounts(A.users(s, d), A.sessions(s, d), A.merge_map(s, d))


register("merge_mapping", with_views("SELECT * FROM res", "users", "merge_map", ctes=_MERGE_CTES, recursive=True))(
    lambda s, d: _merge(s, d)[2])
register("merged_sessions", with_views(
    "SELECT s.session_id, coalesce(r.dst, s.user_id) AS user_id FROM sessions s LEFT JOIN "
    "(SELECT src, dst FROM res WHERE status = 'ok') r ON s.user_id = r.src",
    "users", "merge_map", "sessions", ctes=_MERGE_CTES, recursive=True))(
    lambda s, d: _merge(s, d)[1].select("session_id", "user_id"))
register("merged_users", with_views(
    "SELECT u.id, coalesce(nm.mail, u.email) AS email FROM users u LEFT JOIN nm ON nm.dst = u.id "
    "WHERE u.id NOT IN (SELECT src FROM ok)", "users", "merge_map", recursive=True, ctes=_MERGE_CTES
    + ", ok AS (SELECT src, dst FROM res WHERE status = 'ok'), "
    "nm AS (SELECT ok.dst, arg_min(u.email, ok.src) AS mail FROM ok JOIN users u ON u.id = ok.src "
    "WHERE u.email IS NOT NULL GROUP BY 1)"))(
    lambda s, d: _merge(s, d)[0].select("id", "email"))

register("stitch_visitors", with_views(
    "SELECT v.id, v.visitor_id, v.user_id, coalesce(v.user_id, k.uid) AS stitched_user_id FROM visits v "
    "LEFT JOIN (SELECT visitor_id, arg_max(user_id, (visited_at, id)) AS uid FROM visits WHERE user_id IS NOT NULL "
    "AND visitor_id IS NOT NULL GROUP BY 1) k ON v.visitor_id = k.visitor_id", "visits"))(
    lambda s, d: ID.stitch_visitors(A.visits(s, d)))

_VALID_CLAIM = ("coalesce(aud IN ('client-main', 'client-mini') AND iss IN ('accounts.google.com', "
                "'https://accounts.google.com') AND email_verified = 'true' AND email IS NOT NULL, false)")
_SIGNIN_CTES = f"""
c AS (SELECT seq, ts, lower(trim(email)) AS email, name, picture FROM claims WHERE {_VALID_CLAIM}),
pm AS (SELECT email, min(seq) AS first_seq, arg_min(ts, seq) AS first_ts, arg_max(ts, seq) AS last_ts,
  arg_min_null(name, seq) AS first_name, arg_min(picture, seq) FILTER (WHERE picture IS NOT NULL) AS first_picture
  FROM c GROUP BY email),
ex AS (SELECT lower(email) AS email, min(id) AS uid FROM users WHERE email IS NOT NULL GROUP BY 1),
m AS (SELECT pm.*, ex.uid FROM pm LEFT JOIN ex USING (email)),
nw AS (SELECT *, split_part(email, '@', 1) AS prefix FROM m WHERE uid IS NULL),
win AS (SELECT lower(prefix) AS pk, arg_min(email, first_seq) AS winner FROM nw GROUP BY 1),
tk AS (SELECT DISTINCT lower(username) AS pk FROM users WHERE username IS NOT NULL),
mx AS (SELECT coalesce(max(id), 0) AS mx FROM users),
ins AS (SELECT mx.mx + nw.first_seq + 1 AS id, nw.email, nw.first_name AS full_name,
  CASE WHEN win.winner = nw.email AND tk.pk IS NULL THEN nw.prefix ELSE nw.prefix || '-' || CAST(mx.mx + nw.first_seq + 1 AS VARCHAR) END
    AS username, nw.first_picture AS avatar, 'user_normal' AS user_type, 'active' AS account_status,
  nw.first_ts AS registered_at, nw.last_ts AS last_login_at
  FROM nw JOIN win ON lower(nw.prefix) = win.pk LEFT JOIN tk ON lower(nw.prefix) = tk.pk, mx),
upd AS (SELECT u.id, u.email, u.full_name, u.username,
  CASE WHEN k.last_ts IS NOT NULL THEN coalesce(u.avatar, k.first_picture) ELSE u.avatar END AS avatar,
  u.user_type, u.account_status, u.registered_at, coalesce(k.last_ts, u.last_login_at) AS last_login_at
  FROM users u LEFT JOIN (SELECT uid, first_picture, last_ts FROM m WHERE uid IS NOT NULL) k ON u.id = k.uid),
ids AS (SELECT email, uid AS user_id FROM m WHERE uid IS NOT NULL UNION ALL
        SELECT nw.email, mx.mx + nw.first_seq + 1 FROM nw, mx)
"""
_USER_OUT = ["id", "email", "full_name", "username", "avatar", "user_type", "account_status", "registered_at",
             "last_login_at"]


def _signin(s, d):
    parsed = ID.read_claims(A.claims(s, d))
    good, bad = ID.valid_signins(parsed, AUDIENCES)
    users, resolved = ID.sign_in_upsert(A.users(s, d), good)
    return users, resolved, bad


register("sign_in_users", with_views(
    "SELECT * FROM upd UNION ALL SELECT * FROM ins", "claims", "users", ctes=_SIGNIN_CTES))(
    lambda s, d: _signin(s, d)[0].select(*_USER_OUT))
register("sign_in_rejects", with_views(
    f"SELECT seq, CASE WHEN email IS NULL THEN 'no email' "
    "WHEN NOT coalesce(aud IN ('client-main', 'client-mini'), false) THEN 'audience' "
    "WHEN NOT coalesce(iss IN ('accounts.google.com', 'https://accounts.google.com'), false) THEN 'issuer' "
    f"ELSE 'email not verified' END AS reason FROM claims WHERE NOT {_VALID_CLAIM}", "claims"))(
    lambda s, d: _signin(s, d)[2].select("seq", "reason"))
register("open_sessions", with_views(
    "SELECT sha256('session|' || CAST(ids.user_id AS VARCHAR) || '|' || "
    "strftime(c.ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || CAST(c.seq AS VARCHAR)) AS session_key, ids.user_id, "
    "c.ts + INTERVAL 30 DAY AS expires_at, c.ts + INTERVAL 60 DAY AS refresh_expires_at, 1 AS is_active, "
    "c.ts AS created_at, c.ts AS last_used_at FROM c JOIN ids USING (email)", "claims", "users", ctes=_SIGNIN_CTES))(
    lambda s, d: ID.open_sessions(_signin(s, d)[1], "session"))
register("availability", with_views(
    "SELECT kind, value, t.k IS NULL AS available FROM (SELECT DISTINCT 'email' AS kind, email AS value FROM claims "
    "WHERE email IS NOT NULL UNION SELECT DISTINCT 'username', split_part(lower(trim(email)), '@', 1) FROM claims "
    "WHERE email IS NOT NULL) c LEFT JOIN (SELECT DISTINCT 'email' AS kind2, lower(trim(email)) AS k FROM users "
    "WHERE email IS NOT NULL UNION SELECT DISTINCT 'username', lower(trim(username)) FROM users "
    "WHERE username IS NOT NULL) t ON c.kind = t.kind2 AND lower(trim(c.value)) = t.k", "claims", "users"))(
    lambda s, d: J.availability(
        ID.read_claims(A.claims(s, d)).filter(F.col("email").isNotNull()).select(
            F.explode(F.array(
                F.struct(F.lit("email").alias("kind"), F.col("email").alias("value")),
                F.struct(F.lit("username").alias("kind"),
                         F.substring_index(F.lower(F.trim("email")), "@", 1).alias("value")))).alias("c"))
        .select("c.kind", "c.value").distinct(), A.users(s, d)))
register("resolve_identity", with_views("""
SELECT l.login_id, l.identifier, b.user_id, b.kind AS matched_by FROM logins l LEFT JOIN (
  SELECT login_id, arg_min(user_id, prio * 1000000000000 + user_id) AS user_id,
         arg_min(kind, prio * 1000000000000 + user_id) AS kind FROM (
    SELECT DISTINCT l.login_id, k.user_id, k.kind, k.prio FROM logins l JOIN (
      SELECT kind, key, min(user_id) AS user_id, CASE kind WHEN 'email' THEN 0 WHEN 'username' THEN 1 ELSE 2 END AS prio
      FROM (SELECT 'email' AS kind, lower(trim(email)) AS key, id AS user_id FROM users UNION ALL
            SELECT 'username', lower(trim(username)), id FROM users UNION ALL
            SELECT 'phone', trim(phone), id FROM users) WHERE key IS NOT NULL GROUP BY 1, 2) k
    ON k.key = lower(trim(l.identifier)) OR k.key = trim(l.identifier)) GROUP BY 1) b ON l.login_id = b.login_id""",
    "logins", "users"))(lambda s, d: J.resolve_identity(A.logins(s, d), A.users(s, d)))

# ------------------------------------------------------------- newsletter --
_FOLD_CTES = """
acts AS (SELECT seq, ts, action, lower(trim(email)) AS email, name, status FROM actions
  WHERE action IN ('subscribe', 'unsubscribe', 'add', 'set_status', 'delete') AND email IS NOT NULL
    AND strpos(lower(trim(email)), '@') > 0
    AND NOT (action = 'set_status' AND NOT coalesce(status IN ('active', 'unsubscribed'), false))),
l AS (SELECT *, coalesce(sum(CASE WHEN action = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY email ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM acts),
x AS (SELECT *, max(CASE WHEN action IN ('subscribe', 'add') THEN 1 ELSE 0 END) OVER (PARTITION BY email, life
  ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ex FROM l),
y AS (SELECT *, lag(CASE WHEN ex = 1 THEN (CASE WHEN action IN ('subscribe', 'add') THEN 'active'
  WHEN action = 'unsubscribe' THEN 'unsubscribed' WHEN action = 'set_status' THEN status END) END)
  OVER (PARTITION BY email, life ORDER BY seq) AS prev FROM x),
z AS (SELECT *, prev IS NOT NULL AND (action IN ('set_status', 'add') OR (action = 'subscribe' AND prev = 'unsubscribed')
  OR (action = 'unsubscribe' AND prev = 'active')) AS touch FROM y WHERE ex = 1),
lives AS (SELECT email, life, min(seq) AS cseq, arg_min(action, seq) AS cact, arg_min_null(name, seq) AS cname,
  arg_min(ts, seq) AS cts, max(CASE WHEN action = 'delete' THEN 1 ELSE 0 END) AS ended,
  arg_max(CASE WHEN action IN ('subscribe', 'add') THEN 'active' WHEN action = 'unsubscribe' THEN 'unsubscribed'
    ELSE status END, seq) AS status,
  arg_max(name, seq) FILTER (WHERE name IS NOT NULL AND (action = 'add' OR (action = 'subscribe' AND prev = 'unsubscribed'))) AS lname,
  arg_max(ts, seq) FILTER (WHERE action = 'subscribe' AND prev = 'unsubscribed') AS lresub,
  arg_max_null(CASE WHEN action = 'unsubscribe' OR (action = 'set_status' AND status = 'unsubscribed') THEN ts END, seq)
    FILTER (WHERE touch) AS ltouch
  FROM z GROUP BY email, life),
subs AS (SELECT cseq AS id, email, coalesce(lname, cname) AS full_name,
  CASE WHEN cact = 'subscribe' THEN (SELECT min(u.id) FROM users u WHERE lower(u.email) = lives.email) END AS user_id,
  status, sha256('newsletter|' || email || '|' || CAST(cseq AS VARCHAR)) AS confirm_token,
  CASE WHEN cact = 'subscribe' THEN 'website' ELSE 'admin' END AS source,
  coalesce(lresub, cts) AS subscribed_at, ltouch AS unsubscribed_at
  FROM lives WHERE ended = 0)
"""


def _fold_with(sql: str, *extra: str, ctes: str = "") -> str:
    return with_views(sql, "actions", "users", *extra, ctes=_FOLD_CTES + ("," + ctes if ctes else ""))


def _subs(s, d):
    good, _ = SUB.validate_actions(A.actions(s, d))
    return SUB.fold_subscribers(good, A.users(s, d), SALT)


register("subscribers", _fold_with("SELECT * FROM subs"))(_subs)
register("subscriber_kpis", _fold_with(f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
  count(*) FILTER (WHERE status = 'unsubscribed') AS unsubscribed,
  count(*) FILTER (WHERE {C.on_day('subscribed_at')}) AS today,
  count(*) FILTER (WHERE {C.since_days('subscribed_at', 7)}) AS week,
  count(*) FILTER (WHERE {C.since_month('subscribed_at')}) AS month,
  count(*) FILTER (WHERE user_id IS NOT NULL) AS registered FROM subs"""))(
    lambda s, d: kpis.subscriber_kpis(_subs(s, d), AS_OF))
register("subscriber_list", _fold_with(
    "SELECT id, email, full_name AS name, status, source, strftime(subscribed_at, '%Y-%m-%d %H:%M') AS at, "
    "CASE WHEN user_id IS NOT NULL THEN 1 ELSE 0 END AS registered FROM subs "
    "WHERE (strpos(lower(email), 'user1') > 0 OR coalesce(strpos(lower(full_name), 'user1') > 0, false)) "
    "AND status = 'active' ORDER BY id DESC LIMIT 300"))(
    lambda s, d: SUB.subscriber_list(_subs(s, d), "User1", "active"))
register("action_quarantine", with_views(
    "SELECT seq, action, reason FROM (SELECT seq, action, CASE WHEN action IS NULL OR action NOT IN "
    "('subscribe', 'unsubscribe', 'add', 'set_status', 'delete') THEN 'unknown action' "
    "WHEN lower(trim(email)) IS NULL THEN 'no email' WHEN strpos(lower(trim(email)), '@') = 0 THEN 'invalid email' "
    "WHEN action = 'set_status' AND NOT coalesce(status IN ('active', 'unsubscribed'), false) THEN 'unsupported status' "
    "END AS reason FROM actions) q WHERE reason IS NOT NULL", "actions"))(
    lambda s, d: SUB.validate_actions(A.actions(s, d))[1].select("seq", "action", "reason"))

register("campaign_kpis", with_views(
    "SELECT count(*) AS campaigns, count(*) FILTER (WHERE status = 'sent') AS sent FROM campaigns", "campaigns"))(
    lambda s, d: kpis.campaign_kpis(A.campaigns(s, d)))
register("campaign_list", with_views(
    "SELECT id, subject, status, recipients, sent_count AS sent, fail_count AS fail, "
    "strftime(created_at, '%Y-%m-%d %H:%M') AS created, strftime(sent_at, '%Y-%m-%d %H:%M') AS sent_at "
    "FROM campaigns", "campaigns"))(lambda s, d: CMP.campaign_list(A.campaigns(s, d)))
register("send_rollup", with_views(
    "SELECT campaign_id, count(*) AS recipients, count(*) FILTER (WHERE status = 'sent') AS sent, "
    "count(*) FILTER (WHERE status = 'failed') AS failed FROM send_log GROUP BY 1", "send_log"))(
    lambda s, d: kpis.send_rollup(A.send_log(s, d)))

_OUTCOMES = ("SELECT campaign_id, email, CASE WHEN http_code = 202 THEN 'sent' ELSE 'failed' END AS status, "
             "CASE WHEN http_code = 202 THEN NULL WHEN http_code IS NOT NULL THEN substr('HTTP ' || "
             "CAST(http_code AS VARCHAR) || ' ' || coalesce(substr(body, 1, 400), ''), 1, 2000) "
             "ELSE substr(error, 1, 400) END AS error_msg FROM responses")
register("send_outcomes", with_views(_OUTCOMES, "responses"))(
    lambda s, d: CMP.classify_outcomes(A.responses(s, d)))
register("campaign_close", with_views(
    f"SELECT c.id, c.subject, c.body_html, CASE WHEN c.id = 3 THEN 'draft' WHEN r.n IS NOT NULL THEN 'sent' "
    "ELSE c.status END AS status, CASE WHEN r.n IS NOT NULL AND c.id <> 3 THEN r.n ELSE c.recipients END AS recipients, "
    "CASE WHEN r.n IS NOT NULL AND c.id <> 3 THEN r.s ELSE c.sent_count END AS sent_count, "
    "CASE WHEN r.n IS NOT NULL AND c.id <> 3 THEN r.f ELSE c.fail_count END AS fail_count, c.created_at, "
    "CASE WHEN r.n IS NOT NULL AND c.id <> 3 THEN TIMESTAMP '2024-01-30 12:00:00' ELSE c.sent_at END AS sent_at, "
    f"c.created_by FROM campaigns c LEFT JOIN (SELECT campaign_id, count(*) AS n, count(*) FILTER (WHERE status = 'sent') "
    f"AS s, count(*) FILTER (WHERE status = 'failed') AS f FROM ({_OUTCOMES}) o GROUP BY 1) r ON r.campaign_id = c.id",
    "campaigns", "responses"))(
    lambda s, d: CMP.close_campaigns(A.campaigns(s, d), CMP.classify_outcomes(A.responses(s, d)), AS_OF, [3]))
register("saved_campaigns", with_views(
    "SELECT c.id, coalesce(u.subject, c.subject) AS subject, CASE WHEN u.edit_id IS NOT NULL THEN u.body_html "
    "ELSE c.body_html END AS body_html, c.status, c.recipients, c.sent_count, c.fail_count, c.created_at, c.sent_at, "
    "c.created_by FROM campaigns c LEFT JOIN (SELECT e.id, arg_max(e.subject, e.edit_id) AS subject, "
    "arg_max_null(e.body_html, e.edit_id) AS body_html, max(e.edit_id) AS edit_id FROM edits e "
    "JOIN campaigns d ON d.id = e.id AND d.status = 'draft' GROUP BY 1) u ON u.id = c.id "
    "UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM campaigns) + e.edit_id, e.subject, e.body_html, 'draft', 0, 0, 0, "
    "TIMESTAMP '2024-01-30 12:00:00', CAST(NULL AS TIMESTAMP), coalesce(e.created_by, 'admin') FROM edits e "
    "WHERE e.id IS NULL", "campaigns", "edits"))(
    lambda s, d: SUB.save_campaigns(A.campaigns(s, d), A.edits(s, d), AS_OF))


def _messages(s, d):
    rc = CMP.recipients(A.campaigns(s, d), _subs(s, d), 1)
    return CMP.message_payload(CMP.render_messages(rc, FROM_NAME, UNSUB_BASE))


register("campaign_messages", _fold_with(
    "SELECT campaign_id, email, to_json({'message': {'subject': subject, 'body': {'contentType': 'HTML', "
    "'content': html}, 'toRecipients': [{'emailAddress': {'address': email}}]}, 'saveToSentItems': false})::VARCHAR "
    "AS payload FROM msg", "campaigns", ctes=(
        "cm AS (SELECT * FROM campaigns WHERE id = 1 AND status = 'draft'), "
        "msg AS (SELECT cm.id AS campaign_id, s.email, cm.subject, coalesce(cm.body_html, '') || "
        f"'<footer>{FROM_NAME}: <a href=\"{UNSUB_BASE}' || coalesce(s.confirm_token, '') || '\">unsubscribe</a></footer>' "
        "AS html FROM subs s, cm WHERE s.status = 'active')")))(_messages)

# ----------------------------------------------------------------- intake --
def _token_users(events: str) -> str:
    return (f"(SELECT v.event_id, min(s.user_id) AS uid FROM {events} v JOIN sessions s ON s.token = v.token AND s.is_active = 1 "
            "AND s.created_at <= v.received_at AND s.expires_at > v.received_at GROUP BY v.event_id HAVING count(*) = 1)")


def _no_empty(events: str) -> str:
    texts = {"visit_events": schemas.VISIT_EVENT, "search_events": schemas.SEARCH_EVENT}[events].fields
    cleaned = ", ".join(f"nullif({f.name}, '') AS {f.name}" for f in texts if f.dataType.simpleString() == "string")
    return f"(SELECT * REPLACE ({cleaned}) FROM {events})"


def _visit_reason(width: int) -> str:
    checks = [f"length(upper(country)) > {width} THEN 'country longer than {width}'"] + [
        f"length({c}) > {w} THEN '{c} longer than {w}'" for c, w in INT.VISIT_REJECT.items()]
    return "CASE " + " ".join(f"WHEN {c}" for c in checks) + " END"


def _search_reason(width: int) -> str:
    checks = (["nullif(trim(term), '') IS NULL THEN 'blank term'",
               f"length(upper(country)) > {width} THEN 'country longer than {width}'"]
              + [f"length({c}) > {w} THEN '{c} longer than {w}'" for c, w in INT.SEARCH_REJECT.items()])
    return "CASE " + " ".join(f"WHEN {c}" for c in checks) + " END"


def _visit_intake(s, d):
    return INT.visit_intake(A.visit_events(s, d), A.sessions(s, d), seed_regions(s), HOME, INTAKE_COUNTRY_WIDTH)


def _search_intake(s, d):
    return INT.search_intake(A.search_events(s, d), A.sessions(s, d), seed_regions(s), HOME, INTAKE_COUNTRY_WIDTH)


VISIT_INTAKE_BODY = f"""
SELECT e.event_id AS id, e.visitor_id, t.uid AS user_id, CASE WHEN t.uid IS NULL THEN 0 ELSE 1 END AS is_registered,
  substr(e.path, 1, 500) AS page_path, substr(e.pattern, 1, 200) AS page_pattern, substr(e.title, 1, 300) AS page_title,
  substr(e.referrer, 1, 500) AS referrer, upper(e.country) AS country_code, e.region AS region_code, r.name AS region_name,
  substr(e.city, 1, 100) AS city, e.device AS device_type, e.browser, e.os, e.session_key, e.received_at AS visited_at
FROM (SELECT *, {_visit_reason(INTAKE_COUNTRY_WIDTH)} AS reason FROM {_no_empty('visit_events')} v) e
LEFT JOIN {_token_users('visit_events')} t ON e.event_id = t.event_id
LEFT JOIN regions_seed r ON upper(e.country) = '{HOME}' AND e.region = r.code
WHERE e.reason IS NULL"""
VISIT_INTAKE_SQL = with_views(VISIT_INTAKE_BODY, "visit_events", "sessions", "regions_seed")
register("visit_intake", VISIT_INTAKE_SQL)(lambda s, d: _visit_intake(s, d)[0])
register("visit_quarantine", with_views(
    f"SELECT event_id, received_at, reason FROM (SELECT *, {_visit_reason(INTAKE_COUNTRY_WIDTH)} AS reason "
    "FROM visit_events) e WHERE reason IS NOT NULL", "visit_events"))(lambda s, d: _visit_intake(s, d)[1])
SEARCH_INTAKE_SQL = with_views(f"""
SELECT e.event_id AS id, e.visitor_id, t.uid AS user_id, substr(nullif(trim(e.term), ''), 1, 400) AS term,
  lower(substr(nullif(trim(e.term), ''), 1, 400)) AS term_norm, e.results AS results_cnt,
  substr(e.path, 1, 500) AS page_path, upper(e.country) AS country_code, r.name AS region_name,
  e.received_at AS searched_at
FROM (SELECT *, {_search_reason(INTAKE_COUNTRY_WIDTH)} AS reason FROM {_no_empty('search_events')} v) e
LEFT JOIN {_token_users('search_events')} t ON e.event_id = t.event_id
LEFT JOIN regions_seed r ON upper(e.country) = '{HOME}' AND e.region = r.code
WHERE e.reason IS NULL""", "search_events", "sessions", "regions_seed")
register("search_intake", SEARCH_INTAKE_SQL)(lambda s, d: _search_intake(s, d)[0])
register("search_quarantine", with_views(
    f"SELECT event_id, received_at, reason FROM (SELECT *, {_search_reason(INTAKE_COUNTRY_WIDTH)} AS reason "
    "FROM search_events) e WHERE reason IS NOT NULL", "search_events"))(lambda s, d: _search_intake(s, d)[1])

# ---------------------------------------------------------------- filters --
from ..operators import filters as FL  # noqa: E402
from ..operators import series as SER  # noqa: E402


def _registrations(s, d):
    u = A.users(s, d)
    i = F.col("id")
    form = u.select("id", "email", "username",
                    F.when(F.col("password_hash").isNotNull(), (i % 12).cast("int")).alias("password_len"),
                    (i % 9 != 0).alias("confirmation_matches"))
    return FL.registration_checks(form).select("id", "failed_rules", "valid")


register("registration_checks", with_views(
    "SELECT id, failed_rules, len(failed_rules) = 0 AS valid FROM (SELECT id, list_filter([CASE WHEN NOT "
    "coalesce(contains(email, '@'), false) THEN 'email_invalid' END, CASE WHEN coalesce(pl < 6, true) THEN "
    "'password_short' END, CASE WHEN NOT coalesce(cm, false) THEN 'confirmation_mismatch' END, CASE WHEN "
    "coalesce(length(username) < 3, true) THEN 'username_short' END], lambda x: x IS NOT NULL) AS failed_rules FROM ("
    "SELECT id, email, username, CASE WHEN password_hash IS NOT NULL THEN CAST(id % 12 AS INTEGER) END AS pl, "
    "id % 9 <> 0 AS cm FROM users) f) q", "users"))(_registrations)
def _cards(s, d):
    from ..functions import display_name

    u = A.users(s, d)
    return u.select("id", display_name("full_name", "username").alias("name"),
                    F.substring(display_name("full_name", "username", "U"), 1, 1).alias("initial"))


register("user_cards", with_views(
    "SELECT id, coalesce(nullif(full_name, ''), nullif(username, '')) AS name, "
    "substr(coalesce(nullif(full_name, ''), nullif(username, ''), 'U'), 1, 1) AS initial FROM users", "users"))(_cards)
register("phone_availability", with_views(
    "SELECT 'phone' AS kind, identifier AS value, t.k IS NULL AS available FROM (SELECT DISTINCT identifier FROM logins "
    "WHERE identifier IS NOT NULL) l LEFT JOIN (SELECT DISTINCT trim(phone) AS k FROM users WHERE phone IS NOT NULL) t "
    "ON trim(l.identifier) = t.k", "logins", "users"))(
    lambda s, d: J.availability(A.logins(s, d).filter("identifier is not null").select(
        F.lit("phone").alias("kind"), F.col("identifier").alias("value")).distinct(), A.users(s, d)))
register("long_terms", with_views(
    "SELECT label, count(*) AS value FROM (SELECT nullif(trim(term_norm), '') AS label FROM search_log "
    "WHERE length(term_norm) >= 7) q WHERE label IS NOT NULL GROUP BY 1 ORDER BY value DESC, label ASC NULLS LAST "
    "LIMIT 10", "search_log"))(
    lambda s, d: SER.count_by(FL.min_term_length(A.search_log(s, d), 7), "term_norm", 10))
register("human_browsers", with_views(
    "SELECT coalesce(nullif(trim(browser), ''), 'unspecified') AS label, count(*) AS value FROM visits "
    "WHERE NOT coalesce(regexp_matches(browser, '(?i)edge'), false) GROUP BY 1", "visits"))(
    lambda s, d: SER.by_browser(FL.drop_bots(A.visits(s, d), "browser", "(?i)edge")))
register("achievement_defaults", with_views(
    "SELECT id, coalesce(display_order, 100) AS display_order, coalesce(is_featured, 0) AS is_featured, "
    "coalesce(is_published, 1) AS is_published, coalesce(year_no, 2025) AS year_no FROM achievements",
    "achievements"))(
    lambda s, d: FL.default_values(A.achievements(s, d)).select("id", "display_order", "is_featured",
                                                                 "is_published", "year_no"))

_OUTCOME_SQL = """
SELECT seq, email, action, CASE
  WHEN action = 'subscribe' THEN CASE WHEN NOT ex THEN 'subscribed' WHEN prev = 'unsubscribed' THEN 'reactivated'
                                      ELSE 'already_subscribed' END
  WHEN action = 'add' THEN CASE WHEN ex THEN 'updated' ELSE 'added' END
  WHEN action = 'unsubscribe' THEN CASE WHEN ex AND prev = 'active' THEN 'unsubscribed' ELSE 'not_active' END
  WHEN action = 'set_status' THEN CASE WHEN ex THEN 'status_set' ELSE 'no_row' END
  ELSE CASE WHEN ex THEN 'deleted' ELSE 'no_row' END END AS outcome
FROM (SELECT *, coalesce(last_value(CASE WHEN action IN ('subscribe', 'add', 'delete') THEN action END IGNORE NULLS)
        OVER (PARTITION BY email ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IN ('subscribe', 'add'),
        false) AS ex,
      lag(CASE WHEN action IN ('subscribe', 'add') THEN 'active' WHEN action = 'unsubscribe' THEN 'unsubscribed'
               WHEN action = 'set_status' THEN status ELSE 'deleted' END) OVER (PARTITION BY email ORDER BY seq) AS prev
      FROM acts) q"""
register("action_outcomes", _fold_with(_OUTCOME_SQL))(
    lambda s, d: SUB.action_outcomes(SUB.validate_actions(A.actions(s, d))[0]))


# The handlers one by one, e-mail by e-mail: each step of the recursion applies every e-mail's next action.
_HANDLER_CTES = """
acts AS (SELECT *, coalesce(lower(trim(home)), '') AS mail FROM keyed_actions
  WHERE action IN ('subscribe', 'unsubscribe', 'add', 'set_status', 'delete') AND (want IS NOT NULL OR strpos(lower(trim(email)), '@') > 0)
    AND NOT (action = 'set_status' AND NOT coalesce(status IN ('active', 'unsubscribed'), false))),
o AS (SELECT *, row_number() OVER (PARTITION BY mail ORDER BY seq) AS rn FROM acts),
st AS (
  SELECT DISTINCT mail, 0::BIGINT AS rn, -1::BIGINT AS seq, NULL::VARCHAR AS action, NULL::BIGINT AS want, NULL::BIGINT AS id, NULL::VARCHAR AS state,
    NULL::VARCHAR AS full_name, NULL::VARCHAR AS source, NULL::TIMESTAMP AS subscribed_at, NULL::TIMESTAMP AS unsubscribed_at,
    NULL::VARCHAR AS outcome FROM o
  UNION ALL
  SELECT mail, rn, seq, action, want,
    CASE WHEN makes THEN seq WHEN action = 'delete' AND hit THEN NULL ELSE id END,
    CASE WHEN makes OR action = 'add' OR back THEN 'active' WHEN action = 'unsubscribe' AND hit AND state = 'active' THEN 'unsubscribed'
      WHEN action = 'set_status' AND hit THEN status WHEN action = 'delete' AND hit THEN NULL ELSE state END,
    CASE WHEN makes THEN name WHEN action = 'add' OR back THEN coalesce(name, full_name) ELSE full_name END,
    CASE WHEN makes THEN CASE WHEN action = 'subscribe' THEN 'website' ELSE 'admin' END ELSE source END,
    CASE WHEN makes OR back THEN ts ELSE subscribed_at END,
    CASE WHEN makes OR action = 'add' OR back THEN NULL WHEN action = 'unsubscribe' AND hit AND state = 'active' THEN ts
      WHEN action = 'set_status' AND hit THEN CASE WHEN status = 'unsubscribed' THEN ts END ELSE unsubscribed_at END,
    CASE WHEN action = 'subscribe' THEN CASE WHEN makes THEN 'subscribed' WHEN back THEN 'reactivated' ELSE 'already_subscribed' END
      WHEN action = 'add' THEN CASE WHEN makes THEN 'added' ELSE 'updated' END
      WHEN action = 'unsubscribe' THEN CASE WHEN hit AND state = 'active' THEN 'unsubscribed' ELSE 'not_active' END
      WHEN action = 'set_status' THEN CASE WHEN hit THEN 'status_set' ELSE 'no_row' END
      ELSE CASE WHEN hit THEN 'deleted' ELSE 'no_row' END END
  FROM (SELECT o.mail, o.rn, o.seq, o.ts, o.action, o.want, o.name, o.status, st.id, st.state, st.full_name, st.source, st.subscribed_at,
      st.unsubscribed_at, st.id IS NULL AND o.action IN ('subscribe', 'add') AS makes,
      st.id IS NOT NULL AND (o.want IS NULL OR o.want = st.id) AS hit,
      st.id IS NOT NULL AND o.action = 'subscribe' AND st.state = 'unsubscribed' AS back
    FROM st JOIN o ON o.mail = st.mail AND o.rn = st.rn + 1) s),
lasts AS (SELECT mail, max(rn) AS rn FROM o GROUP BY 1),
subs AS (SELECT st.id, st.mail AS email, st.full_name,
    CASE WHEN source = 'website' THEN (SELECT min(u.id) FROM users u WHERE lower(u.email) = st.mail) END AS user_id, state AS status,
    sha256('newsletter|' || st.mail || '|' || CAST(st.id AS VARCHAR)) AS confirm_token, source, subscribed_at, unsubscribed_at
  FROM st JOIN lasts USING (mail, rn) WHERE st.id IS NOT NULL)
"""


def _handled(s, d):
    return lives.resolve_actions(SUB.validate_actions(A.keyed_actions(s, d))[0], SALT)


def _with_handlers(sql: str) -> str:
    return with_views(sql, "actions", "keyed_actions", "users", ctes=_HANDLER_CTES, recursive=True)


register("subscribers_by_key", _with_handlers("SELECT * FROM subs"))(
    lambda s, d: SUB.fold_subscribers(_handled(s, d)[0], A.users(s, d), SALT))


def _key_outcomes(s, d):
    counted, stale = _handled(s, d)
    return SUB.action_outcomes(counted).unionByName(SUB.stale_outcomes(stale))


# An answer to a stale key has no e-mail: the row that it named is not there.
register("key_action_outcomes", _with_handlers(
    "SELECT seq, CASE WHEN want IS NOT NULL AND (outcome = 'no_row' OR (outcome = 'not_active' AND (want <> coalesce(before, -2)))) "
    "THEN NULL ELSE mail END AS email, action, outcome FROM (SELECT *, lag(id) OVER (PARTITION BY mail ORDER BY rn) AS before FROM st) b "
    "WHERE rn > 0"))(_key_outcomes)


# ------------------------------------------------- stored, day-partitioned --
def _stored_daily(s, d):
    """Intake writes the visits table partitioned by day; the 30-day series prunes folders."""
    from ..operators import timeseries
    from ..session import scratch_path
    from ..sources import sinks

    visits, _ = _visit_intake(s, d)
    path = scratch_path(s, "visits-by-day")
    sinks.append_events(visits, path, "visited_at")
    return timeseries.daily_counts(s.read.parquet(path), "visited_at", AS_OF, 30, day_partition="day")


register("stored_daily_counts", with_views(
    "SELECT strftime(CAST(visited_at AS DATE), '%Y-%m-%d') AS label, count(*) AS value FROM intake "
    f"WHERE {C.since_days('visited_at', 30)} GROUP BY 1", "visit_events", "sessions", "regions_seed",
    ctes="intake AS (" + VISIT_INTAKE_BODY + ")"))(_stored_daily)


def _escaped_list(s, d):
    from ..functions import html_escape

    rows = SUB.subscriber_list(_subs(s, d), None, "all")
    return rows.select("id", html_escape("email").alias("email_html"), html_escape("name").alias("name_html"))


_ESC = "replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
register("subscriber_rows_html", _fold_with(
    f"SELECT id, {_ESC.format(c='email')} AS email_html, {_ESC.format(c='full_name')} AS name_html "
    "FROM subs ORDER BY id DESC LIMIT 300"))(_escaped_list)
