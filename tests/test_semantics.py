"""Hand-made edge rows, one test per rule (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import ts
from kpiforge import schemas
from kpiforge.operators import achievements as ACH
from kpiforge.operators import campaigns as CMP
from kpiforge.operators import identity as ID
from kpiforge.operators import intake as INT
from kpiforge.operators import joins as J
from kpiforge.operators import kpis, series, subscribers, timeseries
from kpiforge.plans import dashboards as DB
from kpiforge.sources.tables import seed_categories, seed_regions


def visits(spark, rows):
    """rows: dicts with any VISITS columns; the rest NULL."""
    names = schemas.VISITS.fieldNames()
    full = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(full, schemas.VISITS)


def users(spark, rows):
    names = schemas.USERS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.USERS)


def sessions(spark, rows):
    names = schemas.SESSIONS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.SESSIONS)


def pairs(df):
    return {(r["label"], r["value"]) for r in df.collect()}


# Blank labels fall into one "unspecified" group
def test_blank_labels_one_group(spark):
    v = visits(spark, [{"id": i, "device_type": d} for i, d in enumerate([None, "", "  ", "mobile"])])
    assert pairs(series.by_device(v)) == {("unspecified", 3), ("mobile", 1)}
    assert pairs(series.count_by(v, "device_type")) == {("mobile", 1)}


# Week / month / 30-day boundaries, future rows count, no upper bound
def test_time_boundaries(spark):
    as_of = ts("2024-03-10 12:00:00")
    times = ["2024-03-04 00:00:00", "2024-03-03 23:59:59", "2024-03-01 00:00:00", "2024-02-10 00:00:00",
             "2024-02-09 23:59:00", "2024-03-11 08:00:00"]
    v = visits(spark, [{"id": i, "visited_at": ts(t), "visitor_id": "a"} for i, t in enumerate(times)])
    k = kpis.visit_kpis(v, as_of, "SA").first()
    assert k["week"] == 2  # 03-04 and the future 03-11
    assert k["month"] == 4  # 03-01, 03-03 23:59:59, 03-04, 03-11
    assert k["today"] == 0
    days = timeseries.daily_counts(v, "visited_at", as_of, 30).collect()
    assert [r["label"] for r in days] == ["2024-02-10", "2024-03-01", "2024-03-03", "2024-03-04", "2024-03-11"]


# Exact flag matches; NULL is neither
def test_flags_and_zero_results(spark):
    v = visits(spark, [{"id": 1, "is_registered": 1}, {"id": 2, "is_registered": 0}, {"id": 3}])
    k = kpis.visit_kpis(v, ts("2024-01-01 00:00:00"), "SA").first()
    assert (k["total_visits"], k["registered"], k["guests"]) == (3, 1, 1)
    names = schemas.SEARCH_LOG.fieldNames()
    s = spark.createDataFrame([tuple({"id": i, "results_cnt": r}.get(n) for n in names)
                               for i, r in enumerate([0, None, 3])], schemas.SEARCH_LOG)
    assert kpis.search_kpis(s, ts("2024-01-01 00:00:00")).first()["zero_results"] == 1


# Monday = 0, densify fills 24 hours and drops NULL hours
def test_weekday_and_densify(spark):
    v = visits(spark, [{"id": 1, "visited_at": ts("2024-01-01 05:00:00")},
                       {"id": 2, "visited_at": ts("2024-01-07 05:30:00")}, {"id": 3}])
    wd = {r["weekday"]: r["value"] for r in timeseries.weekday_profile(v, "visited_at").collect()}
    assert wd == {0: 1, 6: 1}
    dense = timeseries.densify(spark, timeseries.hourly_profile(v, "visited_at"), "hour", 24).collect()
    assert len(dense) == 24 and dense[5]["value"] == 2 and sum(r["value"] for r in dense) == 2


# Ages with month ends and leap days; NULL dropped; future birth -> under 18
def test_age_buckets(spark):
    births = [dt.date(2006, 2, 28), dt.date(2006, 3, 1), dt.date(2000, 2, 29), None, dt.date(2025, 1, 1)]
    u = users(spark, [{"id": i, "birth_date": b} for i, b in enumerate(births)])
    got = {r["label"]: r["value"] for r in series.age_groups(u, ts("2024-02-28 10:00:00")).collect()}
    assert got == {"18 - 24": 2, "under 18": 2}


# Namesakes stay apart by default, merge with by_name
def test_top_users_namesakes(spark):
    u = users(spark, [{"id": 1, "full_name": "Sam"}, {"id": 2, "full_name": "Sam"}])
    s = sessions(spark, [{"session_id": i, "user_id": 1 + i % 2} for i in range(4)])
    assert series.top_users(u, s).count() == 2
    assert pairs(series.top_users(u, s, by_name=True)) == {("Sam", 4)}


# Token lookup unique-or-null, never duplicates; region only for home country
def test_session_and_region_lookup(spark):
    as_of = ts("2024-01-10 00:00:00")
    future, past = ts("2024-02-01 00:00:00"), ts("2024-01-01 00:00:00")
    s = sessions(spark, [
        {"session_id": 1, "user_id": 7, "token": "one", "is_active": 1, "expires_at": future},
        {"session_id": 2, "user_id": 8, "token": "two", "is_active": 1, "expires_at": future},
        {"session_id": 3, "user_id": 9, "token": "two", "is_active": 1, "expires_at": future},
        {"session_id": 4, "user_id": 5, "token": "old", "is_active": 1, "expires_at": past},
        {"session_id": 5, "user_id": 6, "token": "off", "is_active": 0, "expires_at": future},
    ])
    tokens = ["one", "two", "old", "off", "none", None, "old", "one"]
    times = [as_of] * 6 + [ts("2023-12-31 00:00:00"), future]  # judged at each event's own time
    ev = spark.createDataFrame([(i, t, at) for i, (t, at) in enumerate(zip(tokens, times))],
                               "event_id long, token string, received_at timestamp")
    got = {r["event_id"]: r["session_user_id"] for r in J.attach_user(ev, s).collect()}
    assert got == {0: 7, 1: None, 2: None, 3: None, 4: None, 5: None, 6: 5, 7: None}
    assert {r["event_id"]: r["session_user_id"] for r in J.attach_user(ev, s.limit(0)).collect()} == dict.fromkeys(range(8))
    geo = spark.createDataFrame([(1, "SA", "01"), (2, "SA", "13"), (3, "AE", "01")], "id long, c string, r string")
    names = {r["id"]: r["region_name_lookup"] for r in J.attach_region(geo, seed_regions(spark), "SA", "c", "r").collect()}
    assert names == {1: "Riyadh", 2: None, 3: None}


# A session counts from its start until before its end; two open ones give no user
def test_sessions_count_only_while_they_exist(spark):
    day = [ts(f"2024-01-{d:02d} 00:00:00") for d in range(1, 32)]
    spans = [("a", 1, 5, 10), ("a", 2, 8, 12), ("a", 3, 12, 12), ("a", None, 20, 25), ("a", 4, 22, 23), ("b", 9, None, 6), ("b", 9, 4, 8), ("b", 5, 30, 2)]
    s = sessions(spark, [{"session_id": i, "user_id": u, "token": t, "is_active": 1, "created_at": None if b is None else day[b - 1],
                          "expires_at": day[e - 1]} for i, (t, u, b, e) in enumerate(spans)])
    ev = spark.createDataFrame([(100 * k + d, t, day[d - 1]) for k, t in enumerate("ab") for d in range(1, 32)] + [(999, "a", None)],
                               "event_id long, token string, received_at timestamp")

    def want(t, d):
        open_ = [u for tok, u, b, e in spans if tok == t and (b is None or b <= d) and e > d]
        return open_[0] if len(open_) == 1 else None

    for chunk_s in (3600, 40 * 86400):
        got = {r["event_id"]: r["session_user_id"] for r in J.attach_user(ev, s, chunk_s=chunk_s).collect()}
        assert got == {100 * k + d: want(t, d) for k, t in enumerate("ab") for d in range(1, 32)} | {999: None}
    assert got[5] == 1 and got[4] is None and got[8] is None and got[10] == 2 and got[12] is None and got[20] is None


# H7: made-up names are distinct from all others, also from those that look like them
def test_made_up_usernames_are_distinct(spark):
    u = users(spark, [{"id": 100, "username": "info"}, {"id": 101, "username": "Info-102"}])
    signins = spark.createDataFrame([(0, ts("2024-01-01 00:00:00"), "info@a.org", None, None), (1, ts("2024-01-01 00:00:00"), "info@b.org", None, None),
                                     (2, ts("2024-01-01 00:00:00"), "info-103@c.org", None, None), (3, ts("2024-01-01 00:00:00"), "new@c.org", None, None)],
                                    "seq long, ts timestamp_ntz, email string, name string, picture string")
    names = [r.username for r in ID.sign_in_upsert(u, signins)[0].collect()]
    assert len({n.lower() for n in names}) == len(names) == 6 and "new" in names and "info-103" in names


# Oversize country quarantined, long path truncated
def test_intake_quarantine_and_truncation(spark):
    names = schemas.VISIT_EVENT.fieldNames()
    rows = [{"event_id": 1, "country": "SAU", "path": "/a"}, {"event_id": 2, "country": "sa", "path": "/" + "p" * 599}]
    ev = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.VISIT_EVENT)
    s = sessions(spark, [])
    good, bad = INT.visit_intake(ev, s, seed_regions(spark), "SA")
    assert [r["event_id"] for r in bad.collect()] == [1]
    g = good.collect()
    assert len(g) == 1 and len(g[0]["page_path"]) == 500 and g[0]["country_code"] == "SA"


# The subscriber fold on the fixture sequence
def test_fold_sequence(spark):
    base = ts("2024-01-01 00:00:00")
    seq = [("subscribe", "N1"), ("subscribe", "N2"), ("unsubscribe", None), ("subscribe", None), ("delete", None),
           ("unsubscribe", None), ("add", "N7")]
    rows = [(i, base + dt.timedelta(minutes=i), a, " A@X.org ", None, None, n, None) for i, (a, n) in enumerate(seq)]
    acts = spark.createDataFrame(rows, schemas.ACTIONS)
    good, bad = subscribers.validate_actions(acts)
    out = subscribers.fold_subscribers(good, None, "newsletter", chunk_size=2).collect()
    assert bad.count() == 0 and len(out) == 1
    r = out[0]
    assert (r["email"], r["status"], r["full_name"], r["source"], r["id"]) == ("a@x.org", "active", "N7", "admin", 6)
    # before the delete: the reactivating subscribe kept N1
    first = subscribers.fold_subscribers(good.filter("seq < 4"), None, "newsletter").first()
    assert (first["full_name"], first["status"], first["source"]) == ("N1", "active", "website")
    assert first["subscribed_at"] == base + dt.timedelta(minutes=3) and first["unsubscribed_at"] is None


# Literal search, '%' is not a wildcard
def test_literal_search(spark):
    subs = spark.createDataFrame([(1, "a%b@x", None, "active", None), (2, "ab@x", None, "active", None)],
                                 "id long, email string, full_name string, status string, user_id long") \
        .withColumn("source", F.lit("website")).withColumn("subscribed_at", F.lit(None).cast("timestamp_ntz"))
    assert [r["id"] for r in subscribers.subscriber_list(subs, "%").collect()] == [1]


# Every claim check must be TRUE
def test_claim_checks(spark):
    rows = [("client-main", "accounts.google.com", "a@x", "true"), (None, "accounts.google.com", "b@x", "true"),
            ("client-main", "evil", "c@x", "true"), ("client-main", "accounts.google.com", "d@x", None)]
    c = spark.createDataFrame(rows, "aud string, iss string, email string, email_verified string")
    good, bad = ID.valid_signins(c, ["client-main"])
    assert [r["email"] for r in good.collect()] == ["a@x"]
    assert {r["reason"] for r in bad.collect()} == {"audience", "issuer", "email not verified"}


# Usernames unique ignoring case, also inside one batch
def test_username_dedupe_in_batch(spark):
    u = users(spark, [{"id": 1, "email": "old@z", "username": "A"}])
    sign = spark.createDataFrame([(1, ts("2024-01-01 00:00:00"), "a@x", "n1", None),
                                  (2, ts("2024-01-01 00:01:00"), "a@y", "n2", None)],
                                 "seq long, ts timestamp_ntz, email string, name string, picture string")
    out, _ = ID.sign_in_upsert(u, sign)
    names = [r["username"].lower() for r in out.collect()]
    assert len(names) == 3 and len(set(names)) == 3


# Dedupe keeps the oldest id, sessions follow; NULL e-mails untouched
def test_dedupe_and_repoint(spark):
    u = users(spark, [{"id": 5, "email": "X@e"}, {"id": 3, "email": "x@e"}, {"id": 8}, {"id": 9}])
    s = sessions(spark, [{"session_id": 1, "user_id": 5}, {"session_id": 2, "user_id": 8}])
    assert sorted(r["id"] for r in ID.dedupe_accounts(u).collect()) == [3, 8, 9]
    assert {r["session_id"]: r["user_id"] for r in ID.repoint_sessions(s, u).collect()} == {1: 3, 2: 8}


# Bad year -> latest; nothing published -> 2025; empty category hidden
def test_year_resolution_and_hidden_categories(spark):
    cats = seed_categories(spark)
    names = schemas.ACHIEVEMENTS.fieldNames()
    rows = [{"id": 1, "year_no": 2023, "category": "awards", "is_published": 1, "title": "t"},
            {"id": 2, "year_no": 2024, "category": "sports", "is_published": 0, "title": "t"}]
    ach = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.ACHIEVEMENTS)
    assert ACH.resolve_year(ach, "abc").first()["year"] == 2023
    assert ACH.resolve_year(ach.filter("id = 2"), None).first()["year"] == 2025
    cc = ACH.category_counts(ach, cats, ACH.resolve_year(ach, None)).collect()
    assert [(r["code"], r["count"]) for r in cc] == [("awards", 1)]


# Chains resolve to the end; cycles are rejected
def test_merge_chains(spark):
    m = spark.createDataFrame([(9, 5), (5, 1), (20, 21), (21, 20)], "src long, dst long")
    got = {r["src"]: (r["dst"], r["status"]) for r in ID.resolve_chains(m).collect()}
    assert got[9] == (1, "ok") and got[5] == (1, "ok")
    assert got[20][1].startswith("rejected") and got[21][1].startswith("rejected")


# I4: outcome texts
def test_outcomes(spark):
    r = spark.createDataFrame([(1, "a", 202, None, None), (1, "b", 429, "busy", None), (1, "c", None, None, "boom")],
                              schemas.RESPONSES)
    got = {x["email"]: (x["status"], x["error_msg"]) for x in CMP.classify_outcomes(r).collect()}
    assert got == {"a": ("sent", None), "b": ("failed", "HTTP 429 busy"), "c": ("failed", "boom")}


# The document is valid JSON with the KPI object first
def test_document_is_json(spark):
    import json

    v = visits(spark, [{"id": 1, "visited_at": ts("2024-01-30 08:00:00"), "page_path": "/a", "visitor_id": "v"}])
    names = schemas.SEARCH_LOG.fieldNames()
    s = spark.createDataFrame([tuple({"id": 1, "term_norm": "x"}.get(n) for n in names)], schemas.SEARCH_LOG)
    doc = json.loads(DB.to_document(DB.traffic_dashboard(v, s, ts("2024-01-30 12:00:00"), "SA")).first()[0])
    assert list(doc)[0] == "kpis" and doc["kpis"]["total_visits"] == 1 and doc["top_pages"] == [{"label": "/a", "value": 1}]


# HTML escape, '&' first so entities are not doubled
def test_html_escape(spark):
    from kpiforge.functions import html_escape

    df = spark.createDataFrame([('<a href="x">&amp;</a>',)], "s string")
    assert df.select(html_escape("s")).first()[0] == "&lt;a href=&quot;x&quot;&gt;&amp;amp;&lt;/a&gt;"


# Conditional distincts on one column share a pass; all three modes agree
def test_distinct_modes_agree(spark):
    rows = [{"id": 1, "visitor_id": "a", "visited_at": ts("2024-01-30 08:00:00"), "session_key": "s1"},
            {"id": 2, "visitor_id": "a", "visited_at": ts("2024-01-29 08:00:00"), "session_key": "s1"},
            {"id": 3, "visitor_id": "b", "visited_at": ts("2024-01-29 09:00:00"), "session_key": "s2"},
            {"id": 4, "visitor_id": None, "visited_at": ts("2024-01-30 09:00:00")},
            {"id": 5, "visitor_id": "c"}]
    v = visits(spark, rows)
    as_of = ts("2024-01-30 12:00:00")
    got = [kpis.visit_kpis(v, as_of, "SA", split=sp, approx=ap).first().asDict()
           for sp, ap in ((True, False), (False, False), (False, True))]
    assert got[0] == got[1] == got[2]
    assert (got[0]["unique_visitors"], got[0]["unique_today"], got[0]["sessions"]) == (3, 1, 2)


# The parts of a document, in order, are the document, whatever their size
def test_document_parts_are_the_document(spark):
    from conftest import SF_SMALL
    from kpiforge.plans.catalog import AS_OF, HOME
    from kpiforge.sources import adapters as A

    def whole(parts):
        rows = sorted(parts.collect(), key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(len(x.text.encode()) for x in rows[:i]) for i in range(len(rows))]
        return "".join(r.text for r in rows), len(rows)

    ach, cats = A.achievements(spark, SF_SMALL), A.categories(spark, SF_SMALL)
    for year, category in (("2024", None), ("2023", "SMALL"), ("1900", None)):
        want = ACH.achievements_document(ach, cats, year, category).first()["document"]
        for size, least in ((300, 1), (1 << 20, 1)):
            text, n = whole(ACH.achievements_parts(ach, cats, year, category, size))
            assert text == want and (n == 1) == (len(want.encode()) <= size or size > 1000)
    long = DB.traffic_dashboard(A.visits(spark, SF_SMALL), A.search_log(spark, SF_SMALL), AS_OF, HOME).cache()
    text, n = whole(DB.to_document_parts(long, 500))
    assert text == DB.to_document(long).first()[0] and n > 5
