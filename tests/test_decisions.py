import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from domainsieve.fixed import DEFAULT_FEEDS, Feed
from domainsieve.operators import (
    admission as adm, brands as br, denylist as dl, enrich as en, lookup, queries as qu, state as st,
    verdicts as vd)
from domainsieve.operators.names import with_name_keys
from domainsieve.params import DEFAULTS
from domainsieve.plans import feed_path, query_path

NOW = datetime(2024, 3, 1, 12)


def now():
    return F.lit("2024-03-01 12:00:00").cast("timestamp")


def days_ago(n):
    return NOW - timedelta(days=n)


@pytest.mark.parametrize("rows", [1000, 0])
def test_lookup_join_with_a_hot_key(spark, rows):
    """rows=0 forces the path for large tables; a third of all rows share one key."""
    data = [(f"d{i}", "hot" if i % 3 == 0 else f"k{i % 50}" if i % 7 else None, i % 5 != 0) for i in range(3000)]
    d = spark.createDataFrame(data, "domain string, key string, wanted boolean")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)], "k string, v int")
    got = lookup.lookup_join(d, table, "key", "k", [F.col("v")], only=F.col("wanted"), rows=rows)
    values = {"hot": 1, **{f"k{i}": i for i in range(0, 50, 2)}}
    assert {r["domain"]: r["v"] for r in got.collect()} == {
        n: values.get(k) if w else None for n, k, w in data}


def test_policy(spark, names):
    allow = spark.createDataFrame([("kept.harbour.example", False), (".intra.lake.example", True)],
                                  "entry string, is_suffix boolean")
    d = names("kept.harbour.example", "deep.kept.harbour.example", "wiki.intra.lake.example", "intra.lake.example",
              "intra-lake.example", "localhost", "nas.internal", "urlhaus.abuse.ch", "rough.xyz")
    kept = {r[0] for r in adm.skip_policy(d, adm.query_policy(allow)).collect()}
    assert kept == {"deep.kept.harbour.example", "intra.lake.example", "intra-lake.example", "rough.xyz"}
    kept = {r[0] for r in adm.skip_policy(d, adm.policy_index(allow)).collect()}
    assert "urlhaus.abuse.ch" in kept


def test_upstream_hosts_come_from_the_feeds(spark, names):
    allow = spark.createDataFrame([], "entry string, is_suffix boolean")
    feeds = (Feed("Own", url="https://Lists.Harbour.example:8443/daily.txt"), Feed("Landed"))
    d = names("lists.harbour.example", "harbour.example", "urlhaus.abuse.ch")
    kept = {r[0] for r in adm.skip_policy(d, adm.query_policy(allow, feeds=feeds)).collect()}
    assert kept == {"harbour.example", "urlhaus.abuse.ch"}


def test_denylist_add_cuts_the_last_dot(spark):
    allow = spark.createDataFrame([], "entry string, is_suffix boolean")
    empty = spark.createDataFrame([], "id long, domain string")
    d = spark.createDataFrame([("nas.lan.", "AI:C2:0.90"), ("Rough.xyz.", "AI:C2:0.90")], "domain string, comment string")
    got = dl.denylist_add(empty, d, adm.policy_index(allow), now())
    assert [r["domain"] for r in got.collect()] == ["rough.xyz"]


def test_many_events_of_one_name(spark):
    """A ttl of seconds over a long history of one name is one linear pass."""
    d = spark.range(100_000).select(F.lit("busy.example").alias("domain"), F.timestamp_micros(F.col("id") * 500_000).alias("ts"))
    assert adm.admit_history(d, 2.0 / 86_400, fold_events=200_000).count() == 20_000


def test_unseen(spark, names):
    seen = spark.createDataFrame([("new.com", days_ago(6.9)), ("old.com", days_ago(7.1)),
                                  ("edge.com", days_ago(7))], "domain string, last_seen timestamp")
    got = {r[0] for r in adm.unseen(names("new.com", "old.com", "edge.com", "never.com"), seen, now(), 7).collect()}
    assert got == {"old.com", "never.com"}


def replay(events, ttl, seen=()):
    last, out = dict(seen), set()
    for domain, ts in sorted(events, key=lambda e: e[1]):
        if domain not in last or ts > last[domain] + ttl:
            last[domain] = ts
            out.add((domain, ts))
    return out


@pytest.mark.parametrize("fold_events", [10_000, 100])
def test_admit_history_with_a_hot_name(spark, fold_events):
    """fold_events=100 sends the name with a third of all events through the slices."""
    rng = random.Random(11)
    events = [("hot" if i % 3 == 0 else f"n{rng.randint(0, 40)}",
               NOW + timedelta(seconds=rng.randint(0, 40 * 86400), microseconds=rng.randint(0, 9)))
              for i in range(1500)]
    seen = [("hot", NOW + timedelta(days=2)), ("n1", days_ago(1)), ("n2", days_ago(100))]
    d = spark.createDataFrame(events, "domain string, ts timestamp")
    s = spark.createDataFrame(seen, "domain string, last_seen timestamp")
    for ttl in (7, 1.5):
        got = {tuple(r) for r in adm.admit_history(d, ttl, fold_events=fold_events).collect()}
        assert got == replay(events, timedelta(days=ttl))
    got = {tuple(r) for r in adm.admit_history(d, 7, seen=s, fold_events=fold_events).collect()}
    assert got == replay(events, timedelta(days=7), seen)


def test_hits_do_not_refresh_the_clock(spark):
    d = spark.createDataFrame([("a", NOW + timedelta(days=x)) for x in (0, 4, 7, 8, 11)], "domain string, ts timestamp")
    got = sorted(r["ts"] for r in adm.admit_history(d, 7).collect())
    assert got == [NOW, NOW + timedelta(days=8)]


REPLIES = [
    ("block", '{"classification": "MALWARE", "confidence": 0.95, "severity": "HIGH", "risk_score": 5, '
              '"reasons": ["a", "b"], "recommended_action": "BLOCK"}', 15, "MALWARE", True, []),
    ("floor", '{"classification": "MALWARE", "confidence": 0.99, "risk_score": 95, "recommended_action": "BLOCK"}',
     14, "MALWARE", False, ["rule_score=14<15"]),
    ("low", '{"classification": "MALWARE", "confidence": 0.60, "recommended_action": "BLOCK"}', 50,
     "MALWARE", False, ["confidence=60%<80%"]),
    ("allow", '{"classification": "MALWARE", "confidence": 0.99, "recommended_action": "ALLOW"}', 50,
     "MALWARE", False, ["action=ALLOW"]),
    ("safe", '{"category": "SAFE", "confidence": 0.99, "reason": "Legitimate CDN"}', 50, "SAFE", False, []),
    ("quoted", '{"classification":"c2","confidence":"0.9","reasons":"one"}', 20, "C2", True, []),
    ("prose", 'Sure: {"classification": "SAFE", "confidence": 0.9, "detail": {"note": "nested"}} done', 20,
     "SAFE", False, []),
    ("second", '{x} then {"classification":"PHISHING","confidence":0.9} {', 20, "PHISHING", True, []),
    ("text", "I cannot classify this domain.", 20, "UNKNOWN", False, []),
    ("none", None, 20, "UNKNOWN", False, []),
    ("empty", "{}", 20, "UNKNOWN", False, []),
    ("list", '[{"classification":"C2"}]', 20, "UNKNOWN", False, []),
    ("broken", "nothing {bad", 20, "UNKNOWN", False, []),
]


def test_replies_and_gate(spark):
    d = spark.createDataFrame([(n, t, (s, "LOW")) for n, t, s, *_ in REPLIES],
                              "domain string, reply_text string, rules struct<rule_score:int,severity:string>")
    out = {r["domain"]: r for r in vd.gate_explain(vd.verdict_gate(vd.parse_replies(d))).collect()}
    for name, _, _, category, block, gates in REPLIES:
        r = out[name]
        assert (r["reply"]["category"], r["should_block"], r["failed_gates"]) == (category, block, gates), name
    assert out["block"]["reply"]["reason"] == "a; b"
    assert out["block"]["reply"]["risk_score"] == 5
    assert out["quoted"]["reply"]["reasons"] == ["one"]
    assert out["safe"]["reply"]["risk_score"] == 50 and out["safe"]["reply"]["severity"] == "LOW"
    assert out["text"]["reply"]["reason"] == "Could not parse model response"


VERDICTS = "id long, domain string, category string, confidence double, blocked boolean, classified_at timestamp"


@pytest.fixture(scope="module")
def tables(spark, index):
    popular = spark.createDataFrame([("google.com", 1), ("paypal.com", 60), ("github.io", 5), ("pop.com", 7)],
                                    "domain string, rank int")
    return query_path.QueryTables(
        index=index, brands=br.brand_index(br.brand_map(popular, index, br.seed_brands(spark))),
        classifications=spark.createDataFrame(
            [(1, "blocked.com", "MALWARE", 0.9, False, days_ago(3)), (2, "blocked.com", "MALWARE", 0.9, True, days_ago(2)),
             (3, "evil.github.io", "PHISHING", 0.9, True, days_ago(2)), (4, "free.com", "C2", 0.9, True, days_ago(5)),
             (5, "free.com", "EXPIRED", 0.0, False, days_ago(1))], VERDICTS),
        popular=popular,
        threats=spark.createDataFrame([("bad.pop.com",)], "domain string"),
        registrations=spark.createDataFrame([("paypa1-fresh.xyz", days_ago(5), NOW)],
                                            "domain string, created_at timestamp, fetched_at timestamp"),
        domain_asn=spark.createDataFrame([("paypa1-fresh.xyz", 205112, days_ago(6)), ("g00gle.ru", 205112, days_ago(8))],
                                         "domain string, asn long, fetched_at timestamp"),
        bad_asns=spark.createDataFrame([(205112,)], "asn long"),
        domain_tls=spark.createDataFrame(
            [("paypa1-fresh.xyz", ("X", 1, True, "self-signed", None), days_ago(1))],
            "domain string, info struct<issuer:string,san_count:int,verify_failed:boolean,fail_reason:string,"
            "not_before:timestamp>, fetched_at timestamp"))


def test_dispositions(spark, names, tables):
    d = names("WWW.Blocked.com.", "blocked.com", "a.evil.github.io", "www.free.com", "www.pop.com", "bad.pop.com",
              "user.github.io", "github.io", "quiet.org", "paypa1-fresh.xyz", "g00gle.ru", "g00gle.ru")
    out = {r["domain"]: r for r in query_path.dispositions(d, tables, now()).collect()}
    route = {n: r["route"] for n, r in out.items()}
    assert route == {
        "www.blocked.com": "SUBDOMAIN_BLOCK", "blocked.com": "PREFILTER", "a.evil.github.io": "SUBDOMAIN_BLOCK",
        "www.free.com": "PREFILTER", "www.pop.com": "POPULAR", "bad.pop.com": "PREFILTER",
        "user.github.io": "PREFILTER", "github.io": "POPULAR", "quiet.org": "PREFILTER",
        "paypa1-fresh.xyz": "SCORE", "g00gle.ru": "SCORE"}
    fresh = out["paypa1-fresh.xyz"]
    assert (fresh["age_days"], fresh["asn"], fresh["asn_flagged"]) == (5, 205112, True)
    assert fresh["rules"]["rule_score"] == min(fresh["first_rules"]["rule_score"] + 60 + 25, 100)
    assert out["g00gle.ru"]["asn"] is None
    assert out["www.pop.com"]["rules"] is None
    with_tls = query_path.dispositions(names("paypa1-fresh.xyz"), tables, now(), replace(DEFAULTS, use_tls=True))
    assert "TLS certificate failed verification (self-signed)" in with_tls.first()["rules"]["rule_reasons"]


def test_what_follows_from_dispositions(spark, names, tables):
    d = query_path.dispositions(names("www.blocked.com", "www.pop.com", "quiet.org", "g00gle.ru"), tables, now())
    rows = {r["domain"]: r for r in query_path.decided_verdicts(d).collect()}
    assert rows["www.pop.com"]["reason"] == "Popularity allowlist: apex pop.com rank=7"
    assert rows["www.pop.com"]["entropy"] is None
    assert rows["quiet.org"]["reason"] == "Rule pre-filter: score=0 below threshold=15"
    assert rows["quiet.org"]["rule_score"] == 0
    assert set(rows) == {"www.pop.com", "quiet.org"}
    assert [tuple(r) for r in query_path.subdomain_blocks(d).collect()] == [
        ("www.blocked.com", "AI:SUBDOMAIN:blocked.com")]
    prompt = query_path.model_requests(d).first()["prompt"]
    for part in ('"domain":"g00gle.ru"', '"brand_match_type":"leet"', '"domain_age_days":null', "Measured rule_score: ",
                 '"threat_intel":{}', "official", "exact", "contains", "embedded", "leet", "fuzzy"):
        assert part in prompt


def test_ages_and_caches(spark, names, index):
    cache = spark.createDataFrame(
        [("found.com", days_ago(900), days_ago(900)), ("none-new.com", None, days_ago(6.5)),
         ("none-old.com", None, days_ago(7)), ("ahead.com", NOW + timedelta(days=3), NOW)],
        "domain string, created_at timestamp, fetched_at timestamp")
    d = names("found.com", "none-new.com", "none-old.com", "ahead.com", "never.com")
    due = en.lookup_due(d, cache, now(), 7, F.col("created_at").isNotNull())
    assert {r[0] for r in due.collect()} == {"none-old.com", "never.com"}
    ages = en.enrich_age(with_name_keys(d, index), cache, now())
    assert {r["domain"]: r["age_days"] for r in ages.collect()} == {
        "found.com": 900, "none-new.com": None, "none-old.com": None, "ahead.com": 0, "never.com": None}


def test_feed_cycle(spark, index, tables):
    listed = spark.createDataFrame(
        [("URLhaus", n) for n in ("plain.org", "user.github.io", "github.io", "www.github.io", "x.pop.com",
                                  "known.org", "good.org")]
        + [("OpenPhish", n) for n in ("plain.org", "weak.org", "xn--paypa1-l0gin-9x2k.ru", "known.org")],
        "feed string, domain string")
    threats = spark.createDataFrame([("known.org", "URLhaus", days_ago(50), days_ago(40)),
                                     ("stale.org", "URLhaus", days_ago(90), days_ago(31))], st.THREAT_SCHEMA)
    deny = spark.createDataFrame([(1, "stale.org", 1, 1, 0, 0, "ti:MALWARE:URLhaus"), (2, "plain.org", 1, 1, 0, 0, "mine")],
                                 "id long, domain string, type int, enabled int, date_added long, date_modified long, comment string")
    mapping = spark.createDataFrame([(1, 0), (2, 0)], "domainlist_id long, group_id long")
    allow = spark.createDataFrame([("good.org", False)], "entry string, is_suffix boolean")
    t = feed_path.FeedTables(index, tables.brands, threats, tables.popular)

    def cycle(threats, deny, mapping):
        return feed_path.feed_cycle(listed, DEFAULT_FEEDS, replace(t, threats=threats), deny, mapping, 5,
                                    adm.policy_index(allow), now())
    out = cycle(threats, deny, mapping)
    got = {r["domain"]: (r["feed"], r["outcome"], r["blocked"]) for r in out["verified"].collect()}
    assert got == {
        "plain.org": ("URLhaus", "SCORE_BLOCK", True), "good.org": ("URLhaus", "SCORE_BLOCK", True),
        "user.github.io": ("URLhaus", "HOSTED_BLOCK", True), "github.io": ("URLhaus", "PROVIDER_SELF", False),
        "www.github.io": ("URLhaus", "PROVIDER_SELF", False), "x.pop.com": ("URLhaus", "POPULAR_SKIP", False),
        "weak.org": ("OpenPhish", "SCORE_SKIP", False),
        "xn--paypa1-l0gin-9x2k.ru": ("OpenPhish", "SCORE_BLOCK", True)}
    denied = {r["domain"]: (r["id"], r["comment"]) for r in out["denylist"].collect()}
    assert set(denied) == {"plain.org", "user.github.io", "xn--paypa1-l0gin-9x2k.ru"}
    assert denied["plain.org"] == (2, "mine")
    assert denied["user.github.io"][1] == "TI:MALWARE:URLhaus"
    assert sorted(i for i, _ in denied.values()) == [2, 3, 4]
    assert {(r[0], r[1]) for r in out["mapping"].collect()} == {(2, 5), (3, 5), (4, 5)}
    known = {r["domain"]: r for r in out["threats"].collect()}
    assert set(known) == set(got) | {"known.org"}
    assert known["known.org"]["added_at"] == days_ago(50) and known["known.org"]["last_seen"] == NOW
    log = {r["feed_name"]: (r["domains_added"], r["domains_skipped"]) for r in out["sync_log"].collect()}
    assert log == {"URLhaus": (1, 1), "OpenPhish": (1, 2)}
    expired = [r for r in out["verdicts"].collect() if r["category"] == "EXPIRED"]
    assert [r["domain"] for r in expired] == ["stale.org"]
    assert expired[0]["reason"] == "TI block expired — not re-seen in feeds for 30d"

    # Running the cycle on its own results changes nothing.
    again = cycle(out["threats"], out["denylist"], out["mapping"])
    for name in ("threats", "denylist", "mapping"):
        assert sorted(map(str, again[name].collect())) == sorted(map(str, out[name].collect())), name
    assert again["added"].count() == 0 and again["verdicts"].count() == 0


def test_state_tables(spark):
    seen = spark.createDataFrame([("a.com", days_ago(9), days_ago(9))], st.SEEN_SCHEMA)
    new = spark.createDataFrame([("a.com", NOW, NOW), ("b.com", NOW, NOW)], st.SEEN_SCHEMA)
    got = {r["domain"]: (r["first_seen"], r["last_seen"]) for r in
           st.upsert(seen, new, keep_first=("first_seen",)).collect()}
    assert got == {"a.com": (days_ago(9), NOW), "b.com": (NOW, NOW)}
    cache = "domain string, asn long, fetched_at timestamp"
    got = st.upsert(spark.createDataFrame([("a.com", 5, days_ago(9))], cache),
                    spark.createDataFrame([("a.com", None, NOW)], cache)).collect()
    assert [tuple(r) for r in got] == [("a.com", None, NOW)]
    old = spark.createDataFrame([("a.com", "F", days_ago(3))], "domain string, feed_name string, added_at timestamp")
    got = st.upgrade_schema(old, st.THREAT_SCHEMA, {"last_seen": "added_at"}).first()
    assert got["last_seen"] == days_ago(3)


def test_retention_and_freshness(spark):
    log = spark.createDataFrame([("URLhaus", NOW - timedelta(hours=24)), ("OpenPhish", NOW - timedelta(hours=25)),
                                 ("db-prune", NOW - timedelta(hours=24)), ("Tranco", NOW - timedelta(hours=100))],
                                "feed_name string, synced_at timestamp")
    feeds = spark.createDataFrame([("URLhaus",), ("OpenPhish",), ("New",)], "feed_name string")
    got = {r["feed_name"]: r["status"] for r in st.feed_freshness(log, feeds, now()).collect()}
    assert got == {"URLhaus": "fresh", "OpenPhish": "stale", "New": "never"}
    due = {r["feed_name"] for r in st.due_jobs(log, st.job_schedule(spark), now()).collect()}
    assert due == {"psl-private-domains", "spamhaus-asn-drop", "db-prune"}
    tables = {"sync_log": spark.createDataFrame([(days_ago(91),), (days_ago(89),)], "synced_at timestamp"),
              "threat_domains": spark.createDataFrame([(days_ago(500),)], "last_seen timestamp")}
    kept = st.retain(tables, now())
    assert {n: d.count() for n, d in kept.items()} == {"sync_log": 1, "threat_domains": 1}
    threats = spark.createDataFrame([("a", "F", NOW, days_ago(31)), ("b", "F", NOW, days_ago(30))], st.THREAT_SCHEMA)
    assert [r[0] for r in st.expired(threats, now()).collect()] == ["a"]
    assert st.expired(threats, now(), replace(DEFAULTS, block_expiry_days=0)).count() == 0


def test_denylist_groups(spark):
    groups = spark.createDataFrame([(0, 1, "Default", 0, 0, "")], "id long, enabled int, name string, "
                                   "date_added long, date_modified long, description string")
    made = dl.ensure_group(groups, now())
    assert dl.group_id(made) == 1 and dl.ensure_group(made, now()).count() == 2
    deny = spark.createDataFrame([(1, "a.com", 1, "AI:C2:0.90"), (2, "b.com", 1, "ti:X:y"), (3, "c.com", 1, None),
                                  (4, "d.com", 0, "AI:x")], "id long, domain string, type int, comment string")
    mapping = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (2, 7)], "domainlist_id long, group_id long")
    moved = dl.migrate_groups(deny, mapping, 1)
    assert {tuple(r) for r in moved.collect()} == {(1, 1), (2, 1), (2, 7), (3, 0)}
    assert {tuple(r) for r in dl.migrate_groups(deny, moved, 1).collect()} == {tuple(r) for r in moved.collect()}
    assert {r["domain"] for r in dl.group_members(deny, moved, made).collect()} == {"a.com", "b.com"}
    got = {tuple(r) for r in dl.blocks_by_origin(deny).collect()}
    assert got == {("AI", "C2", 1), ("ti", "X", 1), ("AI", "x", 1)}
