"""The registered queries: each runs one operator over whole driver tables.

Results are flat: integers as long, times as microseconds, lists joined by `|`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve import fixed
from domainsieve.functions.literals import literal_table

from domainsieve.operators import (
    admission as adm, brands as br, denylist as dl, enrich as en, features as fe, feeds as fd,
    names as nm, queries as qu, state as st, verdicts as vd)
from domainsieve.params import DEFAULTS
from domainsieve.plans import feed_path, query_path, state_cycle
from domainsieve.registry.inputs import as_of, brands, brands_index, index, table
from domainsieve.sources import json_files as jf, sinks, text as tx
from domainsieve.sources.tables import Store
from domainsieve.sources.workdir import new_folder, written

Query = Callable[[SparkSession, str], DataFrame]

EXPIRY = replace(DEFAULTS, block_expiry_days=10)
RETENTION = replace(DEFAULTS, retention_days=20)
FEEDS = (fixed.Feed("URLhaus", category="MALWARE"), fixed.Feed("OpenPhish", category="PHISHING"))


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def times(d: DataFrame) -> DataFrame:
    """Local times of the driver tables as timestamps; the session runs on UTC."""
    return d.select(*[F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n)
                      for n, t in d.dtypes])


def flat(d: DataFrame, *columns) -> DataFrame:
    """Selected columns; integers widened to long."""
    d = d.select(*columns) if columns else d
    return d.select(*[F.col(n).cast("long").alias(n) if t in ("int", "smallint", "tinyint") else F.col(n)
                      for n, t in d.dtypes])


def joined(c) -> F.Column:
    return F.array_join(c, "|")


# -- inputs put together ------------------------------------------------------

def keyed(spark, sf) -> DataFrame:
    return nm.with_name_keys(table(spark, sf, "names"), index(spark))


def lexical(spark, sf) -> DataFrame:
    return fe.lexical_features(keyed(spark, sf))


def featured(spark, sf) -> DataFrame:
    d = br.with_brand_match(lexical(spark, sf), brands_index(spark, sf))
    return fe.with_rules(d, provider=F.col("provider"))


def classifications(spark, sf) -> DataFrame:
    return times(table(spark, sf, "classifications"))


def policy(spark, sf, upstream: bool):
    allow = tx.parse_allowlist(table(spark, sf, "allow_lines"))
    return adm.query_policy(allow) if upstream else adm.policy_index(allow)


def certificate_rows(spark, sf) -> DataFrame:
    """Certificate rows as landed: signup stands for unreachable, error for a failed check."""
    kind = F.col("event_type")
    pair = (lambda k, v: F.array(F.array(F.lit(k), v)))
    cert = F.struct(
        F.array(pair("countryName", F.lit("US")),
                pair("organizationName", F.concat(F.lit("Org "), (F.col("event_id") % 5).cast("string")))
                ).alias("issuer"),
        F.concat(F.date_format("fetched_at", "MMM  d HH:mm:ss yyyy"), F.lit(" GMT")).alias("notBefore"),
        F.transform(F.slice(F.array(F.lit(0), F.lit(1)), 1, (F.col("event_id") % 3).cast("int")),
                    lambda i: F.array(F.lit("DNS"), i.cast("string"))).alias("subjectAltName"))
    return times(table(spark, sf, "tls_rows")).select(
        "domain", "fetched_at",
        F.when(kind == "error", "self-signed certificate").alias("error"),
        F.when(~kind.isin("error", "signup"), cert).alias("cert"))


def domain_tls(spark, sf) -> DataFrame:
    return jf.parse_certificates(certificate_rows(spark, sf))


def query_tables(spark, sf) -> query_path.QueryTables:
    return query_path.QueryTables(
        index=index(spark), brands=brands_index(spark, sf),
        classifications=classifications(spark, sf), popular=table(spark, sf, "popular"),
        threats=table(spark, sf, "threats"), registrations=times(table(spark, sf, "registrations")),
        domain_asn=times(table(spark, sf, "domain_asn")), bad_asns=table(spark, sf, "bad_asns"))


def decided(spark, sf) -> DataFrame:
    return query_path.dispositions(table(spark, sf, "names"), query_tables(spark, sf), as_of())


def feed_tables(spark, sf) -> feed_path.FeedTables:
    return feed_path.FeedTables(index(spark), brands_index(spark, sf),
                                times(table(spark, sf, "threats")), table(spark, sf, "popular"))


def verified(spark, sf) -> DataFrame:
    return feed_path.verify_feed(table(spark, sf, "listed"), FEEDS, feed_tables(spark, sf))


def with_replies(spark, sf) -> DataFrame:
    """Replies with a score that depends on the length of the name."""
    rules = F.struct(((F.length("domain") * 7) % 40).alias("rule_score"), F.lit("LOW").alias("severity"))
    return vd.parse_replies(table(spark, sf, "replies").withColumn("rules", rules))


def proposed_blocks(spark, sf) -> DataFrame:
    return table(spark, sf, "listed").select("domain", F.concat(F.lit("TI:"), "feed").alias("comment"))


def due_apexes(spark, sf) -> DataFrame:
    apexes = keyed(spark, sf).select(F.col("apex").alias("domain")).distinct()
    return en.lookup_due(apexes, times(table(spark, sf, "registrations")), as_of(),
                         DEFAULTS.registration_retry_days, F.col("created_at").isNotNull())


# -- sources ------------------------------------------------------------------

def landed(lines: DataFrame, name: str, order: str | None = None, files: int = 4) -> str:
    """Folder with the lines as several text files, in the order of the file names if `order` is given."""
    folder = new_folder(lines.sparkSession, name)
    d = lines.repartitionByRange(files, order).sortWithinPartitions(order) if order else lines.repartition(files)
    d.select("value").write.text(folder)
    return folder


def landed_json(rows: DataFrame, name: str, files: int = 4) -> str:
    """Folder with the rows as JSON lines in several files."""
    folder = new_folder(rows.sparkSession, name)
    rows.repartition(files).write.json(folder)
    return folder


def s1(spark, sf):
    path = landed(table(spark, sf, "log_lines"), "query-log")
    return tx.read_query_log(spark, path).select("domain", "time_text", "client")


def s2(spark, sf):
    """Two feeds of several files each: lines, and JSON arrays."""
    folder = new_folder(spark, "feeds")
    table(spark, sf, "feed_lines").repartition(4).select("value").write.text(f"{folder}/urls")
    json_arrays(table(spark, sf, "json_items")).write.option("maxRecordsPerFile", 1).text(f"{folder}/items")
    feeds = (fixed.Feed("urls", is_url_list=True), fixed.Feed("items", is_json=True, json_field="url"))
    return tx.read_domain_feed(spark, feeds, folder)


def json_arrays(items: DataFrame) -> DataFrame:
    """Arrays of some hundred objects as text."""
    arrays = items.groupBy(F.pmod(F.xxhash64("url"), F.lit(items.count() // 500 + 1))).agg(
        F.to_json(F.collect_list(F.struct("url"))).alias("value"))
    return arrays.select("value")


def s3(spark, sf):
    """The items land as files that hold one array each, of some hundred objects."""
    path = new_folder(spark, "json-feed")
    json_arrays(table(spark, sf, "json_items")).write.option("maxRecordsPerFile", 1).text(path)
    return jf.read_json_feed(spark, path)


def s3_array(spark, sf):
    """The items land as one file with one array, which several tasks read."""
    path, items = new_folder(spark, "json-array"), table(spark, sf, "json_items")
    line = F.concat(F.lit(","), F.to_json(F.struct("url", F.lit('a, "note" in [{brackets}]').alias("note"))))
    lines = items.select(F.lit(1).alias("at"), line.alias("value"))
    ends = literal_table(spark, [(0, '[{"note": "first }"}'), (2, "]")], "at int, value string")
    lines.unionByName(ends).orderBy("at").coalesce(1).select("value").write.text(path)
    return jf.read_json_feed(spark, path)


def s4(spark, sf):
    return flat(tx.read_ranked_list(spark, landed(table(spark, sf, "ranked_lines"), "ranked", "line_no"), 1500))


def s5(spark, sf):
    return tx.read_suffix_rules(spark, landed(table(spark, sf, "suffix_lines"), "suffixes", "line_no"))


def s6(spark, sf):
    return jf.read_asn_list(spark, landed(table(spark, sf, "asn_lines"), "asn-list"))


def s7(spark, sf):
    return tx.read_allowlist(spark, landed(table(spark, sf, "allow_lines"), "allowlist"))


def s8(spark, sf):
    """Orders of a customer as the events of a registration document."""
    action = F.when(F.col("o_orderstatus") == "F", "registration").otherwise("last changed")
    event = F.struct("o_orderkey", action.alias("eventAction"),
                     F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("eventDate"))
    docs = (table(spark, sf, "orders").groupBy("o_custkey")
            .agg(F.array_sort(F.collect_list(event)).alias("events"))
            .select(F.concat(F.lit("name"), "o_custkey", F.lit(".com")).alias("domain"), "events",
                    as_of().alias("fetched_at")))
    read = jf.read_registrations(spark, landed_json(docs, "registrations"))
    return read.select("domain", us("created_at").alias("created_us"))


def s9(spark, sf):
    record = F.when(F.col("s_suppkey") % 3 == 0, '"| no asn here |"').otherwise(
        F.concat(F.lit('"'), "s_suppkey", F.lit(' 7018 | 10.0.0.0/24 | US | arin |"')))
    records = table(spark, sf, "supplier").select(
        F.concat(F.lit("10.0."), "s_nationkey").alias("ip"), record.alias("txt"),
        F.col("s_suppkey").alias("record_no"))
    return jf.read_origin_asn(spark, landed_json(records, "origins"))


def s9_domains(spark, sf):
    """Names with an address, and the network of the address."""
    record = F.when(F.col("s_suppkey") % 3 == 0, '"| none |"').otherwise(
        F.concat(F.lit('"'), "s_suppkey", F.lit(' | 10.0.0.0/16 | NL |"')))
    origins = jf.read_origin_asn(spark, landed_json(table(spark, sf, "supplier").select(
        F.concat(F.lit("10.0."), "s_nationkey").alias("ip"), record.alias("txt"),
        F.col("s_suppkey").alias("record_no")), "origins"))
    addresses = table(spark, sf, "names").select(
        "domain", F.concat(F.lit("10.0."), F.length("domain") % 30).alias("ip"), as_of().alias("fetched_at"))
    return flat(jf.domain_asn(addresses, origins), "domain", "asn")


def s10(spark, sf):
    read = jf.read_certificates(spark, landed_json(certificate_rows(spark, sf), "certificates"))
    return flat(read, "domain", F.col("info").isNotNull().alias("has_info"),
                "info.issuer", "info.san_count", "info.verify_failed", "info.fail_reason",
                us("info.not_before").alias("not_before_us"))


def s11(spark, sf):
    bootstrap = spark.range(1).select(F.from_json(F.lit(
        '{"services": [[["XYZ"], ["http://plain.example/", "https://rdap.one.example/"]],'
        ' [["com", "net"], ["https://rdap.two.example/v1/"]], [["ru"], []]]}'),
        jf.BOOTSTRAP_SCHEMA).alias("doc")).select("doc.*")
    return jf.lookup_requests(due_apexes(spark, sf), jf.parse_bootstrap(bootstrap)).select("apex", "url")


def s12(spark, sf):
    """Two snapshots, the second of them empty, read back."""
    path, popular = new_folder(spark, "snapshot"), table(spark, sf, "popular")
    sinks.write_snapshot(popular, path)
    sinks.write_snapshot(popular.filter("rank < 0"), path)
    return flat(sinks.read_snapshot(spark, path))


def s13(spark, sf):
    """Two appends, read back."""
    path, names = new_folder(spark, "log"), table(spark, sf, "names")
    even = F.length("domain") % 2 == 0
    sinks.append_log(names.filter(even), path, "domain", as_of())
    sinks.append_log(names.filter(~even), path, "domain", as_of())
    return spark.read.parquet(path).select("domain", "id", us("classified_at").alias("classified_us"))


# -- names, features, brands --------------------------------------------------

def k5(spark, sf):
    snapshot = table(spark, sf, "hosts").select(F.expr("substr(domain, instr(domain, '.') + 1)").alias("suffix"))
    return nm.hosting_suffixes(snapshot, snapshot.limit(0))


def lexical_query(*columns) -> Query:
    return lambda spark, sf: flat(lexical(spark, sf), "domain", *columns)


def b2(spark, sf):
    d = table(spark, sf, "names").union(table(spark, sf, "popular").select("domain")).distinct()
    d = br.official_brand_join(nm.with_name_keys(d, index(spark)), brands_index(spark, sf))
    return d.filter("official IS NOT NULL").select("domain", "official.*")


def b4(spark, sf):
    d = table(spark, sf, "names").union(table(spark, sf, "popular").select("domain")).distinct()
    found = brands_index(spark, sf)
    d = br.official_brand_join(nm.with_name_keys(d, index(spark)), found).filter("official IS NULL")
    return flat(br.brand_similarity_join(br.brand_candidates(d), found),
                "domain", "brand", "confidence", "edit_distance", "match_type")


def b5(spark, sf):
    return table(spark, sf, "names").select(F.col("domain").alias("brand"),
                                            br.brand_label(F.col("domain")).alias("brand_label"))


# -- query path ---------------------------------------------------------------

def q1(spark, sf):
    return adm.skip_policy(table(spark, sf, "names"), policy(spark, sf, upstream=True))


def q2(spark, sf):
    d = table(spark, sf, "dns_events").select("domain", "event_id", "ts")
    return adm.distinct_first(d, "event_id").select("domain", "event_id", us("ts").alias("ts_us"))


def q3(spark, sf):
    return adm.unseen(table(spark, sf, "names"), times(table(spark, sf, "seen")), as_of(), 7)


def q4(spark, sf):
    d = adm.admit_history(table(spark, sf, "dns_events"), 7)
    return d.select("domain", us("ts").alias("ts_us"))


def q4_users(spark, sf):
    """Few keys with many events each; the limit is set so that half of them count as hot."""
    d = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("domain"), "ts")
    per_key = d.count() // max(d.select("domain").distinct().count(), 1)
    return adm.admit_history(d, 7, fold_events=per_key).select("domain", us("ts").alias("ts_us"))


def q5(spark, sf):
    from domainsieve.streaming.admission import admit_stream, use_rocksdb
    use_rocksdb(spark)
    folder = new_folder(spark, "admit-stream")
    d = times(table(spark, sf, "dns_events").select("domain", "ts"))
    # Three parts that land one after the other, in order of time; the stream goes on after each.
    part = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for i in range(3):
        d.filter(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("domain string, ts timestamp").parquet(f"{folder}/in")
        run = (admit_stream(stream, 7).writeStream.format("parquet").option("path", f"{folder}/out")
               .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
        run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("domain", us("ts").alias("ts_us"))


def q6(spark, sf):
    d = qu.blocked_apex_join(keyed(spark, sf), classifications(spark, sf))
    return d.filter("apex_blocked").select("domain", qu.subdomain_comment().alias("comment"))


def q7(spark, sf):
    d = qu.popularity_allow(keyed(spark, sf), table(spark, sf, "popular"), table(spark, sf, "threats"))
    return flat(d.filter("popular_allowed"), "domain", "rank")


def q9(spark, sf):
    return flat(en.enrich_age(keyed(spark, sf), times(table(spark, sf, "registrations")), as_of()),
                "domain", "age_days")


def q10(spark, sf):
    return flat(en.enrich_asn(table(spark, sf, "names"), times(table(spark, sf, "domain_asn")),
                              table(spark, sf, "bad_asns"), as_of()))


def q11(spark, sf):
    d = en.enrich_tls(table(spark, sf, "names"), domain_tls(spark, sf), as_of())
    return flat(d, "domain", F.col("tls").isNotNull().alias("has_tls"), "tls.cert_age_days",
                "tls.verify_failed")


def q12(spark, sf):
    return decided(spark, sf).filter("evidence IS NOT NULL").select("domain", "evidence")


def q13(spark, sf):
    return flat(query_path.model_requests(decided(spark, sf)))


def q14(spark, sf):
    return flat(with_replies(spark, sf), "domain", "reply.category", "reply.confidence", "reply.reason",
                "reply.severity", "reply.risk_score", joined("reply.reasons").alias("reasons"),
                "reply.action")


def q15(spark, sf):
    return vd.verdict_gate(with_replies(spark, sf)).select("domain", "reply.category", "should_block")


def q16(spark, sf):
    return vd.gate_explain(with_replies(spark, sf)).select(
        "domain", F.array_join("failed_gates", ", ").alias("failed_gates"))


def q17(spark, sf):
    return flat(decided(spark, sf), "domain", "route", F.col("first_rules.rule_score").alias("first_score"),
                "rules.rule_score", "rules.severity", joined("rules.rule_reasons").alias("rule_reasons"),
                "rank", "age_days", "asn", "asn_flagged")


def q17_certificates(spark, sf):
    tables = replace(query_tables(spark, sf), domain_tls=domain_tls(spark, sf))
    d = query_path.dispositions(table(spark, sf, "names"), tables, as_of(), replace(DEFAULTS, use_tls=True))
    return flat(d, "domain", "route", "rules.rule_score", joined("rules.rule_reasons").alias("rule_reasons"),
                "tls.cert_age_days", "tls.verify_failed")


def q17_verdicts(spark, sf):
    return flat(query_path.decided_verdicts(decided(spark, sf)), "domain", "category", "confidence",
                "reason", "blocked", "rule_score", "tld")


def q18(spark, sf):
    """The log lines land as files; the stream decides every name once."""
    from domainsieve.streaming.query_path import disposition_stream
    folder = new_folder(spark, "disposition-stream")
    (table(spark, sf, "dns_events").select(F.concat(
        F.lit("Jan 01 00:00:00 dnsmasq[1]: query[A] "), "domain", F.lit(" from 10.0.0.1")).alias("value"),
        (F.col("event_id") % 2).alias("half")).write.partitionBy("half").text(f"{folder}/log"))
    lines = tx.read_query_log(spark, f"{folder}/log", streaming=True, max_files_per_trigger=100)
    tables = query_tables(spark, sf)
    no_list = literal_table(spark, [], "entry string, is_suffix boolean")
    run = disposition_stream(lines.select("domain"), f"{folder}/out", f"{folder}/state",
                             adm.query_policy(no_list), lambda _: tables, as_of(), availableNow=True)
    run.awaitTermination()
    return flat(spark.read.parquet(f"{folder}/out/decided"), "domain", "route", "rules.rule_score")


# -- feeds --------------------------------------------------------------------

def t2(spark, sf):
    return fd.first_feed_wins(table(spark, sf, "listed"), fd.feed_table(spark, FEEDS)).select("domain", "feed")


def outcome_query(outcome: str) -> Query:
    return lambda spark, sf: verified(spark, sf).filter(F.col("outcome") == outcome).select(
        "domain", "feed", "blocked", "confidence", "reason")


def t6(spark, sf):
    return flat(verified(spark, sf).filter(F.col("outcome").isin("SCORE_BLOCK", "SCORE_SKIP")),
                "domain", "feed", "rules.rule_score", "blocked", "confidence")


def t7(spark, sf):
    return verified(spark, sf).select("domain", "feed", "category", "outcome", "blocked", "confidence", "reason")


def t8(spark, sf):
    v = written(verified(spark, sf), new_folder(spark, "verified"))
    added = dl.denylist_add(table(spark, sf, "denylist"),
                            v.filter("blocked").select("domain", fd.feed_comment().alias("comment")),
                            policy(spark, sf, upstream=False), as_of())
    return fd.sync_summary(v, table(spark, sf, "listed"), added, fd.feed_table(spark, FEEDS))


# -- state --------------------------------------------------------------------

def m1(spark, sf):
    new = table(spark, sf, "listed").groupBy("domain").agg(F.min("feed").alias("feed_name")).select(
        "domain", "feed_name", as_of().alias("added_at"), as_of().alias("last_seen"))
    d = st.upsert(times(table(spark, sf, "threats")), new, keep_first=("feed_name", "added_at"))
    return d.select("domain", "feed_name", us("added_at").alias("added_us"), us("last_seen").alias("last_seen_us"))


def m1_caches(spark, sf):
    """Lookup results and sightings of all names at one time, over what is known."""
    names = table(spark, sf, "names")
    found = names.select("domain", as_of().alias("created_at"), as_of().alias("fetched_at"))
    r = st.upsert(times(table(spark, sf, "registrations")), found, keep_first=("created_at",))
    seen = names.select("domain", as_of().alias("first_seen"), as_of().alias("last_seen"))
    s = st.upsert(times(table(spark, sf, "seen")), seen, keep_first=("first_seen",))
    part = (lambda d, name, a, b: d.select(F.lit(name).alias("part"), "domain", us(a).alias("first_us"),
                                           us(b).alias("last_us")))
    return part(r, "registration", "created_at", "fetched_at").union(part(s, "seen", "first_seen", "last_seen"))


def m10_network(spark, sf):
    """Five days later, when a part of the caches is old."""
    names, later, out = table(spark, sf, "names"), as_of() + F.expr("INTERVAL 5 DAYS"), None
    for part, cache in (("network", times(table(spark, sf, "domain_asn"))), ("certificate", domain_tls(spark, sf))):
        one = en.lookup_due(names, cache, later, 2).select(F.lit(part).alias("part"), "domain")
        out = one if out is None else out.union(one)
    return out


def m3(spark, sf):
    return st.touch(times(table(spark, sf, "threats")), table(spark, sf, "listed"), as_of()).select(
        "domain", us("last_seen").alias("last_seen_us"))


def expiry_parts(out: dict[str, DataFrame]) -> DataFrame:
    """What is left of the four tables, and the verdicts; a mapping row goes by its denylist id."""
    none = F.lit(None).cast("long").alias("group_id")
    part = (lambda name, key: out[key].select(F.lit(name).alias("part"), "domain", none))
    mapping = out["mapping"].select(F.lit("mapping").alias("part"), F.col("domainlist_id").cast("string").alias("domain"),
                                    F.col("group_id").cast("long").alias("group_id"))
    return part("threat", "threats").union(part("denylist", "denylist")).union(part("verdict", "verdicts")).union(mapping)


def m5(spark, sf):
    return expiry_parts(st.expire_blocks(
        times(table(spark, sf, "threats")), table(spark, sf, "denylist"), table(spark, sf, "mapping"), as_of(), EXPIRY))


# -- tables of a store ----------------------------------------------------------

def buckets(spark) -> int:
    """As many as a shuffle has partitions, so that joins read the clustered side in place."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(spark, **clustered: DataFrame) -> Store:
    """A store with the given tables, clustered by name."""
    store = Store(spark, new_folder(spark, "store"))
    change = store.change()
    for name, d in clustered.items():
        change.replace(name, d, "domain", buckets(spark))
    change.commit()
    return store


def q3_clustered(spark, sf):
    store = stored(spark, seen_domains=times(table(spark, sf, "seen")))
    return adm.unseen(table(spark, sf, "names"), store.read("seen_domains"), as_of(), 7)


def t1_clustered(spark, sf):
    store = stored(spark, threats=times(table(spark, sf, "threats")))
    return fd.new_feed_domains(table(spark, sf, "listed"), store.read("threats")).select("feed", "domain")


def m3_clustered(spark, sf):
    """The touched table becomes the next version."""
    store = stored(spark, threats=times(table(spark, sf, "threats")))
    change = store.change()
    change.replace("threats", st.touch(change.read("threats"), table(spark, sf, "listed"), as_of()), "domain",
                   buckets(spark), placed=True)
    change.commit()
    return store.read("threats").select("domain", us("last_seen").alias("last_seen_us"))


def verdict_log(spark, sf) -> Store:
    """A log of verdicts that came in three parts, the second of them late, with the newest kept up to date."""
    store, d = Store(spark, new_folder(spark, "store")), classifications(spark, sf)
    third = F.dayofmonth("classified_at")
    for some in (third <= 10, third > 20, third.between(11, 20)):
        change = store.change()
        change.append("classifications", d.filter(some), "classified_at")
        state_cycle.refresh_latest(change, buckets(spark))
        change.commit()
    return store


def m2_kept(spark, sf):
    return verdict_log(spark, sf).read("latest_verdicts").select("domain", "category", "confidence", "blocked")


def m5_store(spark, sf):
    store = stored(spark, threats=times(table(spark, sf, "threats")))
    change = store.change()
    change.replace("denylist", table(spark, sf, "denylist"))
    change.replace("mapping", table(spark, sf, "mapping"))
    change.commit()
    state_cycle.expire_cycle(store, as_of(), EXPIRY)
    return expiry_parts({"verdicts": store.read("classifications"), "threats": store.read("threats"),
                         "denylist": store.read("denylist"), "mapping": store.read("mapping")})


def m6_store(spark, sf):
    store = verdict_log(spark, sf)
    change = store.change()
    change.append("sync_log", times(table(spark, sf, "sync_log")), "synced_at")
    change.replace("seen_domains", times(table(spark, sf, "seen")), "domain", buckets(spark))
    change.commit()
    state_cycle.retention_cycle(store, as_of(), RETENTION)
    out = None
    for name, key in (("classifications", "id"), ("sync_log", "id"), ("seen_domains", "domain"), ("latest_verdicts", "domain")):
        one = store.read(name).select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"))
        out = one if out is None else out.union(one)
    return out


def m9_store(spark, sf):
    """Rows of three schemas: without feed and last sighting, without the latter, and whole."""
    store, d = Store(spark, new_folder(spark, "store")), times(table(spark, sf, "threats"))
    third = F.pmod(F.length("domain"), F.lit(3))
    columns = ("domain", "n", "added_at", "feed_name", "last_seen")
    kinds = ("string", "int", "timestamp", "string", "timestamp")
    for k, (width, number) in enumerate(((3, "int"), (4, "bigint"), (5, "bigint"))):
        change = store.change()
        schema = ", ".join(f"{c} {number if c == 'n' else t}" for c, t in list(zip(columns, kinds))[:width])
        if k:
            change.evolve("threat_log", schema, {"last_seen": "added_at"} if k == 2 else None)
        change.append("threat_log", d.filter(third == k).withColumn("n", F.length("domain").cast(number))
                      .select(*columns[:width]), "added_at")
        change.commit()
    return store.read("threat_log").select("domain", "feed_name", "n", us("added_at").alias("added_us"),
                                           us("last_seen").alias("last_seen_us"))


def m6(spark, sf):
    kept = st.retain({"classifications": classifications(spark, sf),
                      "sync_log": times(table(spark, sf, "sync_log")),
                      "seen_domains": times(table(spark, sf, "seen")),
                      "domain_asn": times(table(spark, sf, "domain_asn")),
                      "domain_tls": domain_tls(spark, sf)}, as_of(), RETENTION)
    out = None
    for name, d in kept.items():
        key = "id" if "id" in d.columns else "domain"
        one = d.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("key"))
        out = one if out is None else out.union(one)
    return out


def m7(spark, sf):
    feeds = literal_table(spark, [("URLhaus",), ("OpenPhish",), ("Other",)], "feed_name string")
    return st.feed_freshness(times(table(spark, sf, "sync_log")), feeds, as_of())


def m8(spark, sf):
    return st.due_jobs(times(table(spark, sf, "sync_log")), st.job_schedule(spark), as_of())


def m9(spark, sf):
    old = times(table(spark, sf, "threats")).drop("last_seen")
    return st.upgrade_schema(old, st.THREAT_SCHEMA, {"last_seen": "added_at"}).select(
        "domain", "feed_name", us("added_at").alias("added_us"), us("last_seen").alias("last_seen_us"))


# -- denylist and reports -----------------------------------------------------

def d1(spark, sf):
    return flat(dl.denylist_add(table(spark, sf, "denylist"), proposed_blocks(spark, sf),
                                policy(spark, sf, upstream=False), as_of()),
                "id", "domain", "type", "enabled", "date_added", "comment")


def d2(spark, sf):
    ids = dl.listed_ids(table(spark, sf, "denylist"), table(spark, sf, "listed"))
    return flat(dl.group_assign(table(spark, sf, "mapping"), ids, 5))


def d2_new_group(spark, sf):
    """The block group is missing and is made first."""
    other = table(spark, sf, "nation").select(
        (F.col("n_nationkey") + 10).cast("long").alias("id"), F.lit(1).alias("enabled"), F.col("n_name").alias("name"),
        F.lit(0).cast("long").alias("date_added"), F.lit(0).cast("long").alias("date_modified"),
        F.lit("clients").alias("description"))
    first = other.limit(1).select(F.lit(0).cast("long").alias("id"), "enabled", F.lit("Default").alias("name"),
                                  "date_added", "date_modified", "description")
    groups = dl.ensure_group(first.unionByName(other), as_of())
    ids = dl.listed_ids(table(spark, sf, "denylist"), table(spark, sf, "listed"))
    return flat(dl.group_assign(table(spark, sf, "mapping"), ids, dl.group_id(groups)))


def q19(spark, sf):
    """Replies of the model, gated, to denylist rows and their group."""
    replied = vd.verdict_gate(with_replies(spark, sf))
    blocks = vd.block_comments(replied)
    deny, mapping = query_path.block_names(
        blocks, table(spark, sf, "denylist"), table(spark, sf, "mapping"), 5, policy(spark, sf, upstream=False), as_of())
    return flat(deny.join(mapping, F.col("id") == F.col("domainlist_id"), "left"), "id", "domain", "comment", "group_id")


def d3(spark, sf):
    old = st.expired(times(table(spark, sf, "threats")), as_of(), EXPIRY)
    deny, mapping = dl.denylist_remove(table(spark, sf, "denylist"), table(spark, sf, "mapping"), old, "TI:")
    return flat(deny.join(mapping, F.col("id") == F.col("domainlist_id"), "left"), "id", "domain", "group_id")


def d4(spark, sf):
    return flat(dl.migrate_groups(table(spark, sf, "denylist"), table(spark, sf, "mapping"), 5))


def r1(spark, sf):
    return flat(dl.group_members(table(spark, sf, "denylist"), table(spark, sf, "mapping"),
                                 table(spark, sf, "groups")))


def r2(spark, sf):
    return st.recent_verdicts(classifications(spark, sf), 50).select(
        "id", "domain", "category", "confidence", "blocked")


def r3(spark, sf):
    return st.sync_history(times(table(spark, sf, "sync_log")), 20).select(
        "id", "feed_name", "domains_added", "domains_skipped")


def r6(spark, sf):
    d = table(spark, sf, "names").union(table(spark, sf, "popular").select("domain")).distinct()
    return flat(qu.popularity_rank(d, table(spark, sf, "popular")))


def rounded(c: str) -> F.Column:
    return F.round(c, 9).alias(c.split(".")[-1])


def queries() -> dict[str, Query]:
    names = (lambda spark, sf: table(spark, sf, "names"))
    return {
        "S1_read_query_log": s1, "S2_read_domain_feed": s2, "S3_read_json_feed": s3, "S3_read_json_array": s3_array,
        "S4_read_ranked_list": s4, "S5_read_suffix_rules": s5, "S6_read_asn_list": s6,
        "S7_read_allowlist": s7, "S8_read_registrations": s8, "S9_read_origin_asn": s9, "S9_domain_asn": s9_domains,
        "S10_read_certificates": s10, "S11_lookup_requests": s11, "S12_write_snapshot": s12,
        "S13_append_log": s13,
        "K1_apex": lambda s, f: nm.with_apex(names(s, f), index(s)),
        "K2_private_apex": lambda s, f: nm.with_private_apex(names(s, f), index(s)),
        "K3_host_labels": lambda s, f: nm.with_host_labels(names(s, f), index(s)),
        "K4_hosting_provider": lambda s, f: nm.with_hosting_provider(names(s, f), index(s)),
        "K5_hosting_suffixes": k5,
        "F1_lengths": lexical_query("lexical.*"),
        "F2_character_mix": lexical_query("mix.*"),
        "F3_repeats": lexical_query("repeats.*"),
        "F4_hint_words": lexical_query("dictionary_word_count"),
        "F5_entropy": lambda s, f: lexical_query(
            rounded("entropy.shannon"), rounded("entropy.normalized"))(s, f),
        "F6_tld": lexical_query("tld.*"),
        "F7_digits": lexical_query("digits.*"),
        "F8_hyphens": lexical_query("hyphens.*"),
        "F9_punycode": lexical_query("is_punycode"),
        "F10_dga_score": lexical_query("dga_score"),
        "F11_rule_score": lambda s, f: flat(featured(s, f), "domain", "rules.rule_score"),
        "F12_severity": lambda s, f: featured(s, f).select("domain", "rules.severity"),
        "F13_reasons": lambda s, f: featured(s, f).select(
            "domain", joined("rules.rule_reasons").alias("rule_reasons")),
        "B1_brand_map": lambda s, f: flat(brands(s, f)),
        "B2_official_brand": b2,
        "B3_brand_candidates": lambda s, f: flat(br.brand_candidates(keyed(s, f))),
        "B4_brand_similarity": b4, "B5_brand_label": b5,
        "Q1_skip_policy": q1, "Q2_distinct_first": q2, "Q3_unseen": q3, "Q3_unseen_clustered": q3_clustered, "Q4_admit_history": q4,
        "Q4_admit_users": q4_users, "Q5_admit_stream": q5, "Q6_blocked_apex": q6,
        "Q7_popularity_allow": q7,
        "Q8_rule_prefilter": lambda s, f: qu.rule_prefilter(featured(s, f)).select("domain", "prefiltered"),
        "Q9_enrich_age": q9, "Q10_enrich_asn": q10, "Q11_enrich_tls": q11, "Q12_evidence": q12,
        "Q13_scoring_requests": q13, "Q14_parse_replies": q14, "Q15_verdict_gate": q15,
        "Q16_gate_explain": q16, "Q17_dispositions": q17, "Q17_with_certificates": q17_certificates,
        "Q17_decided_verdicts": q17_verdicts,
        "Q18_disposition_stream": q18, "Q19_replies_to_blocks": q19,
        "T1_new_feed_domains": lambda s, f: fd.new_feed_domains(
            table(s, f, "listed"), table(s, f, "threats")).select("feed", "domain"),
        "T1_new_feed_domains_clustered": t1_clustered,
        "T2_first_feed_wins": t2,
        "T3_provider_self_guard": outcome_query("PROVIDER_SELF"),
        "T4_hosted_content_block": outcome_query("HOSTED_BLOCK"),
        "T5_popular_apex_guard": outcome_query("POPULAR_SKIP"),
        "T6_feed_score_gate": t6, "T7_verify_feed": t7, "T8_sync_summary": t8,
        "M1_upsert": m1, "M1_upsert_caches": m1_caches, "M10_lookup_due_network": m10_network,
        "M2_latest_verdict": lambda s, f: st.latest_verdict(classifications(s, f)),
        "M2_latest_verdict_kept": m2_kept, "M3_touch": m3, "M3_touch_clustered": m3_clustered,
        "M4_expired": lambda s, f: st.expired(times(table(s, f, "threats")), as_of(), EXPIRY),
        "M5_expire_blocks": m5, "M5_expire_store": m5_store, "M6_retain": m6, "M6_retain_store": m6_store, "M7_feed_freshness": m7, "M8_due_jobs": m8,
        "M9_upgrade_schema": m9, "M9_schema_versions": m9_store, "M10_lookup_due": due_apexes,
        "D1_denylist_add": d1, "D2_group_assign": d2, "D2_new_group": d2_new_group, "D3_denylist_remove": d3, "D4_migrate_groups": d4,
        "R1_group_members": r1, "R2_recent_verdicts": r2, "R3_sync_history": r3,
        "R4_blocks_by_origin": lambda s, f: dl.blocks_by_origin(table(s, f, "denylist")),
        "R5_top_ranked": lambda s, f: flat(br.top_ranked(table(s, f, "popular"), 100)),
        "R6_popularity_rank": r6,
    }
