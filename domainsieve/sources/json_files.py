"""JSON sources: JSON feeds, ASN lists, registration documents, origin records, certificates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.functions.names import clean_name, strip, url_host
from domainsieve.sources.json_arrays import read_elements


# -- JSON feed ----------------------------------------------------------------

def parse_json_feed(items: DataFrame, field: str = "url") -> DataFrame:
    """Distinct hosts of the URLs in column `field`."""
    return (items.select(url_host(strip(F.col(field))).alias("domain"))
            .filter(F.col("domain").isNotNull()).distinct())


def read_json_feed(spark: SparkSession, path: str, field: str = "url") -> DataFrame:
    """Hosts of a JSON feed: files that each hold one array of objects.

    An array of any size is read by several tasks. Files that are not one array are left out, and
    elements that are not objects have no host.
    """
    value = F.get_json_object("element", f"$['{field}']")
    return parse_json_feed(read_elements(spark, path).select(value.alias(field)), field)


# -- ASN list -----------------------------------------------------------------

def parse_asn_list(lines: DataFrame) -> DataFrame:
    """Distinct integer `asn` of JSON lines; all other lines are skipped."""
    raw = F.get_json_object(strip(F.col("value")), "$.asn")
    # A quoted number is not an integer, and reads the same once extracted.
    quoted = F.col("value").rlike(r'"asn"\s*:\s*"')
    valid = F.try_parse_json(strip(F.col("value"))).isNotNull()
    return (lines.filter(valid & ~quoted & raw.rlike(r"^-?\d+$"))
            .select(raw.try_cast("long").alias("asn")).filter("asn IS NOT NULL").distinct())


def read_asn_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_asn_list(spark.read.text(path))


# -- registration documents ---------------------------------------------------

REGISTRATION_SCHEMA = """domain string, fetched_at timestamp,
 events array<struct<eventAction: string, eventDate: string>>"""


def iso_time(c):
    """ISO text as a timestamp, UTC when it names no zone; null when it is no time."""
    zoned = c.rlike(r"(?i)(z|utc|gmt|[+-]\d{1,2}(:?\d{2})?)\s*$") & c.contains(":")
    dated = F.when(c.contains(":"), F.concat(c, F.lit("Z"))).otherwise(F.concat(c, F.lit("T00:00:00Z")))
    return F.when(zoned, c).otherwise(dated).try_cast("timestamp")


def parse_registrations(docs: DataFrame) -> DataFrame:
    """(domain, created_at, fetched_at): the first registration event with a date."""
    dated = F.filter("events", lambda e: (e.eventAction == "registration") & (e.eventDate != ""))
    return docs.select("domain", iso_time(F.get(dated, 0)["eventDate"]).alias("created_at"),
                       "fetched_at")


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines, one document per apex with `domain` and `fetched_at` added."""
    return parse_registrations(spark.read.schema(REGISTRATION_SCHEMA).json(path))


# -- origin ASN ---------------------------------------------------------------

def parse_origin_asn(records: DataFrame) -> DataFrame:
    """(ip, asn) of rows (ip, txt, record_no): the first record of an IP with a usable ASN."""
    field = strip(F.substring_index(F.btrim(strip(F.col("txt")), F.lit('"')), "|", 1))
    token = F.regexp_extract(field, r"^(\S+)", 1)
    asn = F.when(token.rlike(r"^\d+$"), token.try_cast("long"))
    return (records.select("ip", "record_no", asn.alias("asn")).filter("asn IS NOT NULL")
            .groupBy("ip").agg(F.min_by("asn", "record_no").alias("asn")))


def read_origin_asn(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines {ip, txt, record_no}."""
    return parse_origin_asn(spark.read.schema("ip string, txt string, record_no long").json(path))


def domain_asn(addresses: DataFrame, origins: DataFrame) -> DataFrame:
    """(domain, asn, fetched_at) from (domain, ip, fetched_at); asn is null when unknown.

    An IP may serve very many names, so the join goes by the looked-up table.
    """
    from domainsieve.operators.lookup import lookup_join
    return lookup_join(addresses, origins, "ip", "ip", [F.col("asn")]).select(
        "domain", "asn", "fetched_at")


# -- certificates -------------------------------------------------------------

CERTIFICATE_SCHEMA = """domain string, fetched_at timestamp, error string, cert struct<
 issuer: array<array<array<string>>>, notBefore: string, subjectAltName: array<array<string>>>,
 reachable boolean"""


def parse_certificates(rows: DataFrame) -> DataFrame:
    """(domain, info, fetched_at). A failed check is a signal; an unreachable host has null info."""
    pairs = F.flatten("cert.issuer")
    named = F.filter(pairs, lambda kv: F.get(kv, 0) == "organizationName")
    # The zone is always GMT; read as an offset, the session zone does not matter.
    not_before = F.try_to_timestamp(
        F.concat(F.regexp_replace(F.regexp_replace("cert.notBefore", r"\s+", " "), r" GMT$", ""), F.lit(" +0000")),
        F.lit("MMM d HH:mm:ss yyyy Z"))
    failed = F.col("error").isNotNull()

    def info(issuer, sans, bad, reason, since):
        return F.struct(issuer.alias("issuer"), sans.cast("int").alias("san_count"),
                        F.lit(bad).alias("verify_failed"), reason.alias("fail_reason"),
                        since.alias("not_before"))

    none = F.lit(None)
    good = info(F.get(F.element_at(F.when(F.size(named) > 0, named), -1), 1),
                F.coalesce(F.size("cert.subjectAltName"), F.lit(0)), False,
                none.cast("string"), not_before)
    bad = info(none.cast("string"), F.lit(0), True, F.col("error"), none.cast("timestamp"))
    return rows.select("domain", F.when(failed, bad).when(F.col("cert").isNotNull(), good)
                       .alias("info"), "fetched_at")


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON lines: a certificate in `cert`, a failed check in `error`, or neither."""
    return parse_certificates(spark.read.schema(CERTIFICATE_SCHEMA).json(path))


# -- work list for registration lookups ---------------------------------------

BOOTSTRAP_SCHEMA = "services array<array<array<string>>>"


def parse_bootstrap(docs: DataFrame) -> DataFrame:
    """(tld, base_url) of a registry document: https preferred, last service wins a TLD."""
    s = docs.select(F.posexplode("services").alias("pos", "service"))
    urls = F.get("service", 1)
    secure = F.filter(urls, lambda u: u.startswith("https://"))
    base = F.coalesce(F.get(secure, 0), F.get(urls, 0))
    s = s.select("pos", base.alias("base"), F.explode(F.get("service", 0)).alias("tld"))
    return (s.filter("base <> ''").groupBy(F.lower("tld").alias("tld"))
            .agg(F.rtrim(F.max_by("base", "pos"), F.lit("/")).alias("base_url")))


def lookup_requests(due: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """(apex, url) for the apexes still to be looked up; a TLD without registry has null url.

    `due` is the result of lookup_due on distinct apexes.
    """
    from domainsieve.operators.lookup import lookup_join
    d = due.select(clean_name(F.col("domain")).alias("apex"))
    d = d.withColumn("tld", F.substring_index("apex", ".", -1))
    d = lookup_join(d, bootstrap, "tld", "tld", [F.col("base_url")], spread="apex")
    return d.select("apex", "tld", F.concat("base_url", F.lit("/domain/"), "apex").alias("url"))
