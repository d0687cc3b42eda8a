"""Driver tables as domain inputs.

The driver has no table of domain names. Names are derived from `part`, and DNS
events, feeds, logs and lookup results hang off them. Each input is one SELECT
that means the same on Spark and on DuckDB; `{x}` stands for a driver table or
another input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve import fixed
from domainsieve.functions.literals import literal_table
from domainsieve.operators.brands import BrandIndex, brand_index, brand_map, seed_brands
from domainsieve.operators.names import TailIndex, suffix_index
from domainsieve.sources.text import suffix_rule_rows
from domainsieve.sources.workdir import new_folder

AS_OF = "2024-01-25 12:00:00"
# Order dates end on 2001-08-01; moved so that they end shortly before AS_OF.
SHIFT = "INTERVAL 8210 DAY"

_PARENT = "substr(domain, instr(domain, '.') + 1)"

INPUTS = {
    "hosts": """SELECT p_partkey, p_size, CASE p_partkey % 8
 WHEN 0 THEN replace(p_name,' ','-')||'.xyz'
 WHEN 1 THEN 'www.'||replace(p_name,' ','')||cast(p_size AS varchar(10))||'.com'
 WHEN 2 THEN substr(md5(cast(p_partkey AS varchar(20))),1,12)
  ||translate(substr(md5(cast(p_partkey AS varchar(20))),13,16),
              '0123456789abcdef','ghjklmnpqrstvwxz')||'.ru'
 WHEN 3 THEN replace(p_name,' ','-')||'-login.github.io'
 WHEN 4 THEN translate(replace(p_name,' ','-'),'oel','031')||'.top'
 WHEN 5 THEN 'cdn.'||replace(p_name,' ','-')||'.co.uk'
 WHEN 6 THEN 'xn--'||replace(p_name,' ','')||'-'||cast(p_size AS varchar(10))||'a.info'
 ELSE 'mail.'||replace(p_name,' ','-')||cast(p_partkey AS varchar(20))||'.net'
END AS domain FROM {part}""",

    "names": "SELECT DISTINCT domain FROM {hosts}",

    "dns_events": """SELECT e.event_id, e.ts, e.user_id, e.event_type, e.value, h.domain
 FROM {events} e JOIN {hosts} h ON 1 + e.event_id % (SELECT count(*) FROM {part}) = h.p_partkey""",

    "log_lines": """SELECT event_id, 'Jan '||substr(cast(ts AS varchar(30)),9,2)||' '
 ||substr(cast(ts AS varchar(30)),12,8)||' dnsmasq[1234]: query['
 ||CASE event_id % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' WHEN 2 THEN 'MX' WHEN 3 THEN 'CNAME'
   WHEN 4 THEN 'TXT' WHEN 5 THEN 'HTTPS' WHEN 6 THEN 'SVCB' WHEN 7 THEN 'PTR' ELSE 'A' END||'] '
 ||CASE event_id % 11 WHEN 0 THEN upper(domain) WHEN 1 THEN domain||'.' WHEN 2 THEN 'printer.lan'
   WHEN 3 THEN 'localhost' WHEN 4 THEN 'pi.hole' ELSE domain END
 ||' from 10.0.0.'||cast(user_id AS varchar(10)) AS value FROM {dns_events}""",

    "feed_lines": """SELECT CASE page_id % 7 WHEN 0 THEN '# '||url WHEN 1 THEN ''
 WHEN 2 THEN replace(url, '://', '://user:pw@') WHEN 3 THEN replace(url, '.example.', '.Example.')
 WHEN 4 THEN '  '||replace(url, 'example.com', 'example.com:8080') WHEN 5 THEN 'http://10.1.2.3/x'
 ELSE url END AS value FROM {pages}
 UNION ALL SELECT CASE p_partkey % 5 WHEN 0 THEN '0.0.0.0 '||domain WHEN 1 THEN '127.0.0.1  '||domain
 WHEN 2 THEN domain||'.' WHEN 3 THEN upper(domain) ELSE '10.0.0.'||cast(p_size AS varchar(10)) END
 FROM {hosts}""",

    "json_items": "SELECT url FROM {pages} UNION ALL SELECT domain FROM {hosts}",

    "ranked_lines": """SELECT p_partkey AS line_no, CASE p_partkey % 13 WHEN 0 THEN 'x,'||domain
 WHEN 1 THEN cast(p_partkey AS varchar(20)) ELSE cast(p_partkey * 31 % 2003 AS varchar(20))||','
 ||upper(domain)||'.' END AS value FROM {hosts}""",

    "suffix_lines": """SELECT 100 + n_nationkey AS line_no, CASE n_nationkey % 4
 WHEN 0 THEN lower(n_name) WHEN 1 THEN '*.'||lower(n_name) WHEN 2 THEN '// '||n_name
 ELSE '!city.'||lower(n_name) END AS value FROM {nation}
 UNION ALL SELECT 1000, '// ===BEGIN PRIVATE DOMAINS==='
 UNION ALL SELECT 2000 + p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand||'.'||p_type
 WHEN 1 THEN '*.'||p_brand||'.io' WHEN 2 THEN '!keep.'||p_brand||'.io' ELSE '' END FROM {part}
 UNION ALL SELECT 900000000, '// ===END PRIVATE DOMAINS==='""",

    "asn_lines": """SELECT CASE s_suppkey % 5 WHEN 0 THEN 'no json'
 WHEN 1 THEN '{{"type":"metadata","size":'||cast(s_suppkey AS varchar(20))||'}}'
 WHEN 2 THEN '{{"asn":"'||cast(s_suppkey AS varchar(20))||'"}}'
 ELSE '{{"asn":'||cast(s_suppkey * 7 % 97 AS varchar(20))||',"cc":"RU"}}' END AS value
 FROM {supplier}""",

    "allow_lines": f"""SELECT CASE p_partkey % 32 WHEN 0 THEN '# '||domain WHEN 1 THEN ''
 WHEN 5 THEN '.'||{_PARENT} WHEN 8 THEN upper(domain)||' ' WHEN 15 THEN '.'||{_PARENT}
 WHEN 16 THEN domain WHEN 24 THEN domain ELSE '#' END AS value FROM {{hosts}}""",

    "popular": """SELECT substr(domain, 6) AS domain,
 min(cast((p_partkey - 7) / 8 AS integer)) + 1 AS rank
 FROM {hosts} WHERE p_partkey % 8 = 7 GROUP BY substr(domain, 6)""",

    "threats": """SELECT domain, 'URLhaus' AS feed_name, min(ts) AS added_at, max(ts) AS last_seen
 FROM {dns_events} WHERE event_type = 'error' GROUP BY domain""",

    "seen": """SELECT domain, min(ts) AS first_seen, max(ts) AS last_seen
 FROM {dns_events} WHERE event_type = 'view' GROUP BY domain""",

    "classifications": f"""SELECT event_id AS id,
 CASE WHEN event_id % 2 = 0 THEN domain ELSE {_PARENT} END AS domain,
 CASE event_type WHEN 'error' THEN 'MALWARE' WHEN 'purchase' THEN 'PHISHING'
 WHEN 'click' THEN 'AD' WHEN 'view' THEN 'SAFE' ELSE 'TRACKER' END AS category,
 least(value / 100, 1) AS confidence, event_type AS reason,
 event_type IN ('error', 'purchase') AS blocked, ts AS classified_at FROM {{dns_events}}""",

    "sync_log": f"""SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'URLhaus'
 WHEN 'O' THEN 'OpenPhish' ELSE 'Tranco' END AS feed_name,
 cast(floor(o_totalprice) AS bigint) AS domains_added, o_custkey AS domains_skipped,
 o_orderdate + {SHIFT} AS synced_at FROM {{orders}}""",

    "registrations": f"""SELECT domain, CASE WHEN min(o_orderkey) % 7 = 0 THEN NULL
 ELSE min(o_orderdate) + {SHIFT} END AS created_at, max(o_orderdate) + {SHIFT} AS fetched_at
 FROM (SELECT o_orderkey, o_orderdate, CASE WHEN p_partkey % 8 IN (1, 5, 7) THEN {_PARENT}
 ELSE domain END AS domain FROM {{orders}} JOIN {{hosts}} ON o_orderkey = p_partkey) r
 GROUP BY domain""",

    "domain_asn": """SELECT domain, CASE WHEN min(event_id) % 10 = 0 THEN NULL
 ELSE min(event_id) % (SELECT count(*) FROM {supplier}) END AS asn, max(ts) AS fetched_at
 FROM {dns_events} GROUP BY domain""",

    "bad_asns": "SELECT s_suppkey AS asn FROM {supplier} WHERE s_acctbal < 2000",

    "tls_rows": """SELECT domain, max_by(event_type, event_id) AS event_type,
 max(event_id) AS event_id, max(ts) AS fetched_at FROM {dns_events} GROUP BY domain""",

    "denylist": """SELECT min(p_partkey) + 1 AS id, domain, 1 AS type, 1 AS enabled,
 1700000000 AS date_added, 1700000000 AS date_modified, CASE min(p_partkey) % 4
 WHEN 0 THEN 'AI:PHISHING:0.91' WHEN 1 THEN 'TI:MALWARE:URLhaus'
 WHEN 2 THEN 'ti:PHISHING:OpenPhish' ELSE 'manual' END AS comment
 FROM {hosts} GROUP BY domain HAVING max(p_size) > 25""",

    "mapping": """SELECT id AS domainlist_id, CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS group_id
 FROM {denylist}""",

    "groups": f"""SELECT 0 AS id, 1 AS enabled, 'Default' AS name, 0 AS date_added, 0 AS date_modified,
 'all clients' AS description UNION ALL
 SELECT 5, 1, '{fixed.BLOCK_GROUP}', 0, 0, 'blocked names'""",

    "listed": """SELECT DISTINCT feed, domain FROM (
 SELECT 'URLhaus' AS feed, domain FROM {hosts} WHERE p_partkey % 3 = 0 UNION ALL
 SELECT 'OpenPhish' AS feed, domain FROM {hosts} WHERE p_partkey % 5 < 2 UNION ALL
 SELECT 'OpenPhish' AS feed, 'www.github.io' AS domain UNION ALL
 SELECT 'URLhaus' AS feed, 'github.io' AS domain) f""",

    "replies": """SELECT domain, CASE k % 7
 WHEN 0 THEN '{{"classification": "MALWARE", "confidence": 0.95, "severity": "high", "risk_score": 91, "reasons": ["beacon", "entropy"], "recommended_action": "BLOCK"}}'
 WHEN 1 THEN 'Sure: {{"classification": "phishing", "confidence": "0.85", "reasons": "looks odd"}}'
 WHEN 2 THEN 'I cannot tell.'
 WHEN 3 THEN '{{"category": "SAFE", "confidence": 0.99, "reason": "known service"}}'
 WHEN 4 THEN '{{x}} so {{"classification": "C2", "confidence": 0.7, "risk_score": 12.9, "detail": {{"a": 1}}}}'
 WHEN 5 THEN '[1, 2]'
 ELSE '{{"classification": "C2", "confidence": 0.9, "recommended_action": "ALLOW"}}' END AS reply_text
 FROM (SELECT domain, min(p_partkey) AS k FROM {hosts} GROUP BY domain) r""",
}

_REF = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def references(name: str) -> list[str]:
    return sorted(set(_REF.findall(INPUTS[name])))


# Inputs that the operators expect as stored tables; each is written once per session.
STORED = ("names", "dns_events", "popular", "threats", "seen", "classifications", "sync_log",
          "registrations", "domain_asn", "bad_asns", "tls_rows", "denylist", "mapping", "listed",
          "replies")
_stored: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input."""
    if name not in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in STORED:
        return _derived(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = new_folder(spark, f"input-{name}")
        _derived(spark, sf_dir, name).write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parts = {r: table(spark, sf_dir, r) for r in references(name)}
    text = INPUTS[name] if parts else INPUTS[name].replace("{{", "{").replace("}}", "}")
    return spark.sql(text, **parts)


def with_clause(*wanted: str) -> str:
    """The inputs and all they refer to, as DuckDB common table expressions."""
    order: list[str] = []

    def add(name):
        if name in INPUTS and name not in order:
            for r in references(name):
                add(r)
            order.append(name)

    for name in wanted:
        add(name)
    return ",\n".join(
        f"{n} AS ({_REF.sub(r'\1', INPUTS[n]).replace('{{', '{').replace('}}', '}')})"
        for n in order)


# -- literal side tables ------------------------------------------------------

def rule_rows() -> list[tuple]:
    return [suffix_rule_rows(r, section)
            for section, rules in (("icann", fixed.SAMPLE_ICANN_RULES),
                                   ("private", fixed.SAMPLE_PRIVATE_RULES)) for r in rules]


def hosting_rows() -> list[str]:
    return sorted({r.removeprefix("*.") for r in fixed.SAMPLE_PRIVATE_RULES} | set(fixed.SEED_HOSTING))


def index(spark: SparkSession) -> TailIndex:
    """Suffix index of the sample rules, a literal list of known depth."""
    rules = literal_table(
        spark, rule_rows(),
        "suffix string, section string, is_wildcard boolean, is_exception boolean")
    hosting = literal_table(spark, [(h,) for h in hosting_rows()], "suffix string")
    depth = max(len(s.split(".")) for s in [r[0] for r in rule_rows()] + hosting_rows())
    return suffix_index(rules, hosting, depth=depth)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_map(table(spark, sf_dir, "popular"), index(spark), seed_brands(spark))


def brands_index(spark: SparkSession, sf_dir: str) -> BrandIndex:
    return brand_index(brands(spark, sf_dir))


def as_of():
    return F.lit(AS_OF).cast("timestamp")
