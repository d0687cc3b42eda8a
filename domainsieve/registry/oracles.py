"""SQL that gives the results of the registered queries on DuckDB.

Written from the meaning of each operator, not from its Spark form: names are cut
into tails and joined with rules, brands are compared with every candidate, and
histories are replayed recursively.
"""

from __future__ import annotations

from domainsieve import fixed
from domainsieve.registry.inputs import AS_OF, hosting_rows, rule_rows, with_clause

NOW = f"TIMESTAMP '{AS_OF}'"
_DAY = 86_400_000_000
_ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"


def q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def values(rows) -> str:
    def lit(v):
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else q(v)
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def select(needs, ctes: str, body: str) -> str:
    parts = [p for p in (with_clause(*needs), ctes) if p]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body


RULES = f"""rules(base, section, wild, exc) AS ({values(rule_rows())}),
hosting(suffix) AS ({values([(h,) for h in hosting_rows()])})"""


def keys(src: str, p: str = "") -> str:
    """apex, private_apex, host_label, icann_label, provider of the names in CTE `src`."""
    def tail(k):
        return f"array_to_string(list_slice(labels, n - {k} + 1, n), '.')"
    def label(s):
        return f"""CASE WHEN {s} = 0 AND regexp_full_match(domain, '[0-9]+(\\.[0-9]+){{3}}') THEN domain
   WHEN {s} = 0 THEN labels[n] WHEN {s} >= n THEN string_split(apex, '.')[1] ELSE labels[n - {s}] END"""
    return f"""{p}cut AS (SELECT domain, string_split(domain, '.') AS labels,
  len(string_split(domain, '.')) AS n FROM {src}),
{p}tails AS (SELECT domain, n, k, {tail('k')} AS tail
  FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM {p}cut)),
{p}hit AS (SELECT t.domain,
  max(CASE WHEN section = 'icann' AND NOT wild AND NOT exc THEN k
           WHEN section = 'icann' AND wild AND n > k THEN k + 1 END) AS li,
  max(CASE WHEN section = 'icann' AND exc THEN k - 1 END) AS xi,
  max(CASE WHEN NOT wild AND NOT exc THEN k WHEN wild AND n > k THEN k + 1 END) AS lp,
  max(CASE WHEN exc THEN k - 1 END) AS xp
  FROM {p}tails t JOIN rules r ON t.tail = r.base GROUP BY t.domain),
{p}prov AS (SELECT domain, max_by(tail, k) AS provider FROM {p}tails JOIN hosting ON tail = suffix
  GROUP BY domain),
{p}suf AS (SELECT c.domain, c.labels, c.n, coalesce(xi, li, 0) AS si, coalesce(xp, lp, 0) AS sp, provider
  FROM {p}cut c LEFT JOIN {p}hit h USING (domain) LEFT JOIN {p}prov v USING (domain)),
{p}apexes AS (SELECT *, CASE WHEN si > 0 AND si < n THEN {tail('(si + 1)')}
  ELSE {tail('least(n, 2)')} END AS apex FROM {p}suf),
{p}keys AS (SELECT domain, apex, CASE WHEN sp > 0 AND sp < n THEN {tail('(sp + 1)')} ELSE apex END
  AS private_apex, {label('sp')} AS host_label, {label('si')} AS icann_label, provider FROM {p}apexes)"""


def count_of(chars: str, c: str = "domain") -> str:
    return f"(length({c}) - length(translate({c}, {q(chars)}, '')))"


HINTS = " + ".join(f"contains(domain, {q(w)})::INT" for w in fixed.HINT_WORDS)
RUNS = "|".join(f"{c}{{3,}}" for c in [*_ALNUM, "-", r"\."])

# Repeated sequences as a left-to-right scan: at each place the longest run that is
# followed by itself is taken, and the scan goes on behind both.
REPEATS = f"""spots AS (SELECT domain, i, max(w) AS w FROM (
   SELECT domain, i, unnest(generate_series(2, greatest((length(domain) - i + 1) // 2, 1))) AS w
   FROM (SELECT domain, unnest(generate_series(1, length(domain))) AS i FROM keys))
  WHERE substr(domain, i, w) = substr(domain, i + w, w) AND length(substr(domain, i + w, w)) = w
   AND regexp_full_match(substr(domain, i, w), '[a-z0-9]+') GROUP BY domain, i),
scan(domain, i, hits) AS (SELECT domain, 1, 0 FROM keys UNION ALL
  SELECT s.domain, CASE WHEN w IS NULL THEN s.i + 1 ELSE s.i + 2 * w END::INT,
   s.hits + (w IS NOT NULL)::INT
  FROM scan s LEFT JOIN spots p ON p.domain = s.domain AND p.i = s.i WHERE s.i <= length(s.domain)),
rep AS (SELECT domain, max(hits) AS repeated_sequences FROM scan GROUP BY domain)"""

ENTROPY = """chars AS (SELECT host_label, ch, count(*) AS c FROM (
   SELECT host_label, unnest(string_split(host_label, '')) AS ch
   FROM (SELECT DISTINCT host_label FROM keys)) WHERE ch <> '' GROUP BY ALL),
ent AS (SELECT host_label, sum(-(c / length(host_label)::DOUBLE) * log2(c / length(host_label)::DOUBLE))
   AS bits, count(*) AS kinds FROM chars GROUP BY host_label)"""

FEATURES = f"""{REPEATS},
{ENTROPY},
lex AS (SELECT k.*, length(domain) AS len, length(host_label) AS hlen,
  string_split(domain, '.')[1] AS first_label, string_split(domain, '.')[-1] AS tld,
  list_filter(string_split(domain, '.'), lambda x: x <> '') AS parts,
  {count_of('aeiou')} AS vowels, len(regexp_extract_all(domain, '\\p{{L}}')) AS letters,
  {count_of('0123456789')} AS ndigits, len(regexp_extract_all(domain, '[^\\p{{L}}\\p{{N}}.]')) AS specials,
  len(regexp_extract_all(domain, {q(RUNS)})) AS repeated_characters, repeated_sequences,
  {HINTS} AS words, CASE WHEN length(host_label) > 1 THEN bits ELSE 0 END AS shannon, kinds,
  {count_of('-')} AS nhyphens, (starts_with(domain, 'xn--') OR contains(domain, '.xn--')) AS is_punycode
  FROM keys k JOIN rep USING (domain) LEFT JOIN ent USING (host_label)),
feat AS (SELECT *, tld IN ({', '.join(q(t) for t in fixed.RISKY_TLDS)}) AS risky,
  CASE WHEN letters > 0 THEN vowels::DOUBLE / letters ELSE 0 END AS vowel_ratio,
  ndigits::DOUBLE / len AS digit_ratio,
  least(CASE WHEN shannon >= 3.8 THEN 0.35::DOUBLE ELSE 0 END
   + CASE WHEN letters > 0 AND vowels::DOUBLE / letters < 0.25 AND hlen >= 10
          OR letters = 0 AND hlen >= 10 THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN ndigits::DOUBLE / len > 0.25 THEN 0.15::DOUBLE ELSE 0 END
   + CASE WHEN words = 0 AND hlen >= 12 THEN 0.2::DOUBLE ELSE 0 END
   + CASE WHEN repeated_characters > 0 OR repeated_sequences > 0 THEN 0.1::DOUBLE ELSE 0 END, 1) AS dga_score
  FROM lex)"""

BRAND_LABEL = ("array_to_string(list_transform(regexp_extract_all(brand, '[a-z]+|[^a-z]+'), "
               "lambda x: upper(x[1]) || x[2:]), '')")

BRANDS = f"""toplist AS (SELECT domain, rank FROM popular WHERE rank <= 1000),
{keys('toplist', 'b_')},
ranked AS (SELECT host_label AS brand, min_by(domain, (rank, domain)) AS apex, min(rank) AS rank
  FROM b_keys JOIN toplist USING (domain) WHERE length(host_label) >= 5 GROUP BY host_label),
seed(brand, apex, position) AS ({values([(b, a, i) for i, (b, a) in enumerate(fixed.SEED_BRANDS)])}),
brands AS (SELECT brand, official_apex, brand_order, {BRAND_LABEL} AS brand_label FROM (
  SELECT brand, coalesce(s.apex, r.apex) AS official_apex,
   coalesce(r.rank, s.position + 1001) AS brand_order FROM ranked r FULL JOIN seed s USING (brand)))"""

_LEET = f"translate(%s, {q(fixed.LEET_FROM)}, {q(fixed.LEET_TO)})"

CANDIDATES = f"""hostlabels AS (SELECT domain, 0 AS which, host_label AS label FROM keys UNION ALL
  SELECT domain, 1, icann_label FROM keys WHERE icann_label <> host_label),
bases AS (SELECT *, replace(label, '-', '') AS base FROM hostlabels),
pieces AS (SELECT domain, which, base, i, string_split(label, '-')[i] AS part FROM (
  SELECT *, unnest(generate_series(1, len(string_split(label, '-')))) AS i FROM bases)),
allcand AS (
  SELECT domain, which, 0 AS i, 0 AS l, base AS candidate, false AS via_leet, false AS via_part FROM bases
  UNION ALL SELECT domain, which, 0, 1, {_LEET % 'base'}, true, false FROM bases WHERE {_LEET % 'base'} <> base
  UNION ALL SELECT domain, which, i, 0, part, false, true FROM pieces WHERE part <> '' AND part <> base
  UNION ALL SELECT domain, which, i, 1, {_LEET % 'part'}, true, true FROM pieces
   WHERE part <> '' AND part <> base AND {_LEET % 'part'} <> part),
cands AS (SELECT domain, candidate, via_leet, via_part,
  row_number() OVER (PARTITION BY domain ORDER BY which, i, l) - 1 AS candidate_order FROM allcand)"""

MATCHES = """official AS (SELECT domain, min_by(b, (b.brand_order, b.brand)) AS b
  FROM keys JOIN brands b ON apex = official_apex GROUP BY domain),
pairs AS (SELECT c.*, b.brand, b.brand_label, b.brand_order,
  contains(candidate, brand) AND candidate <> brand AS inside,
  greatest(length(candidate), length(brand)) AS longer, levenshtein(candidate, brand) AS dist
  FROM cands c, brands b WHERE c.domain NOT IN (SELECT domain FROM official)),
graded AS (SELECT *, CASE WHEN inside THEN greatest(1 - dist::DOUBLE / longer, 0.85::DOUBLE)
   ELSE 1 - dist::DOUBLE / longer END AS conf FROM pairs),
best AS (SELECT domain, min_by(g, (-conf, brand_order, brand, candidate_order)) AS g FROM graded g
  WHERE conf >= 0.80::DOUBLE GROUP BY domain),
lookalikes AS (SELECT domain, g.brand AS brand, g.brand_label AS brand_label, g.conf AS confidence,
  g.dist AS edit_distance, CASE WHEN g.via_leet THEN 'leet' WHEN g.via_part THEN 'embedded'
   WHEN g.dist = 0 THEN 'exact' WHEN g.inside THEN 'contains' ELSE 'fuzzy' END AS match_type FROM best),
bm AS (SELECT k.domain, coalesce(o.b.brand, s.brand) AS brand,
  coalesce(o.b.brand_label, s.brand_label) AS brand_label,
  CASE WHEN o.domain IS NOT NULL THEN 1 ELSE coalesce(s.confidence, 0) END::DOUBLE AS brand_confidence,
  CASE WHEN o.domain IS NOT NULL THEN 0 ELSE s.edit_distance END AS edit_distance,
  CASE WHEN o.domain IS NOT NULL THEN 'official' ELSE s.match_type END AS match_type
  FROM keys k LEFT JOIN official o USING (domain) LEFT JOIN lookalikes s USING (domain))"""

NAMES = f"{RULES},\n{keys('names')}"
ALL_FEATURES = f"{NAMES},\n{FEATURES},\n{BRANDS},\n{CANDIDATES},\n{MATCHES}"


def signals(feed="false", provider="NULL", asn="NULL", flagged="false", failed="false",
            reason="NULL", cert_age="NULL", age="NULL") -> list[tuple[str, int, str]]:
    return [
        (feed, 100, "'URLhaus threat intelligence hit'"),
        ("dga_score >= 0.70::DOUBLE", 30, "'High DGA score'"),
        ("match_type IS NOT NULL AND match_type <> 'official'", 25, "'Brand similarity to ' || brand_label"),
        ("shannon >= 3.8", 20, "'High entropy'"),
        ("risky", 10, "'Suspicious TLD'"),
        ("digit_ratio > 0.20::DOUBLE", 5, "'Excess digits'"),
        ("nhyphens >= 2", 5, "'Excess hyphens'"),
        ("is_punycode", 35, "'Punycode domain'"),
        (flagged, 60, f"'Hosted in Spamhaus DROP-listed network (AS' || {asn} || ')'"),
        (failed, 20, f"'TLS certificate failed verification (' || {reason} || ')'"),
        (f"NOT {failed} AND {cert_age} <= 14", 10, f"'TLS certificate issued ' || {cert_age} || ' days ago'"),
        (f"{provider} IS NOT NULL", 10, f"'User content on shared-hosting provider ' || {provider}"),
        (f"{age} <= 30", 25, f"'Newly registered domain (' || {age} || ' days old)'"),
        (f"{age} > 30 AND {age} <= 180", 10, f"'Recently registered domain (' || {age} || ' days old)'"),
    ]


def score(s) -> str:
    return "(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, w, _ in s) + ")"


def reasons(s) -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {t} END" for c, _, t in s)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), '|')"


def severity(x: str) -> str:
    return f"CASE WHEN {x} >= 80 THEN 'HIGH' WHEN {x} >= 50 THEN 'MEDIUM' WHEN {x} >= 20 THEN 'LOW' ELSE 'INFO' END"


def days(since: str, later: int = 0) -> str:
    return f"((epoch_us({NOW}) + {later} * {_DAY} - epoch_us({since})) // {_DAY})"


def ago(n) -> str:
    return f"({NOW} - INTERVAL {n} DAY)"


LATEST = """latest AS (SELECT domain, v.category AS category, v.confidence AS confidence, v.blocked AS blocked
  FROM (SELECT domain, max_by(c, (classified_at, id)) AS v FROM classifications c GROUP BY domain))"""

POLICY = f"""allow AS (SELECT DISTINCT lower(trim(value)) AS entry FROM allow_lines
  WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')),
never(entry) AS ({values([(n,) for n in fixed.NEVER_BLOCK_NAMES])}),
upstream(entry) AS ({values([(n,) for n in (*fixed.SERVICE_HOSTS, 'urlhaus.abuse.ch', 'openphish.com')])}),
ends(entry) AS ({values([(n,) for n in fixed.NEVER_BLOCK_SUFFIXES])}),
suffixes AS (SELECT entry FROM allow WHERE starts_with(entry, '.') UNION SELECT entry FROM ends)"""


def not_blockable(d: str, upstream: bool) -> str:
    more = " UNION SELECT entry FROM upstream" if upstream else ""
    return f"""{d}.domain NOT IN (SELECT entry FROM allow UNION SELECT entry FROM never{more})
  AND NOT EXISTS (SELECT 1 FROM suffixes s WHERE ends_with({d}.domain, s.entry))"""


HISTORY = """admitted(domain, ts) AS (
  SELECT domain, min(ts) FROM dns_events GROUP BY domain UNION ALL
  SELECT domain, ts FROM (SELECT a.domain, min(e.ts) AS ts FROM admitted a JOIN dns_events e
   ON e.domain = a.domain AND e.ts > a.ts + INTERVAL 7 DAY GROUP BY a.domain, a.ts))"""

_EXACT_IP = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"

TLS_SIGNALS = signals(provider="outside", asn="asn", flagged="asn_flagged", age="age", failed="tls_failed",
                      reason="'self-signed certificate'", cert_age="tls_age")

DECIDED = f"""{ALL_FEATURES},
{LATEST},
first_rules AS (SELECT f.*, m.* EXCLUDE (domain), CASE WHEN f.provider <> f.domain THEN f.provider END AS outside,
  p.rank AS rank, f.private_apex <> f.domain AND coalesce(l.blocked, false) AS apex_blocked
  FROM feat f JOIN bm m USING (domain) LEFT JOIN popular p ON p.domain = f.apex
  LEFT JOIN latest l ON l.domain = f.private_apex),
scored1 AS (SELECT *, {score(signals(provider='outside'))} AS score1 FROM first_rules),
routed AS (SELECT *, CASE WHEN apex_blocked THEN 'SUBDOMAIN_BLOCK'
  WHEN rank IS NOT NULL AND outside IS NULL AND domain NOT IN (SELECT domain FROM threats)
   AND apex NOT IN (SELECT domain FROM threats) THEN 'POPULAR'
  WHEN score1 < 15 THEN 'PREFILTER' ELSE 'SCORE' END AS route FROM scored1),
looked AS (SELECT r.*, CASE WHEN route = 'SCORE' AND outside IS NULL AND g.created_at IS NOT NULL
   THEN greatest({days('g.created_at')}, 0) END AS age,
  CASE WHEN route = 'SCORE' AND {days('a.fetched_at')} < 7 THEN a.asn END AS asn
  FROM routed r LEFT JOIN registrations g ON g.domain = r.apex
  LEFT JOIN domain_asn a ON a.domain = r.domain),
flagged AS (SELECT *, coalesce(asn IN (SELECT asn FROM bad_asns), false) AS asn_flagged FROM looked),
decided AS (SELECT *, {score(signals(provider='outside', asn='asn', flagged='asn_flagged', age='age'))} AS raw,
  {reasons(signals(provider='outside', asn='asn', flagged='asn_flagged', age='age'))} AS why FROM flagged)"""

# The same with certificates: a fresh record of a reachable host, for names of route SCORE.
DECIDED_TLS = DECIDED.split("flagged AS (")[0] + f"""certs AS (SELECT domain, event_type = 'error' AS tls_bad,
  CASE WHEN event_type <> 'error' THEN greatest({days("date_trunc('second', fetched_at)")}, 0) END AS tls_age
  FROM tls_rows WHERE event_type <> 'signup' AND {days('fetched_at')} < 7),
flagged AS (SELECT l.*, coalesce(asn IN (SELECT asn FROM bad_asns), false) AS asn_flagged,
  route = 'SCORE' AND coalesce(tls_bad, false) AS tls_failed, CASE WHEN route = 'SCORE' THEN tls_age END AS tls_age
  FROM looked l LEFT JOIN certs c USING (domain)),
decided AS (SELECT *, {score(TLS_SIGNALS)} AS raw, {reasons(TLS_SIGNALS)} AS why FROM flagged)"""
DECIDED_NEEDS = ("names", "popular", "threats", "classifications", "registrations", "domain_asn",
                 "bad_asns")

VERIFIED = f"""{RULES},
fresh AS (SELECT domain, min_by(l.feed, o) AS feed FROM listed l
  JOIN (VALUES ('URLhaus', 0), ('OpenPhish', 1)) f(feed, o) USING (feed)
  WHERE domain NOT IN (SELECT domain FROM threats) GROUP BY domain),
{keys('fresh')},
{FEATURES},
{BRANDS},
{CANDIDATES},
{MATCHES},
graded_names AS (SELECT f.*, m.* EXCLUDE (domain), n.feed, p.rank,
  CASE n.feed WHEN 'URLhaus' THEN 'MALWARE' ELSE 'PHISHING' END AS category
  FROM feat f JOIN bm m USING (domain) JOIN fresh n USING (domain)
  LEFT JOIN popular p ON p.domain = f.apex),
with_score AS (SELECT *, least({score(signals(feed="feed = 'URLhaus'"))}, 100) AS points FROM graded_names),
outcomes AS (SELECT *, CASE WHEN domain = provider OR domain = 'www.' || provider THEN 'PROVIDER_SELF'
  WHEN provider IS NOT NULL THEN 'HOSTED_BLOCK' WHEN rank IS NOT NULL THEN 'POPULAR_SKIP'
  WHEN feed = 'URLhaus' OR points >= 70 THEN 'SCORE_BLOCK' ELSE 'SCORE_SKIP' END AS outcome FROM with_score),
verified AS (SELECT *, outcome IN ('HOSTED_BLOCK', 'SCORE_BLOCK') AS blocked,
  CASE WHEN outcome = 'HOSTED_BLOCK' THEN 1 WHEN outcome IN ('PROVIDER_SELF', 'POPULAR_SKIP') THEN 0
   WHEN feed = 'URLhaus' THEN 1 ELSE points / 100::DOUBLE END::DOUBLE AS confidence,
  CASE outcome WHEN 'PROVIDER_SELF' THEN 'Feed ' || feed || ' hit, but ' || domain
    || ' is the shared-hosting provider itself — not blocked'
   WHEN 'HOSTED_BLOCK' THEN 'Feed ' || feed || ' hit on shared-hosting provider ' || provider
    || ' — blocked full hostname'
   WHEN 'POPULAR_SKIP' THEN 'Feed ' || feed || ' hit, but apex ' || apex || ' popular (rank=' || rank
    || ') — not blocked'
   ELSE 'Feed ' || feed || ' rule-based: score=' || points || ' urlhaus='
    || CASE WHEN feed = 'URLhaus' THEN 'True' ELSE 'False' END END AS reason FROM outcomes)"""
VERIFIED_NEEDS = ("listed", "threats", "popular")

NEW_ROWS = f"""{POLICY},
proposed AS (SELECT domain, 'TI:' || min(feed) AS comment FROM listed GROUP BY domain),
wanted AS (SELECT * FROM proposed p WHERE {not_blockable('p', False)}
  AND domain NOT IN (SELECT domain FROM denylist)),
added AS (SELECT (SELECT max(id) FROM denylist)
  + row_number() OVER (ORDER BY substr(md5(domain), 1, 3), domain) AS id, domain, comment FROM wanted)"""

LATEST_TIMES = "latest_times AS (SELECT domain, max(classified_at) AS newest FROM classifications GROUP BY domain)"

GONE = """gone AS (SELECT d.id, d.domain FROM denylist d JOIN threats t ON t.domain = d.domain
  WHERE d.type = 1 AND d.comment ILIKE 'TI:%' AND t.last_seen < TIMESTAMP '{now}' - INTERVAL 10 DAY)
""".format(now=AS_OF)

# Every brace pair that encloses a valid object; the one that begins first counts.
REPLIES = f"""texts AS (SELECT domain, trim(reply_text) AS t FROM replies),
opens AS (SELECT domain, t, i FROM (SELECT domain, t, unnest(generate_series(1, length(t))) AS i FROM texts)
  WHERE t[i] = '{{'),
closes AS (SELECT domain, j FROM (SELECT domain, t, unnest(generate_series(1, length(t))) AS j FROM texts)
  WHERE t[j] = '}}'),
objects AS (SELECT o.domain, min_by(substr(t, i, j - i + 1), (i, j)) AS obj FROM opens o
  JOIN closes c ON c.domain = o.domain AND j > i
  WHERE json_valid(substr(t, i, j - i + 1)) GROUP BY o.domain),
read AS (SELECT domain, CASE WHEN json_valid(t) AND json_type(CASE WHEN json_valid(t) THEN t END) <> 'OBJECT'
   THEN NULL ELSE obj END AS obj FROM texts LEFT JOIN objects USING (domain)),
listed_reasons AS (SELECT domain, obj, CASE json_type(obj, '$.reasons') WHEN 'ARRAY'
   THEN (obj::JSON->>'$.reasons[*]')::VARCHAR[] WHEN 'VARCHAR' THEN [obj::JSON->>'$.reasons'] ELSE []::VARCHAR[] END
   AS rs FROM read),
parsed AS (SELECT domain, 
  CASE WHEN obj IS NULL THEN 'UNKNOWN' ELSE upper(coalesce(obj::JSON->>'$.classification',
   obj::JSON->>'$.category', 'UNKNOWN')) END AS category,
  coalesce(TRY_CAST(obj::JSON->>'$.confidence' AS DOUBLE), 0) AS confidence,
  CASE WHEN obj IS NULL THEN 'Could not parse model response'
   ELSE coalesce(obj::JSON->>'$.reason', array_to_string(rs, '; ')) END AS reason,
  CASE WHEN obj IS NULL THEN 'INFO' ELSE upper(coalesce(obj::JSON->>'$.severity', severity)) END AS severity,
  CASE WHEN obj IS NULL THEN 0 ELSE coalesce(trunc(TRY_CAST(obj::JSON->>'$.risk_score' AS DOUBLE))::BIGINT,
   rule_score) END AS risk_score,
  array_to_string(rs, '|') AS reasons, coalesce(upper(obj::JSON->>'$.recommended_action'), '') AS action,
  rule_score FROM listed_reasons JOIN plain USING (domain))"""
PLAIN = f"""{NAMES},
plain AS (SELECT domain, (length(domain) * 7) % 40 AS rule_score, 'LOW' AS severity FROM keys)"""
BLOCKS = "category IN ('MALWARE', 'PHISHING', 'C2', 'RANSOMWARE')"
ACTION = f"CASE WHEN action <> '' THEN action = 'BLOCK' ELSE {BLOCKS} END"


def json_text(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'null' ELSE '"' || {x} || '"' END"""


def json_two(x: str) -> str:
    return f"(floor({x} * 100 + 0.5) / 100::DOUBLE)::VARCHAR"


def json_plain(x: str) -> str:
    return f"coalesce({x}::VARCHAR, 'null')"


EVIDENCE = " || ',' || ".join(f"""'"{name}":' || {value}""" for name, value in (
    ("domain", json_text("domain")), ("rule_score", json_plain("least(raw, 100)")),
    ("severity", f"""'"' || {severity('raw')} || '"'"""),
    ("rule_reasons", """CASE WHEN why = '' THEN '[]' ELSE '["' || replace(why, '|', '","') || '"]' END"""),
    ("entropy_shannon", json_two("shannon")), ("dga_score", json_two("dga_score")), ("tld", json_text("tld")),
    ("suspicious_tld", json_plain("risky")), ("label_count", json_plain("len(parts)")),
    ("length", json_plain("len")), ("digit_ratio", json_two("digit_ratio")),
    ("brand_match", json_text("brand_label")), ("brand_confidence", json_two("brand_confidence")),
    ("brand_match_type", json_text("match_type")), ("is_punycode", json_plain("is_punycode")),
    ("domain_age_days", json_plain("age")), ("shared_hosting_provider", json_text("outside")),
    ("asn", json_plain("asn")), ("asn_flagged", json_plain("asn_flagged")),
    ("tls_issuer", "'null'"), ("tls_cert_age_days", "'null'"), ("tls_verify_failed", "'null'"),
    ("tls_san_count", "'null'"), ("threat_intel", "'{}'")))
EVIDENCE = f"'{{' || {EVIDENCE} || '}}'"

# The whole prompt; #S and #E stand for the score and the evidence.
PROMPT = """Rate a DNS name. Return one JSON object, no other text: {"classification": <MALWARE | PHISHING | C2 | RANSOMWARE | AD | TRACKER | SAFE>, "confidence": <0.0-1.0>, "reasons": <list of short texts>, "recommended_action": <BLOCK for the first four classes, else ALLOW>, "risk_score": <0-100>, "severity": <INFO | LOW | MEDIUM | HIGH>}
Fields, null where unknown:
  asn = number of the hosting network; no range
  asn_flagged = true when that network is on the bad-network list: weighs most of all
  brand_confidence = 0 to 1, closeness to brand_match
  brand_match = nearest well-known brand
  brand_match_type = official (owned by the brand, hence SAFE), exact, leet, embedded, contains or fuzzy; the middle three imitate, contains and fuzzy need another sign beside them
  dga_score = 0 to 1, how machine-made the text looks; C2 when entropy_shannon is high too
  digit_ratio = 0 to 1, share of digits
  domain = the name itself
  domain_age_days = days since registration; under 30 counts much, under 180 a little
  entropy_shannon = bits per character of the host label, above 3.8 is high
  is_punycode = true for an encoded international name
  label_count = labels between dots
  length = characters
  rule_reasons = signals behind rule_score
  rule_score = 0 to 100, the measured risk; a start for risk_score
  severity = INFO, LOW, MEDIUM or HIGH, from rule_score
  shared_hosting_provider = platform whose users publish such names; its own standing proves nothing
  suspicious_tld = true for a top-level domain with raised risk
  threat_intel = feed that lists the name; a listing settles the matter
  tld = top-level domain
  tls_cert_age_days = days since the certificate began; under 14 counts a little
  tls_issuer = who issued the certificate
  tls_san_count = names on the certificate
  tls_verify_failed = true when the certificate is not valid
Measured rule_score: #S
JSON: #E"""


def feature_query(columns: str) -> str:
    return select(("names",), f"{NAMES},\n{FEATURES}", f"SELECT domain, {columns} FROM feat")


def key_query(columns: str) -> str:
    return select(("names",), NAMES, f"SELECT domain, {columns} FROM keys")


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    host_re = "'^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*@)?([^/?#:@]*)'"

    # sources
    def log(group):
        return ("regexp_extract(value, 'query\\[(A|AAAA|MX|CNAME|TXT|HTTPS|SVCB)\\]\\s+(\\S+)\\s+from"
                f"\\s+(\\S+)', {group})")

    sql["S1_read_query_log"] = select(("log_lines",), f"""p AS (
  SELECT rtrim(lower({log(2)}), '.') AS domain, substr(value, 1, 15) AS time_text,
   {log(3)} AS client FROM log_lines WHERE {log(1)} <> '')""",
        """SELECT domain, time_text, client FROM p WHERE contains(domain, '.') AND domain NOT IN ('pi.hole', 'localhost')
 AND NOT regexp_matches(domain, '\\.(local|lan|arpa|internal)$')""")
    sql["S2_read_domain_feed"] = select(("feed_lines", "json_items"), f"""l AS (SELECT trim(value) AS v FROM feed_lines),
 h AS (SELECT CASE WHEN regexp_matches(v, '^(0\\.0\\.0\\.0|127\\.0\\.0\\.1)\\s')
   THEN regexp_extract(v, '\\s+(\\S+)', 1) ELSE v END AS v FROM l WHERE v <> '' AND NOT starts_with(v, '#')),
 n AS (SELECT rtrim(lower(CASE WHEN contains(v, '://') THEN regexp_extract(v, {host_re}, 2) ELSE v END), '.')
   AS domain FROM h)""",
        f"""SELECT DISTINCT 'urls' AS feed, domain FROM n WHERE contains(domain, '.') AND length(domain) >= 4
 AND NOT regexp_full_match(domain, {q(_EXACT_IP)})
 AND NOT regexp_matches(domain, '\\.(local|lan|arpa|internal)$')
 UNION ALL SELECT DISTINCT 'items', lower(regexp_extract(url, {host_re}, 2))
 FROM json_items WHERE regexp_extract(url, {host_re}, 2) <> ''""")
    sql["S3_read_json_feed"] = select(("json_items",), "", f"""SELECT DISTINCT lower(regexp_extract(url, {host_re}, 2))
 AS domain FROM json_items WHERE regexp_extract(url, {host_re}, 2) <> ''""")
    sql["S3_read_json_array"] = sql["S3_read_json_feed"]
    sql["S4_read_ranked_list"] = select(("ranked_lines",), """p AS (SELECT line_no,
  TRY_CAST(split_part(value, ',', 1) AS INT) AS rank, rtrim(lower(split_part(value, ',', 2)), '.') AS domain
  FROM ranked_lines)""", """SELECT domain, max_by(rank, line_no)::BIGINT AS rank FROM p
 WHERE rank <= 1500 AND contains(domain, '.') GROUP BY domain""")
    sql["S5_read_suffix_rules"] = select(("suffix_lines",), "", """SELECT DISTINCT
  regexp_replace(lower(regexp_extract(value, '^\\S+')), '^(\\*\\.|!)', '') AS suffix,
  CASE WHEN line_no < 1000 THEN 'icann' ELSE 'private' END AS section,
  starts_with(value, '*.') AS is_wildcard, starts_with(value, '!') AS is_exception
 FROM suffix_lines WHERE value <> '' AND NOT starts_with(value, '//')""")
    sql["S6_read_asn_list"] = select(("asn_lines",), "", """SELECT DISTINCT
  (CASE WHEN json_valid(value) THEN value END::JSON->>'$.asn')::BIGINT AS asn FROM asn_lines
 WHERE json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END, '$.asn') IN ('UBIGINT', 'BIGINT')""")
    sql["S7_read_allowlist"] = select(("allow_lines",), POLICY,
        "SELECT entry, starts_with(entry, '.') AS is_suffix FROM allow")
    sql["S8_read_registrations"] = """SELECT 'name' || o_custkey || '.com' AS domain,
 epoch_us(min_by(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, o_orderkey)
  FILTER (WHERE o_orderstatus = 'F')) AS created_us FROM orders GROUP BY o_custkey"""
    sql["S9_read_origin_asn"] = """SELECT '10.0.' || s_nationkey AS ip,
 min_by(s_suppkey, s_suppkey) FILTER (WHERE s_suppkey % 3 <> 0)::BIGINT AS asn FROM supplier
 GROUP BY s_nationkey HAVING count(*) FILTER (WHERE s_suppkey % 3 <> 0) > 0"""
    sql["S10_read_certificates"] = select(("tls_rows",), "", """SELECT domain,
  event_type <> 'signup' AS has_info, CASE WHEN event_type NOT IN ('signup', 'error') THEN 'Org ' || event_id % 5 END
   AS issuer, CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 0 ELSE event_id % 3 END::BIGINT AS san_count,
  CASE WHEN event_type <> 'signup' THEN event_type = 'error' END AS verify_failed,
  CASE WHEN event_type = 'error' THEN 'self-signed certificate' END AS fail_reason,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN epoch_us(date_trunc('second', fetched_at)) END AS not_before_us
 FROM tls_rows""")
    due = """due AS (SELECT DISTINCT apex FROM keys WHERE apex NOT IN (SELECT domain FROM registrations
   WHERE created_at IS NOT NULL OR """ + days("fetched_at") + """ < 7))"""
    sql["S11_lookup_requests"] = select(("names", "registrations"), f"{NAMES},\n{due}", """SELECT apex,
  CASE string_split(apex, '.')[-1] WHEN 'xyz' THEN 'https://rdap.one.example/domain/' || apex
   WHEN 'com' THEN 'https://rdap.two.example/v1/domain/' || apex
   WHEN 'net' THEN 'https://rdap.two.example/v1/domain/' || apex END AS url FROM due""")
    sql["S12_write_snapshot"] = select(("popular",), "", "SELECT domain, rank::BIGINT AS rank FROM popular")
    sql["S13_append_log"] = select(("names",), "", f"""SELECT domain, epoch_us({NOW}) AS classified_us,
  row_number() OVER (ORDER BY length(domain) % 2, substr(md5(domain), 1, 3), domain) AS id FROM names""")

    # names
    sql["K1_apex"] = key_query("apex")
    sql["K2_private_apex"] = key_query("private_apex")
    sql["K3_host_labels"] = key_query("host_label, icann_label")
    sql["K4_hosting_provider"] = key_query("provider")
    sql["K5_hosting_suffixes"] = select(("hosts",), f"""seedlist(suffix) AS ({values([(s,) for s in fixed.SEED_HOSTING])})""",
        """SELECT DISTINCT substr(domain, instr(domain, '.') + 1) AS suffix FROM hosts
 UNION SELECT suffix FROM seedlist""")

    # features
    sql["F1_lengths"] = feature_query("""len::BIGINT AS length, hlen::BIGINT AS hostname_length,
 length(apex)::BIGINT AS registered_domain_length, len(parts)::BIGINT AS label_count,
 greatest(len(parts) - 2, 0)::BIGINT AS subdomain_count,
 list_sum(list_transform(parts, lambda x: length(x)))::DOUBLE / len(parts) AS average_label_length,
 list_max(list_transform(parts, lambda x: length(x)))::BIGINT AS longest_label,
 list_min(list_transform(parts, lambda x: length(x)))::BIGINT AS shortest_label""")
    sql["F2_character_mix"] = feature_query("""vowels::BIGINT AS vowel_count, (letters - vowels)::BIGINT AS consonant_count,
 vowel_ratio, CASE WHEN letters > 0 THEN (letters - vowels)::DOUBLE / letters ELSE 0 END AS consonant_ratio,
 digit_ratio, specials::DOUBLE / len AS special_character_ratio""")
    sql["F3_repeats"] = feature_query("repeated_characters::BIGINT AS repeated_characters, repeated_sequences::BIGINT AS repeated_sequences")
    sql["F4_hint_words"] = feature_query("words::BIGINT AS dictionary_word_count")
    sql["F5_entropy"] = feature_query("""round(shannon, 9) AS shannon, round(CASE WHEN hlen > 1 AND kinds > 1
 THEN least(shannon / log2(kinds), 1) ELSE 0 END, 9) AS normalized""")
    sql["F6_tld"] = feature_query("tld, CASE WHEN risky THEN 0.8 ELSE 0.1 END::DOUBLE AS tld_risk, risky AS suspicious_tld")
    sql["F7_digits"] = feature_query("""ndigits::BIGINT AS digit_count, digit_ratio,
 coalesce(list_max(list_transform(regexp_extract_all(domain, '[0-9]+'), lambda x: length(x))), 0)::BIGINT AS consecutive_digits,
 regexp_matches(domain, '^[0-9]') AS leading_digits, regexp_matches(first_label, '[0-9]$') AS trailing_digits""")
    sql["F8_hyphens"] = feature_query("""nhyphens::BIGINT AS hyphen_count, starts_with(domain, '-') AS starts_with_hyphen,
 ends_with(first_label, '-') AS ends_with_hyphen, contains(domain, '--') AS consecutive_hyphens""")
    sql["F9_punycode"] = feature_query("is_punycode")
    sql["F10_dga_score"] = feature_query("dga_score")
    def everything(columns):
        return select(("names", "popular"), ALL_FEATURES + """,
 scored AS (SELECT f.*, m.* EXCLUDE (domain) FROM feat f JOIN bm m USING (domain))""",
                      f"SELECT {columns} FROM scored")

    s = signals(provider="provider")
    sql["F11_rule_score"] = everything(f"domain, least({score(s)}, 100)::BIGINT AS rule_score")
    sql["F12_severity"] = everything(f"domain, {severity(score(s))} AS severity")
    sql["F13_reasons"] = everything(f"domain, {reasons(s)} AS rule_reasons")

    # brands
    sql["B1_brand_map"] = select(("popular",), f"{RULES},\n{BRANDS}",
        "SELECT brand, official_apex, brand_order::BIGINT AS brand_order FROM brands")
    # Official names: the ranked names themselves, and names below them.
    apexes = """SELECT DISTINCT domain FROM (SELECT domain FROM names UNION ALL SELECT domain FROM popular)"""
    near = f"{RULES},\nboth_names AS ({apexes}),\n{keys('both_names')},\n{BRANDS},\n{CANDIDATES},\n{MATCHES}"
    sql["B2_official_brand"] = select(("names", "popular"), near,
        "SELECT domain, b.brand AS brand, b.brand_label AS brand_label FROM official")
    sql["B3_brand_candidates"] = select(("names",), f"{NAMES},\n{CANDIDATES}",
        "SELECT domain, candidate_order::BIGINT AS candidate_order, candidate, via_leet, via_part FROM cands")
    sql["B4_brand_similarity"] = select(("names", "popular"), near, """SELECT domain, brand, confidence,
  edit_distance::BIGINT AS edit_distance, match_type FROM lookalikes""")
    sql["B5_brand_label"] = select(("hosts",), "", f"SELECT DISTINCT domain AS brand, {BRAND_LABEL.replace('brand', 'domain')} AS brand_label FROM hosts")

    # queries
    sql["Q1_skip_policy"] = select(("names", "allow_lines"), POLICY,
        f"SELECT domain FROM names n WHERE {not_blockable('n', True)}")
    sql["Q2_distinct_first"] = select(("dns_events",), "",
        "SELECT domain, min(event_id)::BIGINT AS event_id, epoch_us(min_by(ts, event_id)) AS ts_us FROM dns_events GROUP BY domain")
    sql["Q3_unseen"] = select(("names", "seen"), "", f"""SELECT domain FROM names WHERE domain NOT IN (
  SELECT domain FROM seen WHERE last_seen >= {ago(7)})""")
    sql["Q3_unseen_clustered"] = sql["Q3_unseen"]
    sql["Q4_admit_history"] = select(("dns_events",), HISTORY, "SELECT domain, epoch_us(ts) AS ts_us FROM admitted")
    sql["Q4_admit_users"] = """WITH RECURSIVE admitted(user_id, ts) AS (
  SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL
  SELECT user_id, ts FROM (SELECT a.user_id, min(e.ts) AS ts FROM admitted a JOIN events e
   ON e.user_id = a.user_id AND e.ts > a.ts + INTERVAL 7 DAY GROUP BY a.user_id, a.ts))
 SELECT user_id::VARCHAR AS domain, epoch_us(ts) AS ts_us FROM admitted"""
    sql["Q5_admit_stream"] = sql["Q4_admit_history"]
    sql["Q6_blocked_apex"] = select(("names", "classifications"), f"{NAMES},\n{LATEST}", """SELECT k.domain,
  'AI:SUBDOMAIN:' || private_apex AS comment FROM keys k JOIN latest l ON l.domain = k.private_apex
 WHERE private_apex <> k.domain AND l.blocked""")
    sql["Q7_popularity_allow"] = select(("names", "popular", "threats"), NAMES, """SELECT k.domain, rank::BIGINT AS rank
 FROM keys k JOIN popular p ON p.domain = k.apex WHERE (provider IS NULL OR provider = k.domain)
 AND k.domain NOT IN (SELECT domain FROM threats) AND apex NOT IN (SELECT domain FROM threats)""")
    sql["Q8_rule_prefilter"] = everything(f"domain, {score(s)} < 15 AS prefiltered")
    sql["Q9_enrich_age"] = select(("names", "registrations"), NAMES, f"""SELECT k.domain,
  CASE WHEN provider IS NULL AND created_at IS NOT NULL THEN greatest({days('created_at')}, 0) END::BIGINT AS age_days
 FROM keys k LEFT JOIN registrations r ON r.domain = k.apex""")
    sql["Q10_enrich_asn"] = select(("names", "domain_asn", "bad_asns"), "", f"""SELECT n.domain, a.asn::BIGINT AS asn,
  coalesce(a.asn IN (SELECT asn FROM bad_asns), false) AS asn_flagged FROM names n LEFT JOIN
  (SELECT * FROM domain_asn WHERE {days('fetched_at')} < 7) a USING (domain)""")
    sql["Q11_enrich_tls"] = select(("names", "tls_rows"), "", f"""SELECT n.domain, t.domain IS NOT NULL AS has_tls,
  CASE WHEN t.event_type <> 'error' THEN greatest({days("date_trunc('second', fetched_at)")}, 0) END::BIGINT AS cert_age_days,
  t.event_type = 'error' AS verify_failed FROM names n LEFT JOIN (SELECT * FROM tls_rows
   WHERE event_type <> 'signup' AND {days('fetched_at')} < 7) t USING (domain)""")
    def decided(columns, where=""):
        return select(DECIDED_NEEDS, DECIDED, f"SELECT {columns} FROM decided {where}")

    # Evidence as the single fields of the JSON text.
    def scored(expression):
        return f"CASE WHEN route IN ('PREFILTER', 'SCORE') THEN {expression} END"

    sql["Q12_evidence"] = decided(f"domain, {EVIDENCE} AS evidence", "WHERE route IN ('PREFILTER', 'SCORE')")
    sql["Q13_scoring_requests"] = decided(f"""domain, least(raw, 100)::BIGINT AS rule_score,
  replace(replace({q(PROMPT)}, '#S', least(raw, 100)::VARCHAR), '#E', {EVIDENCE}) AS prompt""",
        "WHERE route = 'SCORE'")
    def replies(columns):
        return select(("names", "replies"), f"{PLAIN},\n{REPLIES}", f"SELECT domain, {columns} FROM parsed")

    sql["Q14_parse_replies"] = replies("""category, confidence, reason, severity,
  risk_score::BIGINT AS risk_score, reasons, action""")
    sql["Q15_verdict_gate"] = replies(f"""category,
  ({ACTION}) AND {BLOCKS} AND confidence >= 0.80::DOUBLE AND rule_score >= 15 AS should_block""")
    sql["Q16_gate_explain"] = replies(f"""CASE WHEN {BLOCKS} THEN
  array_to_string(list_filter([CASE WHEN NOT ({ACTION}) THEN 'action=' || CASE WHEN action = '' THEN 'none' ELSE action END END,
   CASE WHEN confidence < 0.80::DOUBLE THEN 'confidence=' || round(confidence * 100)::INT || '%<80%' END,
   CASE WHEN rule_score < 15 THEN 'rule_score=' || rule_score || '<15' END], lambda x: x IS NOT NULL), ', ')
  ELSE '' END AS failed_gates""")
    sql["Q17_dispositions"] = decided(f"""domain, route, {scored('score1')}::BIGINT AS first_score,
  {scored('least(raw, 100)')}::BIGINT AS rule_score, {scored(severity('raw'))} AS severity,
  {scored('why')} AS rule_reasons, rank::BIGINT AS rank, age::BIGINT AS age_days, asn::BIGINT AS asn, asn_flagged""")
    sql["Q17_with_certificates"] = select((*DECIDED_NEEDS, "tls_rows"), DECIDED_TLS, f"""SELECT domain, route,
  {scored('least(raw, 100)')}::BIGINT AS rule_score, {scored('why')} AS rule_reasons, tls_age::BIGINT AS cert_age_days,
  CASE WHEN route = 'SCORE' AND tls_failed THEN true WHEN route = 'SCORE' AND tls_age IS NOT NULL THEN false END AS verify_failed
  FROM decided""")
    sql["Q17_decided_verdicts"] = decided("""domain, 'SAFE' AS category, 1::DOUBLE AS confidence,
  CASE route WHEN 'POPULAR' THEN 'Popularity allowlist: apex ' || apex || ' rank=' || rank
   ELSE 'Rule pre-filter: score=' || score1 || ' below threshold=15' END AS reason, false AS blocked,
  CASE route WHEN 'PREFILTER' THEN score1 END::BIGINT AS rule_score,
  CASE route WHEN 'PREFILTER' THEN tld END AS tld""", "WHERE route IN ('POPULAR', 'PREFILTER')")
    sql["Q18_disposition_stream"] = decided(f"domain, route, {scored('least(raw, 100)')}::BIGINT AS rule_score")

    # feeds
    sql["T1_new_feed_domains"] = select(("listed", "threats"), "",
        "SELECT feed, domain FROM listed WHERE domain NOT IN (SELECT domain FROM threats)")
    sql["T1_new_feed_domains_clustered"] = sql["T1_new_feed_domains"]
    sql["T2_first_feed_wins"] = select(("listed",), "", """SELECT domain, CASE WHEN bool_or(feed = 'URLhaus')
  THEN 'URLhaus' ELSE 'OpenPhish' END AS feed FROM listed GROUP BY domain""")
    def verified(columns, where=""):
        return select(VERIFIED_NEEDS, VERIFIED, f"SELECT {columns} FROM verified {where}")

    for key, outcome in (("T3_provider_self_guard", "PROVIDER_SELF"), ("T4_hosted_content_block", "HOSTED_BLOCK"),
                         ("T5_popular_apex_guard", "POPULAR_SKIP")):
        sql[key] = verified("domain, feed, blocked, confidence, reason", f"WHERE outcome = '{outcome}'")
    sql["T6_feed_score_gate"] = verified("domain, feed, points::BIGINT AS rule_score, blocked, confidence",
                                         "WHERE outcome IN ('SCORE_BLOCK', 'SCORE_SKIP')")
    sql["T7_verify_feed"] = verified("domain, feed, category, outcome, blocked, confidence, reason")
    sql["T8_sync_summary"] = select((*VERIFIED_NEEDS, "denylist", "allow_lines"), f"{VERIFIED},\n{POLICY}", f"""
 SELECT l.feed, count(*)::BIGINT AS listed, count(*) FILTER (WHERE v.blocked)::BIGINT AS verified,
  count(*) FILTER (WHERE outcome = 'HOSTED_BLOCK')::BIGINT AS hosted_blocks,
  count(*) FILTER (WHERE outcome = 'SCORE_SKIP')::BIGINT AS score_skipped,
  count(*) FILTER (WHERE outcome = 'POPULAR_SKIP')::BIGINT AS popular_skipped,
  count(*) FILTER (WHERE v.blocked AND {not_blockable('l', False)}
   AND l.domain NOT IN (SELECT domain FROM denylist))::BIGINT AS domains_added,
  count(*) FILTER (WHERE v.domain IS NULL)::BIGINT AS domains_skipped
 FROM listed l LEFT JOIN verified v ON v.domain = l.domain AND v.feed = l.feed GROUP BY l.feed""")

    # state
    sql["M1_upsert"] = select(("threats", "listed"), "", f"""SELECT domain, coalesce(t.feed_name, u.feed) AS feed_name,
  epoch_us(coalesce(t.added_at, {NOW})) AS added_us, epoch_us(CASE WHEN u.domain IS NULL THEN t.last_seen ELSE {NOW} END)
  AS last_seen_us FROM threats t FULL JOIN (SELECT domain, min(feed) AS feed FROM listed GROUP BY domain) u USING (domain)""")
    sql["M2_latest_verdict"] = select(("classifications",), LATEST, "SELECT domain, category, confidence, blocked FROM latest")
    sql["M2_latest_verdict_kept"] = sql["M2_latest_verdict"]
    sql["M3_touch"] = select(("threats", "listed"), "", f"""SELECT domain, epoch_us(CASE WHEN domain IN
  (SELECT domain FROM listed) THEN {NOW} ELSE last_seen END) AS last_seen_us FROM threats""")
    sql["M3_touch_clustered"] = sql["M3_touch"]
    sql["M4_expired"] = select(("threats",), "", f"SELECT domain FROM threats WHERE last_seen < {ago(10)}")
    sql["M5_expire_blocks"] = select(("threats", "denylist", "mapping"), GONE, f"""
 SELECT 'threat' AS part, domain, NULL::BIGINT AS group_id FROM threats WHERE NOT last_seen < {ago(10)}
 UNION ALL SELECT 'denylist', domain, NULL FROM denylist WHERE id NOT IN (SELECT id FROM gone)
 UNION ALL SELECT 'verdict', domain, NULL FROM threats WHERE last_seen < {ago(10)}
 UNION ALL SELECT 'mapping', domainlist_id::VARCHAR, group_id FROM mapping WHERE domainlist_id NOT IN (SELECT id FROM gone)""")
    sql["M5_expire_store"] = sql["M5_expire_blocks"]
    sql["M6_retain"] = select(("classifications", "sync_log", "seen", "domain_asn", "tls_rows"), "", f"""
 SELECT 'classifications' AS part, id::VARCHAR AS key FROM classifications WHERE classified_at >= {ago(20)}
 UNION ALL SELECT 'sync_log', id::VARCHAR FROM sync_log WHERE synced_at >= {ago(20)}
 UNION ALL SELECT 'seen_domains', domain FROM seen WHERE last_seen >= {ago(20)}
 UNION ALL SELECT 'domain_asn', domain FROM domain_asn WHERE fetched_at >= {ago(20)}
 UNION ALL SELECT 'domain_tls', domain FROM tls_rows WHERE fetched_at >= {ago(20)}""")
    sql["M6_retain_store"] = select(("classifications", "sync_log", "seen"), LATEST_TIMES, f"""
 SELECT 'classifications' AS part, id::VARCHAR AS key FROM classifications WHERE classified_at >= {ago(20)}
 UNION ALL SELECT 'sync_log', id::VARCHAR FROM sync_log WHERE synced_at >= {ago(20)}
 UNION ALL SELECT 'seen_domains', domain FROM seen WHERE last_seen >= {ago(20)}
 UNION ALL SELECT 'latest_verdicts', domain FROM latest_times WHERE newest >= {ago(20)}""")
    sql["M7_feed_freshness"] = select(("sync_log",), """f(feed_name) AS (VALUES ('URLhaus'), ('OpenPhish'), ('Other')),
 h AS (SELECT f.feed_name, (epoch_us({now}) - epoch_us(max(synced_at))) / 3600000000::DOUBLE AS hours
  FROM f LEFT JOIN sync_log USING (feed_name) GROUP BY f.feed_name)""".format(now=NOW),
        """SELECT feed_name, hours, CASE WHEN hours IS NULL THEN 'never' WHEN hours > 24 THEN 'stale' ELSE 'fresh' END
 AS status FROM h""")
    sql["M8_due_jobs"] = select(("sync_log",), f"""j(feed_name, every_hours) AS ({values(list(fixed.JOB_INTERVALS))}),
 h AS (SELECT j.feed_name, every_hours, (epoch_us({NOW}) - epoch_us(max(synced_at))) / 3600000000::DOUBLE AS hours
  FROM j LEFT JOIN sync_log USING (feed_name) GROUP BY ALL)""",
        "SELECT feed_name, hours FROM h WHERE hours IS NULL OR hours >= every_hours")
    sql["M9_upgrade_schema"] = select(("threats",), "", """SELECT domain, feed_name, epoch_us(added_at) AS added_us,
  epoch_us(added_at) AS last_seen_us FROM threats""")
    sql["M9_schema_versions"] = select(("threats",), "", """SELECT domain,
  CASE WHEN length(domain) % 3 > 0 THEN feed_name END AS feed_name, length(domain)::BIGINT AS n,
  epoch_us(added_at) AS added_us, epoch_us(CASE WHEN length(domain) % 3 = 2 THEN last_seen ELSE added_at END) AS last_seen_us
 FROM threats""")
    sql["M10_lookup_due"] = select(("names", "registrations"), f"{NAMES},\n{due}", "SELECT apex AS domain FROM due")

    sql["M1_upsert_caches"] = select(("registrations", "seen", "names"), "", f"""
 SELECT 'registration' AS part, domain, epoch_us(CASE WHEN r.fetched_at IS NULL THEN n.at ELSE r.created_at END) AS first_us,
  epoch_us(coalesce(n.at, r.fetched_at)) AS last_us
  FROM registrations r FULL JOIN (SELECT domain, {NOW} AS at FROM names) n USING (domain)
 UNION ALL SELECT 'seen', domain, epoch_us(coalesce(s.first_seen, n.at)), epoch_us(coalesce(n.at, s.last_seen))
  FROM seen s FULL JOIN (SELECT domain, {NOW} AS at FROM names) n USING (domain)""")
    sql["M10_lookup_due_network"] = select(("names", "domain_asn", "tls_rows"), "", f"""
 SELECT 'network' AS part, domain FROM names WHERE domain NOT IN (
  SELECT domain FROM domain_asn WHERE {days('fetched_at', 5)} < 2)
 UNION ALL SELECT 'certificate', domain FROM names WHERE domain NOT IN (
  SELECT domain FROM tls_rows WHERE {days('fetched_at', 5)} < 2)""")
    sql["S9_domain_asn"] = select(("names",), "", """
 SELECT a.domain, o.asn::BIGINT AS asn FROM (SELECT domain, '10.0.' || (length(domain) % 30) AS ip FROM names) a
 LEFT JOIN (SELECT '10.0.' || s_nationkey AS ip, min(s_suppkey) AS asn FROM supplier
  WHERE s_suppkey % 3 <> 0 GROUP BY s_nationkey) o USING (ip)""")
    sql["D2_new_group"] = select(("denylist", "mapping", "listed"), f"""
 g AS (SELECT 0 AS id UNION ALL SELECT n_nationkey + 10 FROM nation),
 top AS (SELECT max(id) + 1 AS id FROM g),
 ids AS (SELECT id FROM denylist WHERE type = 1 AND domain IN (SELECT domain FROM listed))""",
        """SELECT domainlist_id::BIGINT AS domainlist_id, group_id::BIGINT AS group_id FROM mapping
  WHERE group_id <> 0 OR domainlist_id NOT IN (SELECT id FROM ids)
 UNION SELECT ids.id, top.id FROM ids, top""")
    verdicts = f"""{{0}},
 gated AS (SELECT *, ({ACTION}) AND {BLOCKS} AND confidence >= 0.80::DOUBLE AND rule_score >= 15 AS should_block FROM parsed),
 proposed AS (SELECT domain, 'AI:' || category || ':' || format('{{{{:.2f}}}}', confidence) AS comment
  FROM gated WHERE should_block),
 wanted AS (SELECT * FROM proposed p WHERE {not_blockable('p', False)} AND domain NOT IN (SELECT domain FROM denylist)),
 fresh_rows AS (SELECT (SELECT max(id) FROM denylist) + row_number() OVER (ORDER BY substr(md5(domain), 1, 3), domain) AS id,
  domain, comment FROM wanted),
 all_rows AS (SELECT id, domain, type, comment FROM denylist UNION ALL SELECT id, domain, 1, comment FROM fresh_rows),
 ids AS (SELECT id FROM all_rows WHERE type = 1 AND domain IN (SELECT domain FROM proposed)),
 mapped AS (SELECT domainlist_id, group_id FROM mapping WHERE group_id <> 0 OR domainlist_id NOT IN (SELECT id FROM ids)
  UNION SELECT id, 5 FROM ids)"""
    sql["Q19_replies_to_blocks"] = select(("names", "replies", "denylist", "mapping", "allow_lines"),
        verdicts.format(f"{PLAIN},\n{REPLIES},\n{POLICY}"), """SELECT a.id::BIGINT AS id, a.domain, a.comment,
  m.group_id::BIGINT AS group_id FROM all_rows a LEFT JOIN mapped m ON m.domainlist_id = a.id""")

    # denylist and reports
    sql["D1_denylist_add"] = select(("listed", "allow_lines", "denylist"), NEW_ROWS, f"""SELECT id::BIGINT AS id, domain,
  1::BIGINT AS type, 1::BIGINT AS enabled, epoch({NOW})::BIGINT AS date_added, comment FROM added""")
    moved = """ids AS ({}), result AS (SELECT domainlist_id, group_id FROM mapping WHERE group_id <> 0
  OR domainlist_id NOT IN (SELECT id FROM ids) UNION SELECT id, 5 FROM ids)"""
    final = "SELECT domainlist_id::BIGINT AS domainlist_id, group_id::BIGINT AS group_id FROM result"
    sql["D2_group_assign"] = select(("denylist", "mapping", "listed"), moved.format(
        "SELECT id FROM denylist WHERE type = 1 AND domain IN (SELECT domain FROM listed)"), final)
    sql["D3_denylist_remove"] = select(("threats", "denylist", "mapping"), GONE, """SELECT d.id::BIGINT AS id, d.domain,
  m.group_id::BIGINT AS group_id FROM denylist d LEFT JOIN mapping m ON m.domainlist_id = d.id
 WHERE d.id NOT IN (SELECT id FROM gone)""")
    sql["D4_migrate_groups"] = select(("denylist", "mapping"), moved.format(
        "SELECT id FROM denylist WHERE type = 1 AND (comment ILIKE 'AI:%' OR comment ILIKE 'TI:%')"), final)
    sql["R1_group_members"] = select(("denylist", "mapping", "groups"), "", f"""SELECT d.id::BIGINT AS id, d.domain, d.comment
 FROM denylist d JOIN mapping m ON m.domainlist_id = d.id JOIN groups g ON g.id = m.group_id
 WHERE g.name = {q(fixed.BLOCK_GROUP)}""")
    sql["R2_recent_verdicts"] = select(("classifications",), "", """SELECT id::BIGINT AS id, domain, category, confidence, blocked
 FROM classifications ORDER BY classified_at DESC, id DESC LIMIT 50""")
    sql["R3_sync_history"] = select(("sync_log",), "", """SELECT id::BIGINT AS id, feed_name, domains_added, domains_skipped
 FROM sync_log ORDER BY synced_at DESC, id DESC LIMIT 20""")
    sql["R4_blocks_by_origin"] = select(("denylist",), "", """SELECT split_part(comment, ':', 1) AS origin,
  split_part(comment, ':', 2) AS kind, count(*)::BIGINT AS blocks FROM denylist
 WHERE comment ILIKE 'AI:%' OR comment ILIKE 'TI:%' GROUP BY ALL""")
    sql["R5_top_ranked"] = select(("popular",), "", "SELECT domain, rank::BIGINT AS rank FROM popular WHERE rank <= 100")
    sql["R6_popularity_rank"] = select(("names", "popular"), "", """SELECT d.domain, p.rank::BIGINT AS rank FROM
  (SELECT domain FROM names UNION SELECT domain FROM popular) d LEFT JOIN popular p USING (domain)""")
    return sql
