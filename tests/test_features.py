import math
import random
import re

import pytest
from pyspark.sql import functions as F

from domainsieve import fixed
from domainsieve.functions import lexical as lx
from domainsieve.operators import brands as br
from domainsieve.operators.features import domain_features
from domainsieve.operators.names import with_name_keys

BRANDS = [("google", "google.com", 1), ("paypal", "paypal.com", 2), ("7eleven", "7-eleven.com", 3)]
BRAND_SCHEMA = "brand string, official_apex string, brand_order int"


@pytest.fixture(scope="module")
def brands(spark):
    return br.brand_index(spark.createDataFrame(BRANDS, BRAND_SCHEMA))


def features(names, index, brands, *domains, **context):
    return {r["domain"]: r for r in domain_features(names(*domains), index, brands, **context).collect()}


def test_brand_kinds(names, index, brands):
    got = features(names, index, brands, "mail.google.com", "oauth2.googleapis.com", "g00gle.com",
                   "paypal-login.com", "gooogle.com", "example.org", "paypal-login.github.io",
                   "google.xyz", "paypa1-login-security.xyz")
    kind = {d: (r["brand"]["brand_label"], r["brand"]["match_type"]) for d, r in got.items()}
    assert kind == {
        "mail.google.com": ("Google", "official"), "oauth2.googleapis.com": ("Google", "contains"),
        "g00gle.com": ("Google", "leet"), "paypal-login.com": ("Paypal", "embedded"),
        "gooogle.com": ("Google", "fuzzy"), "example.org": (None, None),
        "paypal-login.github.io": ("Paypal", "embedded"), "google.xyz": ("Google", "exact"),
        "paypa1-login-security.xyz": ("Paypal", "leet")}
    assert got["example.org"]["brand"]["confidence"] == 0.0
    assert got["mail.google.com"]["rules"]["rule_score"] == 0
    assert got["paypa1-login-security.xyz"]["rules"]["rule_score"] >= 40
    assert got["paypa1-login-security.xyz"]["digits"]["digit_count"] == 1
    assert got["paypa1-login-security.xyz"]["hyphens"]["hyphen_count"] == 2


def test_rule_score_signals(names, index, brands):
    base = features(names, index, brands, "evil-c2.xyz")["evil-c2.xyz"]["rules"]["rule_score"]

    def score(**context):
        r = features(names, index, brands, "evil-c2.xyz", **context)["evil-c2.xyz"]["rules"]
        return r["rule_score"] - base, r["rule_reasons"][-1]

    assert score(provider=F.lit("github.io")) == (10, "User content on shared-hosting provider github.io")
    assert score(asn=F.lit(205112), asn_flagged=F.lit(True)) == (
        60, "Hosted in Spamhaus DROP-listed network (AS205112)")
    assert score(asn=F.lit(13335), asn_flagged=F.lit(False))[0] == 0
    assert score(age_days=F.lit(5)) == (25, "Newly registered domain (5 days old)")
    assert score(age_days=F.lit(90)) == (10, "Recently registered domain (90 days old)")
    assert score(age_days=F.lit(3000))[0] == 0
    hit = features(names, index, brands, "evil.com", feed_hit=F.lit(True))["evil.com"]["rules"]
    assert hit["rule_score"] == 100 and hit["severity"] == "HIGH"


def test_certificate_signals(spark, index, brands):
    def score(failed, age):
        d = spark.createDataFrame([("evil-c2.xyz", (failed, "self-signed" if failed else None, age))],
                                  "domain string, tls struct<verify_failed:boolean,fail_reason:string,cert_age_days:int>")
        return domain_features(d, index, brands, tls="tls").first()["rules"]["rule_score"]
    base = score(False, None)
    assert score(True, None) == base + 20
    assert score(True, 2) == base + 20
    assert score(False, 2) == base + 10
    assert score(False, 200) == base


def test_beacon_scores_fifteen(names, index, brands):
    got = features(names, index, brands, "evil-c2-beacon.ru", "maybe-bad.com")
    assert got["evil-c2-beacon.ru"]["rules"]["rule_score"] == 15
    assert got["maybe-bad.com"]["rules"]["rule_score"] == 0


def test_counts_equal_plain_python(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("aab1-.x") for _ in range(rng.randint(1, 24))) for _ in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = d.select("t", lx.repeated_characters(t).alias("chars"), lx.repeated_sequences(t).alias("seqs"),
                   lx.shannon(t).alias("bits"), lx.digits(t).alias("digits")).collect()
    for r in got:
        text = r["t"]
        assert r["chars"] == len(re.findall(r"(.)\1{2,}", text))
        assert r["seqs"] == len(re.findall(r"([a-z0-9]{2,})\1", text))
        counts = [text.count(c) / len(text) for c in set(text)]
        assert abs(r["bits"] + sum(p * math.log2(p) for p in counts)) < 1e-9
        assert r["digits"]["consecutive_digits"] == max(map(len, re.findall(r"\d+", text)), default=0)


def test_brand_label_is_title_case(spark):
    d = spark.createDataFrame([("7eleven",), ("foo-bar",), ("a1b",)], "b string")
    got = [r[0] for r in d.select(br.brand_label(F.col("b"))).collect()]
    assert got == ["7Eleven", "Foo-Bar", "A1B"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("match", [0.80, 0.70])
def test_similarity_join_finds_every_match(spark, match):
    """The keyed join against a comparison of every candidate with every brand."""
    from dataclasses import replace
    from domainsieve.params import DEFAULTS
    rng = random.Random(3)
    tokens = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 16))) for _ in range(80)})
    brands = [(t, f"{t}.com", i) for i, t in enumerate(tokens)]

    def mutate(t):
        t = list(t)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(t) + 1)
            kind = rng.random()
            if kind < 0.4:
                t.insert(at, rng.choice("abc"))
            elif t and at < len(t):
                if kind < 0.7:
                    del t[at]
                else:
                    t[at] = rng.choice("abc")
        return "".join(t)
    cands = [(f"n{i}", 0, mutate(rng.choice(tokens)) + rng.choice(["", "", "cab"]), False, False)
             for i in range(600)]
    d = spark.createDataFrame(cands, "domain string, candidate_order int, candidate string, "
                                     "via_leet boolean, via_part boolean")
    index = br.brand_index(spark.createDataFrame(brands, BRAND_SCHEMA))
    got = {r["domain"]: (r["brand"], round(r["confidence"], 9), r["match_type"]) for r in
           br.brand_similarity_join(d, index, replace(DEFAULTS, brand_match=match)).collect()}
    want = {}
    for domain, _, text, _, _ in cands:
        best = None
        for brand, _, order in brands:
            longer, inside = max(len(text), len(brand)), brand in text and brand != text
            dist = edit_distance(text, brand)
            conf = max(1 - dist / longer, 0.85 if inside else 0)
            kind = "exact" if dist == 0 else "contains" if inside else "fuzzy"
            if conf >= match and (best is None or conf > best[1]):
                best = (brand, conf, kind)
        if best:
            want[domain] = (best[0], round(best[1], 9), best[2])
    assert len(want) > 100
    assert got == want


def test_brand_map_from_ranks(spark, index):
    ranks = [("google.com", 1), ("google.co.in", 500), ("paypal.com", 60), ("t.co", 20),
             ("amazon.co.uk", 80), ("obscure-site.com", 5000)]
    popular = spark.createDataFrame(ranks, "domain string, rank int")
    seed = br.seed_brands(spark, (("icici", "icicibank.com"), ("google", "google.ai")))
    got = {r["brand"]: (r["official_apex"], r["brand_order"]) for r in
           br.brand_map(popular, index, seed).collect()}
    assert got == {"google": ("google.ai", 1), "paypal": ("paypal.com", 60),
                   "amazon": ("amazon.co.uk", 80), "icici": ("icicibank.com", 1001)}


def test_seed_brand_found_in_name(spark, names, index):
    popular = spark.createDataFrame([], "domain string, rank int")
    seed = br.brand_index(br.brand_map(popular, index, br.seed_brands(spark)))
    got = features(names, index, seed, "hdfc-netbanking-login.xyz")["hdfc-netbanking-login.xyz"]
    assert (got["brand"]["brand_label"], got["brand"]["match_type"]) == ("Hdfc", "embedded")
    assert got["dictionary_word_count"] == sum(w in "hdfc-netbanking-login.xyz" for w in fixed.HINT_WORDS)


def test_candidates_in_order(names, index):
    d = with_name_keys(names("g00-pay-l0gin.github.io"), index)
    got = [(r["candidate"], r["via_leet"], r["via_part"]) for r in
           br.brand_candidates(d).orderBy("candidate_order").collect()]
    assert got == [("g00payl0gin", False, False), ("goopaylogin", True, False), ("g00", False, True),
                   ("goo", True, True), ("pay", False, True), ("l0gin", False, True),
                   ("login", True, True), ("github", False, False)]
