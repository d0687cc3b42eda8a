"""Rule score, severity and reasons as one list of (condition, weight, text)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from domainsieve.fixed import RULE_REASONS
from domainsieve.functions.literals import filled
from domainsieve.params import DEFAULTS, Params


def rule_signals(feed_hit: Column, dga: Column, entropy: Column, brand_label: Column,
                 brand_type: Column, risky_tld: Column, digit_share: Column,
                 hyphen_count: Column, punycode: Column, provider: Column,
                 asn: Column, asn_flagged: Column, tls_failed: Column, tls_reason: Column,
                 cert_age: Column, age_days: Column,
                 params: Params = DEFAULTS) -> list[tuple[Column, int, Column]]:
    """Signals in report order. Null inputs mean "no signal"."""
    p = params
    failed = F.coalesce(tls_failed, F.lit(False))
    t = RULE_REASONS
    return [
        (feed_hit, p.feed_hit_weight, filled(t["feed"])),
        (dga >= p.dga_limit, p.dga_weight, filled(t["dga"])),
        (brand_type != "official", p.brand_weight, filled(t["brand"], brand_label)),
        (entropy >= p.entropy_limit, p.entropy_weight, filled(t["entropy"])),
        (risky_tld, p.tld_weight, filled(t["tld"])),
        (digit_share > 0.20, p.digits_weight, filled(t["digits"])),
        (hyphen_count >= 2, p.hyphens_weight, filled(t["hyphens"])),
        (punycode, p.punycode_weight, filled(t["punycode"])),
        (asn_flagged, p.asn_weight, filled(t["network"], asn)),
        (failed, p.tls_invalid_weight, filled(t["tls"], F.coalesce(tls_reason, F.lit("None")))),
        (~failed & (cert_age <= p.tls_new_days), p.tls_new_weight, filled(t["new_tls"], cert_age)),
        (provider.isNotNull(), p.hosting_weight, filled(t["hosting"], provider)),
        (age_days <= p.age_new_days, p.age_new_weight, filled(t["new_name"], age_days)),
        ((age_days > p.age_new_days) & (age_days <= p.age_recent_days), p.age_recent_weight,
         filled(t["recent_name"], age_days)),
    ]


def raw_score(signals) -> Column:
    return reduce(lambda a, b: a + b,
                  [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w, _ in signals])


def severity(score: Column) -> Column:
    return (F.when(score >= 80, "HIGH").when(score >= 50, "MEDIUM")
            .when(score >= 20, "LOW").otherwise("INFO"))


def reasons(signals) -> Column:
    return F.array_compact(F.array(*[F.when(c, t) for c, _, t in signals]))


def evaluate(signals) -> Column:
    score = raw_score(signals)
    return F.struct(
        F.least(score, F.lit(100)).alias("rule_score"),
        severity(score).alias("severity"),
        reasons(signals).alias("rule_reasons"),
    )
