"""The feature table: lexical groups, scores, severity and reasons per distinct name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.functions import lexical as lx, rules as rl
from domainsieve.operators.brands import BrandIndex, with_brand_match
from domainsieve.operators.names import TailIndex, with_name_keys
from domainsieve.params import DEFAULTS, Params


def lexical_features(d: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add the lexical groups to names with apex and host_label. Needs no shuffle."""
    name, host = F.col("domain"), F.col("host_label")
    d = d.withColumns({
        "lexical": lx.lengths(name, host, F.col("apex")),
        "mix": lx.character_mix(name),
        "repeats": lx.repeats(name),
        "dictionary_word_count": lx.hint_words(name),
        "entropy": lx.entropy(host),
        "tld": lx.tld(name),
        "digits": lx.digits(name),
        "hyphens": lx.hyphens(name),
        "is_punycode": lx.is_punycode(name),
    })
    repeated = (F.col("repeats.repeated_characters") > 0) | (F.col("repeats.repeated_sequences") > 0)
    return d.withColumn("dga_score", lx.dga_score(
        F.col("entropy.shannon"), F.col("mix.vowel_ratio"), F.col("lexical.hostname_length"),
        F.col("mix.digit_ratio"), F.col("dictionary_word_count"), repeated, params))


def with_rules(d: DataFrame, params: Params = DEFAULTS, feed_hit: Column | None = None,
               provider: Column | None = None, asn: Column | None = None,
               asn_flagged: Column | None = None, tls: str | None = None,
               age_days: Column | None = None, name: str = "rules") -> DataFrame:
    """Add the rule struct. Signals left out count as absent."""
    def text(c): return F.lit(None).cast("string") if c is None else c
    def number(c): return F.lit(None).cast("int") if c is None else c
    def flag(c): return F.lit(False) if c is None else F.coalesce(c, F.lit(False))
    tls_field = (lambda f: F.col(f"{tls}.{f}")) if tls else (lambda f: None)
    signals = rl.rule_signals(
        flag(feed_hit), F.col("dga_score"), F.col("entropy.shannon"),
        F.col("brand.brand_label"), F.col("brand.match_type"),
        F.col("tld.suspicious_tld"), F.col("digits.digit_ratio"), F.col("hyphens.hyphen_count"),
        F.col("is_punycode"), text(provider), number(asn), flag(asn_flagged),
        flag(tls_field("verify_failed")), text(tls_field("fail_reason")),
        number(tls_field("cert_age_days")), number(age_days), params)
    return d.withColumn(name, rl.evaluate(signals))


def domain_features(d: DataFrame, index: TailIndex, brands: BrandIndex,
                    params: Params = DEFAULTS, **context) -> DataFrame:
    """All feature groups for a table of distinct clean names.

    `context` is passed on to with_rules (feed_hit, provider, asn, …).
    """
    keyed = with_name_keys(d, index)
    return with_rules(with_brand_match(lexical_features(keyed, params), brands, params),
                      params, **context)
