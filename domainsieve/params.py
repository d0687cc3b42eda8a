"""Thresholds and weights, passed explicitly to every operator that needs them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # verdict gate
    block_confidence: float = 0.80
    block_score_floor: int = 15
    prefilter_limit: int = 15
    feed_score_limit: int = 70
    # features
    dga_limit: float = 0.70
    entropy_limit: float = 3.8
    # shares of the signs of a generated name, and their limits
    dga_entropy_share: float = 0.35
    dga_vowel_share: float = 0.20
    dga_digit_share: float = 0.15
    dga_hint_share: float = 0.20
    dga_repeat_share: float = 0.10
    few_vowels: float = 0.25
    many_digits: float = 0.25
    # rule weights
    feed_hit_weight: int = 100
    dga_weight: int = 30
    brand_weight: int = 25
    entropy_weight: int = 20
    tld_weight: int = 10
    digits_weight: int = 5
    hyphens_weight: int = 5
    punycode_weight: int = 35
    asn_weight: int = 60
    tls_invalid_weight: int = 20
    tls_new_days: int = 14
    tls_new_weight: int = 10
    hosting_weight: int = 10
    age_new_days: int = 30
    age_new_weight: int = 25
    age_recent_days: int = 180
    age_recent_weight: int = 10
    # brands
    brand_match: float = 0.80
    brand_max_rank: int = 1000
    brand_min_len: int = 5
    # state, in days unless named otherwise
    seen_ttl_days: float = 7
    feed_stale_hours: float = 24
    block_expiry_days: float = 30
    retention_days: float = 90
    registration_retry_days: int = 7
    asn_cache_days: int = 7
    tls_cache_days: int = 7
    popular_max_rank: int = 100_000
    use_tls: bool = False


DEFAULTS = Params()
