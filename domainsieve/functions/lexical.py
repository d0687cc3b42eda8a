"""Lexical feature groups of a name, one struct column per group.

`name` is the clean name; `host` the label left of its public suffix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from domainsieve.fixed import HINT_WORDS, RISKY_TLDS, TLD_RISK_HIGH, TLD_RISK_LOW
from domainsieve.functions.names import first_label
from domainsieve.params import DEFAULTS, Params


def _without(c: Column, chars: str) -> Column:
    return F.length(F.translate(c, chars, ""))


def _count_of(c: Column, chars: str) -> Column:
    return F.length(c) - _without(c, chars)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def lengths(name: Column, host: Column, apex: Column) -> Column:
    labels = F.filter(F.split(name, r"\."), lambda x: x != "")
    sizes = F.transform(labels, lambda x: F.length(x))
    sizes = F.when(F.size(labels) > 0, sizes).otherwise(F.array(F.lit(0)))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    return F.struct(
        F.length(name).alias("length"),
        F.length(host).alias("hostname_length"),
        F.length(apex).alias("registered_domain_length"),
        F.size(labels).alias("label_count"),
        F.greatest(F.size(labels) - 2, F.lit(0)).alias("subdomain_count"),
        (total.cast("double") / F.size(sizes)).alias("average_label_length"),
        F.array_max(sizes).alias("longest_label"),
        F.array_min(sizes).alias("shortest_label"),
    )


def digit_ratio(name: Column) -> Column:
    return _share(_count_of(name, "0123456789"), F.length(name))


def letter_count(name: Column) -> Column:
    return _count_matches(name, r"\p{L}")


def vowel_ratio(name: Column) -> Column:
    return _share(_count_of(name, "aeiou"), letter_count(name))


def character_mix(name: Column) -> Column:
    letters, vowels = letter_count(name), _count_of(name, "aeiou")
    specials = _count_matches(name, r"[^\p{L}\p{N}.]")
    return F.struct(
        vowels.alias("vowel_count"),
        (letters - vowels).alias("consonant_count"),
        _share(vowels, letters).alias("vowel_ratio"),
        _share(letters - vowels, letters).alias("consonant_ratio"),
        digit_ratio(name).alias("digit_ratio"),
        _share(specials, F.length(name)).alias("special_character_ratio"),
    )


def repeated_characters(name: Column) -> Column:
    return _count_matches(name, r"(.)\1{2,}")


def repeated_sequences(name: Column) -> Column:
    return _count_matches(name, r"([a-z0-9]{2,})\1")


def repeats(name: Column) -> Column:
    return F.struct(
        repeated_characters(name).alias("repeated_characters"),
        repeated_sequences(name).alias("repeated_sequences"),
    )


def hint_words(name: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(name, F.lit(w)).cast("int") for w in HINT_WORDS])


def shannon(text: Column) -> Column:
    """Entropy in bits per character."""
    size = F.length(text)

    def step(acc, ch):
        p = (size - F.length(F.replace(text, ch, F.lit("")))).cast("double") / size
        return acc - p * F.log2(p)

    distinct = F.array_distinct(F.split(text, ""))
    return F.when(size > 1, F.aggregate(distinct, F.lit(0.0), step)).otherwise(F.lit(0.0))


def entropy(host: Column) -> Column:
    kinds = F.size(F.array_distinct(F.split(host, "")))
    bits = shannon(host)
    scaled = F.when((F.length(host) > 1) & (kinds > 1),
                    F.least(bits / F.log2(kinds.cast("double")), F.lit(1.0)))
    return F.struct(bits.alias("shannon"), F.coalesce(scaled, F.lit(0.0)).alias("normalized"))


def tld(name: Column) -> Column:
    last = F.substring_index(name, ".", -1)
    risky = last.isin(*RISKY_TLDS)
    return F.struct(
        last.alias("tld"),
        F.when(risky, F.lit(TLD_RISK_HIGH)).otherwise(F.lit(TLD_RISK_LOW)).alias("tld_risk"),
        risky.alias("suspicious_tld"),
    )


def digits(name: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)")), lambda x: F.length(x))
    return F.struct(
        _count_of(name, "0123456789").alias("digit_count"),
        digit_ratio(name).alias("digit_ratio"),
        F.coalesce(F.array_max(runs), F.lit(0)).alias("consecutive_digits"),
        name.rlike(r"^[0-9]").alias("leading_digits"),
        first_label(name).rlike(r"[0-9]$").alias("trailing_digits"),
    )


def hyphens(name: Column) -> Column:
    return F.struct(
        _count_of(name, "-").alias("hyphen_count"),
        name.startswith("-").alias("starts_with_hyphen"),
        first_label(name).endswith("-").alias("ends_with_hyphen"),
        F.contains(name, F.lit("--")).alias("consecutive_hyphens"),
    )


def is_punycode(name: Column) -> Column:
    return name.startswith("xn--") | F.contains(name, F.lit(".xn--"))


def dga_score(shannon_bits: Column, vowels: Column, host_length: Column, digit_share: Column,
              hints: Column, any_repeat: Column, params: Params = DEFAULTS) -> Column:
    """Weighted sum of five signs of a generated name, at most 1."""
    signs = [
        (shannon_bits >= params.entropy_limit, params.dga_entropy_share),
        ((vowels < params.few_vowels) & (host_length >= 10), params.dga_vowel_share),
        (digit_share > params.many_digits, params.dga_digit_share),
        ((hints == 0) & (host_length >= 12), params.dga_hint_share),
        (any_repeat, params.dga_repeat_share),
    ]
    total = reduce(lambda a, b: a + b,
                   [F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in signs])
    return F.least(total, F.lit(1.0))
