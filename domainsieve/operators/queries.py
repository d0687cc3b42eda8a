"""Decisions on queried names that need no model: blocked apex, popularity, pre-filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.operators.lookup import lookup_join
from domainsieve.operators.state import latest_verdict
from domainsieve.params import DEFAULTS, Params


def blocked_apex_join(d: DataFrame, classifications: DataFrame) -> DataFrame:
    """Add apex_blocked: the private apex is another name whose latest verdict blocks."""
    blocked = latest_verdict(classifications).filter("blocked")
    d = lookup_join(d, blocked, "private_apex", "domain", [F.lit(True).alias("apex_blocked")],
                    only=F.col("private_apex") != F.col("domain"), size_of=classifications)
    return d.withColumn("apex_blocked", F.coalesce("apex_blocked", F.lit(False)))


def subdomain_comment() -> Column:
    return F.concat(F.lit("AI:SUBDOMAIN:"), F.col("private_apex"))


def popularity_rank(d: DataFrame, popular: DataFrame, key: str = "domain") -> DataFrame:
    """Add rank of the name in column `key`, null when it has none."""
    return lookup_join(d, popular, key, "domain", [F.col("rank")])


def outside_provider() -> Column:
    """The hosting provider of a name that is not the provider itself."""
    return F.when(F.col("provider") != F.col("domain"), F.col("provider"))


def popularity_allow(d: DataFrame, popular: DataFrame, threats: DataFrame) -> DataFrame:
    """Add rank and popular_allowed: ranked apex, no hosting provider, no known threat."""
    d = popularity_rank(d, popular, "apex")
    candidate = F.col("rank").isNotNull() & outside_provider().isNull()
    d = d.withColumn("_maybe", candidate)
    known = threats.select("domain")
    d = lookup_join(d, known, "apex", "domain", [F.lit(True).alias("_apex_threat")],
                    only=F.col("_maybe"))
    own = known.select(F.col("domain").alias("_t"))
    d = d.join(own, F.col("domain") == F.col("_t"), "left")
    threat = F.col("_t").isNotNull() | F.coalesce("_apex_threat", F.lit(False))
    return d.withColumn("popular_allowed", F.col("_maybe") & ~threat).drop(
        "_maybe", "_t", "_apex_threat")


def rule_prefilter(d: DataFrame, params: Params = DEFAULTS, rules: str = "rules") -> DataFrame:
    """Add prefiltered: the rule score is too low to ask the model."""
    return d.withColumn("prefiltered", F.col(f"{rules}.rule_score") < params.prefilter_limit)
