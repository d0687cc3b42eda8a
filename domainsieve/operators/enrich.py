"""Lookup results on names: registration age, hosting network, certificate.

A null value in a lookup row means "looked up, nothing found"; no row means
"never looked up". The two are told apart by the joined key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.operators.lookup import lookup_join
from domainsieve.params import DEFAULTS, Params

_DAY = 86_400_000_000


def whole_days(since: Column, as_of: Column) -> Column:
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp")))
                   / F.lit(_DAY)).cast("int")


def enrich_age(d: DataFrame, registrations: DataFrame, as_of: Column,
               only: Column | None = None) -> DataFrame:
    """Add age_days of the apex; null when unknown or when a provider is set."""
    wanted = F.col("provider").isNull() if only is None else F.col("provider").isNull() & only
    d = lookup_join(d, registrations, "apex", "domain", [F.col("created_at").alias("_created")],
                    only=wanted)
    age = F.greatest(whole_days(F.col("_created"), as_of), F.lit(0))
    return d.withColumn("age_days", F.when(F.col("_created").isNotNull(), age)).drop("_created")


def enrich_asn(d: DataFrame, domain_asn: DataFrame, bad_asns: DataFrame, as_of: Column,
               params: Params = DEFAULTS) -> DataFrame:
    """Add asn and asn_flagged from lookups that are not older than the cache time."""
    fresh = domain_asn.filter(whole_days(F.col("fetched_at"), as_of) < params.asn_cache_days)
    known = lookup_join(fresh.select("domain", "asn").filter("asn IS NOT NULL"), bad_asns, "asn", "asn",
                        [F.lit(True).alias("asn_flagged")]).withColumnRenamed("domain", "_d")
    return (d.join(known, F.col("domain") == F.col("_d"), "left").drop("_d")
            .withColumn("asn_flagged", F.coalesce("asn_flagged", F.lit(False))))


def enrich_tls(d: DataFrame, domain_tls: DataFrame, as_of: Column,
               params: Params = DEFAULTS) -> DataFrame:
    """Add struct tls with cert_age_days; null when there is no fresh record."""
    fresh = domain_tls.filter((whole_days(F.col("fetched_at"), as_of) < params.tls_cache_days)
                              & F.col("info").isNotNull())
    age = F.greatest(whole_days(F.col("info.not_before"), as_of), F.lit(0))
    info = F.col("info").withField(
        "cert_age_days", F.when(F.col("info.not_before").isNotNull(), age))
    return (d.join(fresh.select(F.col("domain").alias("_d"), info.alias("tls")),
                   F.col("domain") == F.col("_d"), "left").drop("_d"))


def lookup_due(d: DataFrame, cache: DataFrame, as_of: Column, retry_days: int,
               found: Column | None = None) -> DataFrame:
    """Distinct names whose lookup row is absent or older than retry_days.

    Rows where `found` holds are good for ever (registration dates do not change).
    """
    fresh = whole_days(F.col("fetched_at"), as_of) < retry_days
    good = cache.filter(fresh if found is None else found | fresh).select("domain")
    return d.join(good, "domain", "left_anti")
