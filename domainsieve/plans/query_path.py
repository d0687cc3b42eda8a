"""From queried names to dispositions: decided rows, and requests for the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.functions.names import clean_name
from domainsieve.operators.brands import BrandIndex, with_brand_match
from domainsieve.operators.denylist import denylist_add, group_assign, listed_ids
from domainsieve.operators.enrich import enrich_age, enrich_asn, enrich_tls
from domainsieve.operators.features import lexical_features, with_rules
from domainsieve.operators.names import TailIndex, with_name_keys
from domainsieve.operators.queries import (
    blocked_apex_join, outside_provider, popularity_allow, rule_prefilter, subdomain_comment)
from domainsieve.operators.verdicts import evidence, scoring_requests, verdict_columns
from domainsieve.params import DEFAULTS, Params
from domainsieve.sources.workdir import new_folder, written

_NO_TLS = "struct<issuer:string,san_count:int,verify_failed:boolean,fail_reason:string,not_before:timestamp,cert_age_days:int>"


@dataclass(frozen=True)
class QueryTables:
    """What the query path reads."""

    index: TailIndex
    brands: BrandIndex
    classifications: DataFrame
    popular: DataFrame
    threats: DataFrame
    registrations: DataFrame
    domain_asn: DataFrame
    bad_asns: DataFrame
    domain_tls: DataFrame | None = None


def dispositions(d: DataFrame, tables: QueryTables, as_of: Column,
                 params: Params = DEFAULTS) -> DataFrame:
    """One row per distinct name with its route, features, scores and evidence.

    Routes are tested in this order: SUBDOMAIN_BLOCK, POPULAR, PREFILTER, SCORE.
    Brand search runs only for names the first two leave open, lookups only for
    names that go to the model. `first_rules` is the score before lookups, which
    the pre-filter uses; `rules` is the score with them. Both, and `evidence`, are null for the
    first two routes.
    """
    names = d.select(clean_name(F.col("domain")).alias("domain")).distinct()
    n = with_name_keys(names, tables.index)
    n = blocked_apex_join(n, tables.classifications)
    n = popularity_allow(n, tables.popular, tables.threats)
    n = n.withColumn("provider", outside_provider())
    # Brand search and the join of its result both read the names: they are made once.
    n = written(n, new_folder(n.sparkSession, "routed"))
    open_names = ~F.col("apex_blocked") & ~F.col("popular_allowed")
    n = with_brand_match(lexical_features(n, params), tables.brands, params, only=open_names)
    n = with_rules(n, params, provider=F.col("provider"), name="first_rules")
    n = rule_prefilter(n, params, "first_rules")
    route = (F.when(F.col("apex_blocked"), "SUBDOMAIN_BLOCK")
             .when(F.col("popular_allowed"), "POPULAR")
             .when(F.col("prefiltered"), "PREFILTER").otherwise("SCORE"))
    n = n.withColumn("route", route).drop("apex_blocked", "popular_allowed", "prefiltered")
    to_model = F.col("route") == "SCORE"
    n = enrich_age(n, tables.registrations, as_of, only=to_model)
    n = enrich_asn(n, tables.domain_asn, tables.bad_asns, as_of, params)
    if params.use_tls and tables.domain_tls is not None:
        n = enrich_tls(n, tables.domain_tls, as_of, params)
    else:
        n = n.withColumn("tls", F.lit(None).cast(_NO_TLS))
    n = n.withColumns({"asn": F.when(to_model, F.col("asn")),
                       "asn_flagged": to_model & F.col("asn_flagged"),
                       "tls": F.when(to_model, F.col("tls"))})
    n = with_rules(n, params, provider=F.col("provider"), asn=F.col("asn"),
                   asn_flagged=F.col("asn_flagged"), tls="tls", age_days=F.col("age_days"))
    n = evidence(n)
    scored = F.col("route").isin("PREFILTER", "SCORE")
    return n.withColumns({c: F.when(scored, F.col(c)) for c in ("first_rules", "rules", "evidence")})


def model_requests(decided: DataFrame) -> DataFrame:
    """Prompts for the names of route SCORE."""
    return scoring_requests(decided.filter("route = 'SCORE'"))


def decided_verdicts(decided: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Verdict rows of routes POPULAR and PREFILTER. SUBDOMAIN_BLOCK writes none."""
    popular = F.col("route") == "POPULAR"
    reason = F.when(popular, F.concat(
        F.lit("Popularity allowlist: apex "), F.col("apex"), F.lit(" rank="),
        F.col("rank").cast("string"))).otherwise(F.concat(
            F.lit("Rule pre-filter: score="), F.col("first_rules.rule_score").cast("string"),
            F.lit(f" below threshold={params.prefilter_limit}")))
    d = decided.filter(F.col("route").isin("POPULAR", "PREFILTER")).select(
        "domain", "route", reason.alias("reason"), *verdict_columns())
    # A popular name is let through before its features are looked at.
    features = [c for c in d.columns if c not in ("domain", "route", "reason")]
    return d.select("domain", F.lit("SAFE").alias("category"), F.lit(1.0).alias("confidence"),
                    "reason", F.lit(False).alias("blocked"),
                    *[F.when(F.col("route") == "PREFILTER", F.col(c)).alias(c) for c in features])


def subdomain_blocks(decided: DataFrame) -> DataFrame:
    """(domain, comment) of route SUBDOMAIN_BLOCK."""
    return decided.filter("route = 'SUBDOMAIN_BLOCK'").select(
        "domain", subdomain_comment().alias("comment"))


def block_names(blocks: DataFrame, denylist: DataFrame, mapping: DataFrame, group: int, policy: TailIndex,
                as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Denylist and mapping after (domain, comment) rows were blocked; see block_comments and
    subdomain_blocks. Names that the policy protects, or that are listed already, add no row."""
    added = written(denylist_add(denylist, blocks, policy, as_of), new_folder(denylist.sparkSession, "blocked"))
    denylist = denylist.unionByName(added.select(*denylist.columns))
    return denylist, group_assign(mapping, listed_ids(denylist, blocks), group)
