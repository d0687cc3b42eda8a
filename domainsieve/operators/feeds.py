"""Decisions on names listed by threat feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.fixed import FEED_REASONS, TRUSTED_FEED
from domainsieve.functions.literals import filled, literal_table
from domainsieve.params import DEFAULTS, Params


def feed_table(spark, feeds) -> DataFrame:
    """Feed settings as a table; feed_order is the order of the list."""
    return literal_table(spark, [(f.name, f.category, i) for i, f in enumerate(feeds)],
                         "feed string, category string, feed_order int")


def new_feed_domains(feed: DataFrame, threats: DataFrame) -> DataFrame:
    """Feed rows whose name is not known yet."""
    return feed.join(threats.select("domain"), "domain", "left_anti")


def first_feed_wins(listed: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per name: the first feed in order that lists it."""
    d = listed.join(F.broadcast(feeds), "feed")
    first = F.min(F.struct("feed_order", "feed", "category")).alias("_first")
    return d.groupBy("domain").agg(first).select("domain", "_first.*")


def is_trusted(feed: Column) -> Column:
    return F.lower(feed) == TRUSTED_FEED


def provider_self_guard() -> Column:
    """The name is a hosting provider itself, or its www name."""
    p = F.col("provider")
    return F.coalesce((F.col("domain") == p) | (F.col("domain") == F.concat(F.lit("www."), p)),
                      F.lit(False))


def hosted_content_block() -> Column:
    """The name lies under a hosting provider."""
    return F.col("provider").isNotNull() & ~provider_self_guard()


def popular_apex_guard() -> Column:
    return F.col("rank").isNotNull()


def feed_score_gate(params: Params = DEFAULTS) -> Column:
    """The trusted feed always passes; others need the rule score."""
    return is_trusted(F.col("feed")) | (F.col("rules.rule_score") >= params.feed_score_limit)


def with_outcome(d: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Add outcome, blocked, confidence and reason. The first matching rule counts.

    Needs domain, apex, provider, rank, feed, category and the rule struct.
    """
    feed, name = F.col("feed"), F.col("domain")
    score, trusted = F.col("rules.rule_score"), is_trusted(F.col("feed"))
    outcome = (F.when(provider_self_guard(), "PROVIDER_SELF")
               .when(hosted_content_block(), "HOSTED_BLOCK")
               .when(popular_apex_guard(), "POPULAR_SKIP")
               .when(feed_score_gate(params), "SCORE_BLOCK").otherwise("SCORE_SKIP"))
    d = d.withColumn("outcome", outcome)
    o = F.col("outcome")
    said = {"PROVIDER_SELF": (name,), "HOSTED_BLOCK": (F.col("provider"),),
            "POPULAR_SKIP": (F.col("apex"), F.col("rank"))}
    reason = filled(FEED_REASONS["SCORED"], feed, score, F.initcap(trusted.cast("string")))
    for kind, parts in said.items():
        reason = F.when(o == kind, filled(FEED_REASONS[kind], feed, *parts)).otherwise(reason)
    scored = F.when(trusted, F.lit(1.0)).otherwise(F.least(score / 100, F.lit(1.0)))
    return d.withColumns({
        "blocked": o.isin("HOSTED_BLOCK", "SCORE_BLOCK"),
        "confidence": F.when(o == "HOSTED_BLOCK", 1.0)
        .when(o.isin("PROVIDER_SELF", "POPULAR_SKIP"), 0.0).otherwise(scored),
        "reason": reason})


def feed_comment() -> Column:
    return F.concat(F.lit("TI:"), F.col("category"), F.lit(":"), F.col("feed"))


def sync_summary(verified: DataFrame, listed: DataFrame, added: DataFrame,
                 feeds: DataFrame) -> DataFrame:
    """Counts per feed: listed, known, verified, blocked on hosts, skipped, added.

    `verified` is the result of verify_feed, `listed` the distinct (feed, domain)
    rows and `added` the new denylist rows.
    """
    def n(*outcomes):
        return F.count_if(F.col("outcome").isin(*outcomes))

    new_rows = added.select("domain", F.lit(True).alias("_added"))
    by_feed = verified.join(new_rows, "domain", "left").groupBy("feed").agg(
        F.count("*").alias("new_names"),
        n("HOSTED_BLOCK", "SCORE_BLOCK").alias("verified"),
        n("HOSTED_BLOCK").alias("hosted_blocks"), n("SCORE_SKIP").alias("score_skipped"),
        n("POPULAR_SKIP").alias("popular_skipped"),
        F.count_if(F.coalesce("_added", F.lit(False))).alias("domains_added"))
    total = listed.groupBy("feed").agg(F.count("*").alias("listed"))
    d = feeds.select("feed").join(total, "feed", "left").join(by_feed, "feed", "left")
    counts = ["listed", "new_names", "verified", "hosted_blocks", "score_skipped",
              "popular_skipped", "domains_added"]
    d = d.select("feed", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return d.withColumn("domains_skipped", F.col("listed") - F.col("new_names")).drop("new_names")
