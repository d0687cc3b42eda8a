"""From landed feeds to verdicts, denylist rows and the sync log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.operators.brands import BrandIndex, with_brand_match
from domainsieve.operators.denylist import denylist_add, group_assign, listed_ids
from domainsieve.operators.features import lexical_features, with_rules
from domainsieve.operators.feeds import (
    feed_comment, feed_table, first_feed_wins, hosted_content_block, is_trusted, new_feed_domains,
    popular_apex_guard, provider_self_guard, sync_summary, with_outcome)
from domainsieve.operators.names import TailIndex, with_name_keys
from domainsieve.operators.queries import popularity_rank
from domainsieve.operators.state import expire_blocks, touch, upsert
from domainsieve.operators.verdicts import verdict_columns
from domainsieve.params import DEFAULTS, Params
from domainsieve.sources.workdir import new_folder, written


@dataclass(frozen=True)
class FeedTables:
    """What the feed path reads."""

    index: TailIndex
    brands: BrandIndex
    threats: DataFrame
    popular: DataFrame


def verify_feed(listed: DataFrame, feeds, tables: FeedTables,
                params: Params = DEFAULTS) -> DataFrame:
    """One row per new name with its feed, outcome and verdict.

    `listed` holds (feed, domain) rows; `feeds` is the ordered list of settings.
    """
    table = feed_table(listed.sparkSession, feeds)
    new = first_feed_wins(new_feed_domains(listed, tables.threats), table)
    n = popularity_rank(with_name_keys(new, tables.index), tables.popular, "apex")
    # Brand search and the join of its result both read the names: they are made once.
    n = written(n, new_folder(n.sparkSession, "new-names"))
    to_score = ~provider_self_guard() & ~hosted_content_block() & ~popular_apex_guard()
    n = with_brand_match(lexical_features(n, params), tables.brands, params, only=to_score)
    n = with_rules(n, params, feed_hit=is_trusted(F.col("feed")))
    return with_outcome(n, params)


def feed_verdicts(verified: DataFrame) -> DataFrame:
    """Verdict rows; only scored outcomes carry features."""
    d = verified.select("domain", "category", "confidence", "reason", "blocked", "outcome",
                        *verdict_columns())
    kept = ("domain", "category", "confidence", "reason", "blocked")
    features = [c for c in d.columns if c not in (*kept, "outcome")]
    scored = F.col("outcome").isin("SCORE_BLOCK", "SCORE_SKIP")
    return d.select(*kept, *[F.when(scored, F.col(c)).alias(c) for c in features])


def known_names(verified: DataFrame, as_of: Column) -> DataFrame:
    """Threat rows of all verified names, blocked or not."""
    at = as_of.cast("timestamp")
    return verified.select("domain", F.col("feed").alias("feed_name"), at.alias("added_at"),
                           at.alias("last_seen"))


def feed_cycle(listed: DataFrame, feeds, tables: FeedTables, denylist: DataFrame,
               mapping: DataFrame, group: int, policy: TailIndex, as_of: Column,
               params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """One sync cycle: all tables after it, and the rows to append to the logs.

    The verified names are written once to the shared folder and read by every
    result, so features are computed once.
    """
    spark = listed.sparkSession
    folder = new_folder(spark, "feed-cycle")
    table = feed_table(spark, feeds)
    verified = written(verify_feed(listed, feeds, tables, params), f"{folder}/verified")
    threats = upsert(touch(tables.threats, listed, as_of), known_names(verified, as_of),
                     keep_first=("feed_name", "added_at"))
    blocks = verified.filter("blocked").select("domain", feed_comment().alias("comment"))
    added = written(denylist_add(denylist, blocks, policy, as_of), f"{folder}/added")
    denylist = denylist.unionByName(added.select(*denylist.columns))
    mapping = group_assign(mapping, listed_ids(denylist, blocks), group)
    gone = expire_blocks(threats, denylist, mapping, as_of, params)
    summary = sync_summary(verified, listed, added, table)
    return {
        "verified": verified, "threats": gone["threats"], "denylist": gone["denylist"],
        "mapping": gone["mapping"], "added": added,
        "verdicts": feed_verdicts(verified).unionByName(gone["verdicts"], allowMissingColumns=True),
        "summary": summary,
        "sync_log": summary.select(F.col("feed").alias("feed_name"), "domains_added",
                                   "domains_skipped", as_of.cast("timestamp").alias("synced_at")),
    }
