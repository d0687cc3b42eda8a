"""State tables: upserts, latest rows, touch, expiry, retention, freshness, schema upgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.fixed import JOB_INTERVALS
from domainsieve.functions.literals import literal_table
from domainsieve.params import DEFAULTS, Params
from domainsieve.sources.sinks import utc_day

VERDICT_SCHEMA = """id long, domain string, category string, confidence double, reason string,
 blocked boolean, classified_at timestamp, entropy double, dga_score double, rule_score int,
 brand string, brand_confidence double, tld string, tld_risk double, is_punycode boolean"""
THREAT_SCHEMA = "domain string, feed_name string, added_at timestamp, last_seen timestamp"
SEEN_SCHEMA = "domain string, first_seen timestamp, last_seen timestamp"


def days_before(as_of: Column, days: float) -> Column:
    return as_of.cast("timestamp") - F.make_dt_interval(secs=F.lit(days * 86400))


def upsert(target: DataFrame, updates: DataFrame, key: str = "domain",
           keep_first: tuple[str, ...] = ()) -> DataFrame:
    """target with the rows of updates inserted, or put over those with the same key.

    Both sides are unique in key. Columns in keep_first keep the value a row
    already has (first_seen, added_at, feed_name).
    """
    t, u = target.alias("t"), updates.alias("u")
    known, changed = F.col(f"t.{key}").isNotNull(), F.col(f"u.{key}").isNotNull()

    def pick(c):
        if c == key:
            return F.coalesce(f"t.{c}", f"u.{c}")
        if c in keep_first:
            return F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"u.{c}"))
        return F.when(changed, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}"))

    return (t.join(u, F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
            .select(*[pick(c).alias(c) for c in target.columns]))


def latest_verdict(classifications: DataFrame) -> DataFrame:
    """Newest (category, confidence, blocked) per name; the highest id breaks ties."""
    newest = F.max_by(F.struct("category", "confidence", "blocked"),
                      F.struct("classified_at", "id"))
    return classifications.groupBy("domain").agg(newest.alias("_newest")).select("domain", "_newest.*")


def touch(threats: DataFrame, feed: DataFrame, as_of: Column) -> DataFrame:
    """Move last_seen of the names seen again in any feed; unknown names are ignored."""
    again = feed.select(F.col("domain").alias("_d")).distinct()
    return (threats.join(again, F.col("domain") == F.col("_d"), "left")
            .withColumn("last_seen", F.when(F.col("_d").isNotNull(), as_of.cast("timestamp"))
                        .otherwise(F.col("last_seen"))).drop("_d"))


def expired(threats: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Names not seen in a feed for the expiry time; none when that is 0."""
    if params.block_expiry_days <= 0:
        return threats.limit(0).select("domain")
    return threats.filter(F.col("last_seen") < days_before(as_of, params.block_expiry_days)
                          ).select("domain")


def expire_blocks(threats: DataFrame, denylist: DataFrame, mapping: DataFrame, as_of: Column,
                  params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Forget expired names: threat rows and feed-made denylist rows go, and an EXPIRED
    verdict is added so that they no longer count as blocked."""
    from domainsieve.operators.denylist import denylist_remove
    old = expired(threats, as_of, params)
    denylist, mapping = denylist_remove(denylist, mapping, old, "TI:")
    days = f"{params.block_expiry_days:g}"
    verdicts = old.select(
        "domain", F.lit("EXPIRED").alias("category"), F.lit(0.0).alias("confidence"),
        F.lit(f"TI block expired — not re-seen in feeds for {days}d").alias("reason"),
        F.lit(False).alias("blocked"))
    return {"threats": threats.join(old, "domain", "left_anti"), "denylist": denylist,
            "mapping": mapping, "verdicts": verdicts}


# Tables with a retention time, and the column that counts.
RETAINED = {"classifications": "classified_at", "sync_log": "synced_at",
            "seen_domains": "last_seen", "domain_asn": "fetched_at", "domain_tls": "fetched_at"}


def retain(tables: dict[str, DataFrame], as_of: Column,
           params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Drop rows older than the retention time from the tables that have one.

    On a table partitioned by `day`, whole partitions are skipped.
    """
    cutoff = days_before(as_of, params.retention_days)

    def keep(name, df):
        if name not in RETAINED:
            return df
        if "day" in df.columns:
            df = df.filter(F.col("day") >= utc_day(cutoff))
        return df.filter(F.col(RETAINED[name]) >= cutoff)

    return {name: keep(name, df) for name, df in tables.items()}


def hours_since(then: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
            ) / F.lit(3_600_000_000)


def _last_sync(sync_log: DataFrame) -> DataFrame:
    return sync_log.groupBy("feed_name").agg(F.max("synced_at").alias("last"))


def feed_freshness(sync_log: DataFrame, feeds: DataFrame, as_of: Column,
                   params: Params = DEFAULTS) -> DataFrame:
    """(feed_name, hours, status) per feed: never, fresh or stale."""
    hours = hours_since(F.col("last"), as_of)
    return (feeds.select("feed_name").join(_last_sync(sync_log), "feed_name", "left")
            .select("feed_name", hours.alias("hours"),
                    F.when(hours.isNull(), "never").when(hours > params.feed_stale_hours, "stale")
                    .otherwise("fresh").alias("status")))


def job_schedule(spark, jobs=JOB_INTERVALS) -> DataFrame:
    return literal_table(spark, list(jobs), "feed_name string, every_hours double")


def due_jobs(sync_log: DataFrame, schedule: DataFrame, as_of: Column) -> DataFrame:
    """(feed_name, hours) of the jobs that never ran or whose interval is over."""
    hours = hours_since(F.col("last"), as_of)
    return (schedule.join(_last_sync(sync_log), "feed_name", "left")
            .filter(hours.isNull() | (hours >= F.col("every_hours")))
            .select("feed_name", hours.alias("hours")))


def upgrade_schema(df: DataFrame, schema: str, fill: dict[str, str] | None = None) -> DataFrame:
    """df in the given schema: missing columns as null, then filled from another column
    (last_seen from first_seen or added_at)."""
    empty = df.sparkSession.createDataFrame([], schema)
    out = empty.unionByName(df, allowMissingColumns=True).select(*empty.columns)
    for name, source in (fill or {}).items():
        out = out.withColumn(name, F.coalesce(name, source))
    return out


def recent(log: DataFrame, time_name: str, n: int) -> DataFrame:
    """The newest n rows; the highest id first among equals."""
    return log.orderBy(F.col(time_name).desc(), F.col("id").desc()).limit(n)


def recent_verdicts(classifications: DataFrame, n: int = 50) -> DataFrame:
    return recent(classifications, "classified_at", n)


def sync_history(sync_log: DataFrame, n: int = 20) -> DataFrame:
    return recent(sync_log, "synced_at", n)
