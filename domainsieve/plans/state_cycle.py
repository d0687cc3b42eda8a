"""Jobs on a store of state tables: each one is a change of several tables with one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.operators import state as st
from domainsieve.params import DEFAULTS, Params
from domainsieve.sources.sinks import dense_ids
from domainsieve.sources.tables import Change, Store

# The tables of a store: clustered by name, plain, and logs with the column of their time.
CLUSTERED = ("seen_domains", "threats", "latest_verdicts")
LOGS = {"classifications": "classified_at", "sync_log": "synced_at"}
LATEST = ("category", "confidence", "blocked", "classified_at", "id")


def append_verdicts(change: Change, verdicts: DataFrame, as_of: Column) -> None:
    """Verdict rows with a time and ids above those of the log; the last id is kept with the log."""
    start = change.notes("classifications").get("last_id", 0)
    rows = dense_ids(verdicts, "domain", start).withColumn("classified_at", as_of.cast("timestamp"))
    change.append("classifications", rows, "classified_at")
    written = change.read("classifications", after=change.base)
    change.note("classifications", last_id=written.agg(F.max("id")).first()[0] or start)


def refresh_latest(change: Change, buckets: int) -> None:
    """Bring `latest_verdicts` up to date: (domain, category, confidence, blocked, classified_at, id).

    Only folders of the log that came after the last refresh are read. Per name the row with
    the latest time counts, then the highest id, so late rows and repeated refreshes are right.
    """
    notes = change.notes("latest_verdicts")
    new = change.read("classifications", after=notes.get("folded", 0))
    newest = F.max_by(F.struct(*LATEST), F.struct("classified_at", "id"))
    fresh = new.groupBy("domain").agg(newest.alias("f")).select("domain", "f.*")
    if "latest_verdicts" in change.old or "latest_verdicts" in change.new:
        old, new = change.read("latest_verdicts").alias("t"), fresh.alias("u")

        def order(side):
            return F.struct(f"{side}.classified_at", f"{side}.id")

        # An absent row compares as null, which is not true.
        take_new = F.col("t.domain").isNull() | (F.col("u.domain").isNotNull() & (order("u") > order("t")))
        merged = old.join(new, F.col("t.domain") == F.col("u.domain"), "full_outer").select(
            F.coalesce("t.domain", "u.domain").alias("domain"),
            *[F.when(take_new, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in LATEST])
        change.replace("latest_verdicts", merged, "domain", buckets, placed=True)
    else:
        change.replace("latest_verdicts", fresh, "domain", buckets)
    # Rows that this very change appends are folded too; its version must then be the next one.
    own = "classifications" in change.new
    change.pinned = change.pinned or own
    change.note("latest_verdicts", folded=change.base + own)


def expire_cycle(store: Store, as_of: Column, params: Params = DEFAULTS) -> int:
    """Forget names that no feed has named for the expiry time, in all four tables at once."""
    change = store.change()
    out = st.expire_blocks(change.read("threats"), change.read("denylist"), change.read("mapping"), as_of, params)
    buckets = change.old["threats"]["buckets"]
    append_verdicts(change, out["verdicts"], as_of)
    change.replace("denylist", out["denylist"])
    change.replace("mapping", out["mapping"])
    change.replace("threats", out["threats"], "domain", buckets)
    return change.commit()


def retention_cycle(store: Store, as_of: Column, params: Params = DEFAULTS) -> int:
    """Prune the logs by whole day folders, and forget old sightings and verdicts."""
    cutoff, change = st.days_before(as_of, params.retention_days), store.change()
    for name, time_name in LOGS.items():
        if name in change.old:
            change.retain(name, time_name, cutoff)
    for name, time_name in (("seen_domains", "last_seen"), ("latest_verdicts", "classified_at")):
        if name in change.old:
            rows = change.read(name)
            if not rows.filter(F.col(time_name) < cutoff).isEmpty():
                change.replace(name, rows.filter(F.col(time_name) >= cutoff), "domain",
                               change.old[name]["buckets"], placed=True)
    return change.commit()
