"""Which queried names are taken up: skip policy, first occurrences, time-to-live admission."""

from __future__ import annotations

import bisect
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from domainsieve.fixed import DEFAULT_FEEDS, NEVER_BLOCK_NAMES, NEVER_BLOCK_SUFFIXES, SERVICE_HOSTS
from domainsieve.functions.literals import literal_table
from domainsieve.operators.chain import admitted_chain
from domainsieve.operators.lookup import BROADCAST_ROWS, fits, small_or_shuffled
from domainsieve.operators.names import LABELS, TailIndex, match_tails, tail_index
from domainsieve.sources.workdir import new_folder, written

# Bits of a policy entry.
_EXACT, _SUFFIX = 1, 2
# Events of one name up to which its history is folded in one row.
FOLD_EVENTS = 100_000
# Tasks over which the events of one hot name are spread.
_SALTS = 64


# -- policy -------------------------------------------------------------------

def policy_index(allowlist: DataFrame, never_names=NEVER_BLOCK_NAMES, upstream=(),
                 depth: int | None = None) -> TailIndex:
    """Index of (entry, is_suffix) rows with the fixed names; `upstream` adds skipped hosts."""
    fixed = literal_table(allowlist.sparkSession, [(n, False) for n in (*never_names, *upstream)],
                          "entry string, is_suffix boolean")
    entries = allowlist.select("entry", "is_suffix").unionByName(fixed).select(
        F.regexp_replace("entry", r"^\.", "").alias("base"),
        F.when(F.col("is_suffix"), _SUFFIX).otherwise(_EXACT).alias("mask"))
    return tail_index(entries, depth)


def with_never_block(d: DataFrame, policy: TailIndex) -> DataFrame:
    """Add `never_block`: an exact entry, or below a suffix entry. No shuffle."""
    tests = [f"domain LIKE '%{s}'" for s in NEVER_BLOCK_SUFFIXES]
    for k in range(1, policy.depth + 1):
        tests.append(f"coalesce(_p{k} & {_EXACT} <> 0 AND {LABELS} = {k}, false)")
        tests.append(f"coalesce(_p{k} & {_SUFFIX} <> 0 AND {LABELS} > {k}, false)")
    keep = [f"`{c}`" for c in d.columns]
    return match_tails(d, policy, "_p").selectExpr(*keep, f"({' OR '.join(tests)}) AS never_block")


def skip_policy(d: DataFrame, policy: TailIndex) -> DataFrame:
    """Drop never-block names, and upstream hosts if the policy was built with them."""
    return with_never_block(d, policy).filter(~F.col("never_block")).drop("never_block")


def upstream_hosts(feeds=DEFAULT_FEEDS) -> tuple[str, ...]:
    """Hosts that the service itself asks: fixed ones, and those of the feeds' addresses."""
    hosts = [urlsplit(f.url).hostname for f in feeds if f.url]
    return tuple(dict.fromkeys([*SERVICE_HOSTS, *[h.rstrip(".") for h in hosts if h]]))


def query_policy(allowlist: DataFrame, depth: int | None = None, feeds=DEFAULT_FEEDS) -> TailIndex:
    """Policy of the query path: never-block names and the service's own upstream hosts."""
    return policy_index(allowlist, upstream=upstream_hosts(feeds), depth=depth)


# -- first occurrences --------------------------------------------------------

def distinct_first(d: DataFrame, order: str | None = None) -> DataFrame:
    """One row per name; with `order`, the row that is smallest in it."""
    if order is None:
        return d.dropDuplicates(["domain"])
    rest = [c for c in d.columns if c != "domain"]
    first = d.groupBy("domain").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select("domain", "_first.*")


def unseen(d: DataFrame, seen: DataFrame, as_of, ttl_days: float) -> DataFrame:
    """Names not seen within the time to live. `d` holds distinct names."""
    cutoff = as_of - F.make_dt_interval(secs=F.lit(ttl_days * 86400))
    recent = seen.filter(F.col("last_seen") >= cutoff).select("domain")
    return d.join(recent, "domain", "left_anti")


# -- history ------------------------------------------------------------------

def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def admit_history(events: DataFrame, ttl_days: float, seen: DataFrame | None = None,
                  fold_events: int = FOLD_EVENTS) -> DataFrame:
    """Replay of admissions over (domain, ts): distinct (domain, ts) of the admitted events.

    An event is admitted when nothing was admitted for its name in the last ttl;
    other events do not move that clock. `seen` gives earlier admissions.

    A name with up to `fold_events` events is folded in one row. The events of names with
    more are dealt to blocks of that size and ranked as linked lists, see chain.py.
    """
    ttl = int(ttl_days * 86_400_000_000)
    d = events.select("domain", _micros(F.col("ts")).alias("t"))
    last = None if seen is None else seen.groupBy("domain").agg(
        F.max(_micros(F.col("last_seen"))).alias("last"))
    if fits(d, fold_events):
        return _fold(d, last, ttl)
    folder = new_folder(d.sparkSession, "admission")
    hot = written(d.groupBy("domain").count().filter(F.col("count") > fold_events)
                  .select("domain"), f"{folder}/hot")
    if hot.isEmpty():
        return _fold(d, last, ttl)

    # Hot names are met by (name, salt), which spreads each over many tasks.
    d = d.withColumn("_salt", F.pmod(F.xxhash64("t"), F.lit(_SALTS)))
    keys = small_or_shuffled(_salted(hot), size_of=hot, rows=BROADCAST_ROWS // _SALTS)
    cold = _fold(d.join(keys, ["domain", "_salt"], "left_anti"), last, ttl)
    hot_events = d.join(keys, ["domain", "_salt"], "left_semi").select("domain", "t")
    start = hot.withColumn("last", F.lit(None).cast("long")) if last is None else (
        hot.join(last, "domain", "left"))
    ranked = admitted_chain(hot_events, start, ttl, fold_events, folder)
    return cold.unionByName(ranked.select("domain", F.timestamp_micros("t").alias("ts")))


def _salted(d: DataFrame) -> DataFrame:
    salts = F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))
    return d.withColumn("_salt", F.explode(salts))


def _fold(d: DataFrame, last: DataFrame | None, ttl: int) -> DataFrame:
    times = d.groupBy("domain").agg(F.array_sort(F.collect_list("t")).alias("times"))
    if last is None:
        times = times.withColumn("last", F.lit(None).cast("long"))
    else:
        times = times.join(last, "domain", "left")

    return times.select("domain", F.explode(_admitted(ttl)("times", "last")).alias("t")).select(
        "domain", F.timestamp_micros("t").alias("ts"))


def _admitted(ttl: int):
    """Admitted ones of a name's sorted times, by a search for the next late enough time."""
    @F.pandas_udf("array<long>")
    def admitted(times: pd.Series, last: pd.Series) -> pd.Series:
        out = []
        for row, before in zip(times, last):
            at = 0 if pd.isna(before) else bisect.bisect_right(row, before + ttl)
            taken = []
            while at < len(row):
                taken.append(row[at])
                at = bisect.bisect_right(row, row[at] + ttl, at + 1)
            out.append(taken)
        return pd.Series(out)

    return admitted
