"""Admitted events of very common names, by list ranking.

Each event links to the first one of its name that is more than ttl later; what is admitted is the
chain of links from the name's first admissible event. The chain is found without walking it:

1. Events, and for each event the time after which its link may end, are put in one order of
   (name, time) and cut into blocks of some thousands of rows, however they lie in time.
2. A block follows all links that stay inside it. What is left are links from an event whose link
   leaves its block to the last event that the chain reaches in the block it enters.
3. Those links are doubled by joins, and the ones on the chain marked, in log2(blocks) rounds,
   whatever the ttl.
4. The blocks that the chain enters list its events from the entry on.

A task holds one block, which may lie in a very common name or hold thousands of names. A name's
chain enters a block at most once.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from domainsieve.operators.lookup import small_or_shuffled
from domainsieve.sources.workdir import removed, written

# Before all times; and where an event without a time stands, before that.
_START, _NO_TIME = -(2 ** 62), -(2 ** 63)
_EVENT, _PROBE = 0, 1
# Blocks of fewer rows than this are not made beyond the first FEW_BLOCKS: each one is a task and a file.
BLOCK_ROWS = 100_000
FEW_BLOCKS = 64


def _block_count(rows: int, block_rows: int) -> int:
    return max(1, min(-(-rows // block_rows), max(FEW_BLOCKS, -(-rows // BLOCK_ROWS))))


def _blocks(events: DataFrame, start: DataFrame, ttl: int, block_rows: int, folder: str) -> DataFrame:
    """(domain, at, kind, src, block): events at their time, and probes at the time their link starts."""
    events = written(events.distinct(), f"{folder}/events")
    blocks = _block_count(2 * events.count(), block_rows)
    none = F.lit(None).cast("long")
    points = events.select("domain", F.col("t").alias("at"), F.lit(_EVENT).alias("kind"), none.alias("src"))
    probes = events.select("domain", (F.col("t") + ttl).alias("at"), F.lit(_PROBE).alias("kind"), F.col("t").alias("src"))
    first = start.select("domain", F.coalesce(F.col("last") + ttl, F.lit(_START)).alias("at"),
                         F.lit(_PROBE).alias("kind"), none.alias("src"))
    points, probes = (d.withColumn("at", F.coalesce("at", F.lit(_NO_TIME))) for d in (points, probes))
    ordered = points.unionByName(probes).unionByName(first).repartitionByRange(blocks, "domain", "at", "kind")
    return written(ordered.withColumn("block", F.spark_partition_id()), f"{folder}/blocks")


def _later(names: np.ndarray, times: np.ndarray, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the first event of the name `asked` after the time `at`, len(times) where there is none.

    Events are given in order of (names, times).
    """
    n = len(times)
    if not n:
        return np.zeros(len(asked), np.int64)
    kind = np.repeat([_EVENT, _PROBE], [n, len(asked)])
    order = np.lexsort((kind, np.concatenate([times, at]), np.concatenate([names, asked])))
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(order < n)
    found = place[n:]
    return np.where((found < n) & (names[np.minimum(found, n - 1)] == asked), found, n)


_LINKS = "domain string, head boolean, src long, z long, zblock int, to long, after int"


def _links(points: DataFrame, ttl: int) -> DataFrame:
    """Links that enter a block from outside it, and for each block one row from its first event.

    z is the event that the link ends at, `to` the last one of the block that the chain from there
    reaches. Where no event of the block follows, both are null and `after` names the block.
    """
    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        block, = key
        rows = rows.assign(name=pd.factorize(rows["domain"], use_na_sentinel=False)[0]).sort_values(["name", "at"])
        events, probes = rows[rows["kind"] == _EVENT], rows[rows["kind"] == _PROBE]
        names, times = events["name"].to_numpy(), events["at"].to_numpy("int64")
        n = len(times)
        last = _later(names, times, names, times + ttl)
        last = np.where(last < n, last, np.arange(n))
        while n and (last[last] != last).any():
            last = last[last]
        asked, src = probes["name"].to_numpy(), probes["src"].astype("Int64")
        found = _later(names, times, asked, probes["at"].to_numpy("int64"))
        # A link from an event of this block to another one of it was followed above.
        start = times[np.minimum(np.searchsorted(names, asked), n - 1)] if n else np.zeros(len(src), "int64")
        keep = ~(src.ge(start).fillna(False).to_numpy(bool) & (found < n))
        probes, src, found = probes[keep], src[keep], found[keep]
        has = found < n
        at_block = np.where(has, found, 0)
        z = pd.array(times[at_block] if n else np.zeros(len(src), "int64"), "Int64")
        to = pd.array(times[last[at_block]] if n else np.zeros(len(src), "int64"), "Int64")
        z[~has], to[~has] = pd.NA, pd.NA
        out = pd.DataFrame({"domain": probes["domain"].array, "head": False, "src": src.array, "z": z,
                            "zblock": pd.array(np.where(has, block, 0), "Int32"), "to": to,
                            "after": pd.array(np.full(len(src), block), "Int32")})
        out.loc[has, "after"] = pd.NA
        if n:
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            many = len(first)
            heads = pd.DataFrame({"domain": events["domain"].array[first], "head": True,
                                  "src": pd.array([pd.NA] * many, "Int64"), "z": pd.array(times[first], "Int64"),
                                  "zblock": pd.array(np.full(many, block), "Int32"),
                                  "to": pd.array(times[last[first]], "Int64"), "after": pd.array([pd.NA] * many, "Int32")})
            out = heads if out.empty else pd.concat([out, heads], ignore_index=True)
        return out

    return points.groupBy("block").applyInPandas(run, _LINKS)


def _closed(links: DataFrame) -> DataFrame:
    """(domain, src, z, zblock, to): links that found no event in their block go on to the first
    event of the name's next block; those at the name's end are dropped."""
    heads = links.filter("head").select("domain", F.col("zblock").alias("after"), F.lit(1).alias("is_head"),
                                        F.struct("z", "zblock", "to").alias("first"))
    open_ = links.filter("NOT head AND z IS NULL").select("domain", "src", "after")
    asked = open_.select("domain", "after").distinct().withColumn("is_head", F.lit(0)).withColumn(
        "first", F.lit(None).cast(heads.schema["first"].dataType))
    # One row per block and name and one per block that asks: the number of blocks, twice.
    later = Window.partitionBy("domain").orderBy(F.desc("after"), "is_head").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    follow = (heads.unionByName(asked).withColumn("next", F.last("first", ignorenulls=True).over(later))
              .filter("is_head = 0 AND next IS NOT NULL").select("domain", "after", "next"))
    passed = open_.join(small_or_shuffled(follow), ["domain", "after"]).select("domain", "src", "next.*")
    found = links.filter("NOT head AND z IS NOT NULL").select("domain", "src", "z", "zblock", "to")
    return found.unionByName(passed)


def _marked(links: DataFrame, folder: str) -> DataFrame:
    """(domain, node): the sources of the links on each name's chain, after the first.

    Round k jumps 2^k links at once: what it adds to the marks is as long as all before.
    Many links may end at one event; adaptive execution splits such a key of the doubling join.
    """
    spark, marks = links.sparkSession, f"{folder}/marks"
    written(links.filter("src IS NULL").select("domain", F.col("to").alias("node")), f"{marks}/round=0")
    # Only a link that another one leads to can be on a chain.
    ends = links.select("domain", F.col("to").alias("src")).distinct()
    jumps = written(links.select("domain", "src", "to").join(ends, ["domain", "src"], "left_semi"), f"{folder}/jumps-0")
    k = 0
    while True:
        so_far = spark.read.schema("domain string, node long").parquet(marks)
        new = written(so_far.join(jumps, (so_far["domain"] == jumps["domain"]) & (F.col("node") == F.col("src")))
                      .select(so_far["domain"], F.col("to").alias("node")), f"{folder}/new-{k}")
        if new.isEmpty():
            return so_far
        k += 1
        new.write.parquet(f"{marks}/round={k}")
        on = jumps.select("domain", F.col("src").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(on, ["domain", "to"]).select("domain", "src", F.col("beyond").alias("to")),
                        f"{folder}/jumps-{k}")
        removed(spark, f"{folder}/jumps-{k - 1}")


def admitted_chain(events: DataFrame, start: DataFrame, ttl: int, block_rows: int, folder: str) -> DataFrame:
    """(domain, t) of the admitted ones of events (domain, t in microseconds).

    `start` has one row (domain, last) for each name; last is its latest earlier admission or null.
    """
    points = _blocks(events, start, ttl, block_rows, folder)
    links = written(_closed(written(_links(points, ttl), f"{folder}/pieces")), f"{folder}/links")
    marks = _marked(links, folder).select("domain", F.col("node").alias("src"))
    entries = links.filter("src IS NULL").unionByName(
        links.join(marks, ["domain", "src"]).select(*links.columns))
    entries = written(entries.select("domain", F.col("zblock").alias("block"), "z"), f"{folder}/entries")

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(name=pd.factorize(rows["domain"])[0]).drop_duplicates(["name", "at"]).sort_values(["name", "at"])
        names, times = rows["name"].to_numpy(), rows["at"].to_numpy("int64")
        following, taken = _later(names, times, names, times + ttl).tolist(), []
        for i in np.flatnonzero(times == rows["z"].to_numpy("int64")).tolist():
            while i < len(times):
                taken.append(i)
                i = following[i]
        return pd.DataFrame({"domain": rows["domain"].array[taken], "t": times[taken]})

    entered = points.filter(F.col("kind") == _EVENT).join(small_or_shuffled(entries), ["domain", "block"])
    return entered.groupBy("block").applyInPandas(run, "domain string, t long")
