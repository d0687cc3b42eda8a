"""Balanced sharding by label propagation, with DataFrame operations only.

Documents with equal texts are linked. Every linked document starts in a shard by its hash; in
each round, documents move to the shard where most of their neighbours are, in exchange for
others that move the other way, or as far as that shard's quota has room. Neighbours of a group that share a shard are interchangeable, so the
state is a count per group and shard, and a move is a number; a group of any size is at most as
many rows as there are shards. Documents without neighbours then fill the shards up, so that
row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from domainsieve.llm.common import ROWS_PER_BUCKET, Steps, buckets_for, hot_join, ranked

SHARDS = 24
# Most rounds; in practice fewer than ten move anything.
ROUNDS = 24


def _per_shard(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    got = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _before(rows: DataFrame, by: list[str], order: list[str], buckets: int) -> DataFrame:
    """rows with `start`: the sum of n over the rows before with the same `by`, in hash order.

    Sums run inside (by, hash bucket of key); bucket totals are at most shards ** 2 * buckets rows.
    """
    r = rows.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    past = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = r.groupBy(*by, "_b").agg(F.sum("n").alias("n")).select(
        *by, "_b", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (r.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, [*by, "_b"])
            .withColumn("start", F.col("_in") + F.col("_off")).drop("_b", "_in", "_off"))


def _circle(left: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Moves that lead from a shard back to it, if there are any."""
    after: dict[int, list[int]] = {}
    for (a, b), n in sorted(left.items()):
        if n:
            after.setdefault(a, []).append(b)
    done: set[int] = set()
    for first in after:
        path, place = [first], {first: 0}
        while path:
            nexts = after.get(path[-1])
            if not nexts:
                done.add(path[-1])
                del place[path.pop()]
                continue
            b = nexts.pop()
            if b in place:
                ring = [*path[place[b]:], b]
                return list(zip(ring, ring[1:]))
            if b not in done:
                place[b] = len(path)
                path.append(b)
    return []


def accepted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of the wanted moves (from, to) may be made: those of circles, first of two shards and
    then of more, which leave every load as it is, and beyond that what the room of a shard holds."""
    out = {(a, b): min(n, wanted.get((b, a), 0)) for (a, b), n in wanted.items()}
    left = {pair: n - out[pair] for pair, n in wanted.items()}
    while ring := _circle(left):
        n = min(left[pair] for pair in ring)
        for pair in ring:
            left[pair] -= n
            out[pair] += n
    for (a, b), n in sorted(left.items(), key=lambda m: (-m[1], m[0])):
        more = min(n, room[b])
        out[a, b] += more
        room[b] -= more
    return {pair: n for pair, n in out.items() if n}


def propagated(cells: DataFrame, quota: list[int], buckets: int, steps: Steps, rounds: int = ROUNDS) -> DataFrame:
    """cells (key, shard, n) after documents have moved to their neighbours' shards.

    Rounds of two kinds take turns: in one, documents go where most of their neighbours are and
    shards exchange them; in the other, they go to the shard with most of their neighbours among
    those that have room. It ends when neither kind moves anything, or after `rounds`.
    Every move is from a smaller to the largest cell of its key, so none is ever undone.
    """
    shards, idle = len(quota), 0
    loads = _loads(cells, shards)

    def aimed(cells: DataFrame, r: int, room: list[int]) -> DataFrame:
        """cells with `to`, the shard that they want to move to in round r, or null."""
        # Most neighbours first; ties by a hash that changes, so that both ways are wanted.
        weight = F.struct("n", F.xxhash64("key", "shard", F.lit(r)).alias("h"), "shard")
        open_ = F.lit(True) if r % 2 == 0 else _per_shard(room, F.col("shard")) > 0
        best = F.max(F.when(open_, weight)).over(Window.partitionBy("key"))
        return cells.withColumn("best", best).select(
            "key", "shard", "n", F.when(weight < F.col("best"), F.col("best.shard")).alias("to"))

    path = None
    for r in range(rounds):
        room = [max(0, q - x) for q, x in zip(quota, loads)]
        cells, path = steps.replace(aimed(cells, r, room), "cells", path)
        moves = cells.filter("to IS NOT NULL").select("key", "shard", "to", "n")
        # At most shards ** 2 rows.
        wanted = {(m["shard"], m["to"]): m["n"] for m in moves.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        may = accepted(wanted, room)
        cells = cells.drop("to")
        idle = idle + 1 if not may else 0
        if idle == 2:
            break
        if not may:
            continue
        ordered = _before(moves, ["shard", "to"], ["key"], buckets)
        bound = _per_shard([may.get((a, b), 0) for a in range(shards) for b in range(shards)],
                           F.col("shard") * shards + F.col("to"))
        taken = F.greatest(F.lit(0), F.least(F.col("n"), bound - F.col("start")))
        done = ordered.select("key", "shard", "to", taken.alias("n")).filter("n > 0")
        both = F.inline(F.array(F.struct("shard", (-F.col("n")).alias("n")), F.struct(F.col("to").alias("shard"), "n")))
        changed = cells.unionByName(done.select("key", both))
        cells = changed.groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
        for (a, b), n in may.items():
            loads[a] -= n
            loads[b] += n
    return steps.save(cells, "moved")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: counts of shards differ by one at most, and the first shards are the larger
    ones. A null text counts as empty. Rows with equal doc_id and text are interchangeable.
    """
    steps = Steps(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = steps.save(docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key")), "rows")
    total = rows.count()
    buckets = buckets_for(total)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = steps.save(rows.groupBy("key").agg(F.count("*").alias("copies")), "groups")
    several = groups.filter("copies > 1")
    marked = steps.save(hot_join(rows, groups, "key", "copies", total), "marked")
    linked = marked.filter("copies > 1").drop("copies")

    place = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    start = linked.groupBy("key", place.alias("shard")).agg(F.count("*").alias("n"))
    cells = propagated(start, quota, buckets, steps)
    # What a shard holds beyond its quota goes with the documents that have no neighbours.
    fits = F.greatest(F.lit(0), F.least(F.col("n"), _per_shard(quota, F.col("shard")) - F.col("start")))
    held = steps.save(_before(cells, ["shard"], ["key"], buckets).select("key", "shard", fits.alias("n"))
                      .filter("n > 0"), "held")
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("shard"))
    ranges = held.withColumn("upto", upto).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ranges"))
    ranges = steps.save(several.join(ranges, "key", "left"), "ranges")
    numbered = steps.save(ranked(linked, ["key"], ["doc_id"], "nth", buckets), "numbered")
    own = F.element_at(F.filter("ranges", lambda x: F.col("nth") < x.upto), 1)
    placed = steps.save(hot_join(numbered, ranges, "key", "copies", total).select(
        "doc_id", "size", "text_crc32", "copies", F.when(F.size(F.filter("ranges", lambda x: F.col("nth") < x.upto)) > 0,
                                                         own.shard).alias("shard")), "linked")

    # Neighbours that are left over stay side by side, as far as a bucket should hold them.
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("copies") / ROWS_PER_BUCKET))
    free = steps.save(marked.filter("copies = 1").select("doc_id", "size", "text_crc32", F.xxhash64("key").alias("beside"))
                      .unionByName(placed.filter("shard IS NULL").select(
                          "doc_id", "size", "text_crc32", F.xxhash64("text_crc32", "size", part).alias("beside"))), "free")
    loads = _loads(held, shards)
    ends, at = [], 0
    for q, x in zip(quota, loads):
        at += q - x
        ends.append(at)
    numbered = ranked(free, [], ["beside", "text_crc32", "doc_id"], "nth", buckets, broadcast=True, spread=["beside"])
    filled = numbered.select("doc_id", "size", "text_crc32", F.size(F.filter(
        F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("nth"))).alias("shard"))
    every = steps.save(placed.filter("shard IS NOT NULL").drop("copies").unionByName(filled), "placed")
    # Other hash buckets than those that filled the shards, else a shard's rows share one bucket.
    # The offsets are shards * buckets rows.
    return ranked(every, ["shard"], ["text_crc32", "doc_id"], "slot", buckets, broadcast=shards * buckets < 200_000).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir):
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
