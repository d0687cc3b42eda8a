"""MinHash near-deduplication with circulant signatures.

Two permutations make a whole signature: the first shuffles the shingles' places, the second
gives values, and coordinate k is the smallest value after shifting the second by k places.
Bands of the signature bring candidates together; every link is confirmed on full sets.

Texts with equal sets are one class and are compared once. Within a bucket of a band, every
class is compared with the bucket's first class, never with all others. Where a bucket still
holds several components after that, its rows outside the largest one are compared with all of
the bucket, block against block, so that no link is lost and no task or table holds all pairs.
Blocks are measured in shingles, and inside one only sets that share a rare shingle are counted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from domainsieve.llm.common import Steps, components, hot_join, kept, released, text_batches
from domainsieve.llm.shingles import mixed, sets_of, with_sets
from domainsieve.operators.lookup import small_or_shuffled
from domainsieve.sources.workdir import removed

PLACES = 1 << 20
# The chance that two texts just at the threshold share no band.
MISS = 1e-6
MOST_BANDS = 36
# Shingles on each side of a block comparison: 8 MB.
BLOCK = 1 << 20
# Buckets of up to this many classes are compared as pairs.
FEW = 16
# Shingles that are looked up at a time.
CHUNK = 4096
# Band keys that a task gathers before it deals them out, keys of a slot, and keys that one task counts.
DEALT, SLOT_KEYS, TASK_KEYS = 1 << 21, 1 << 15, 1 << 18


def band_shape(percent: int, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the longest bands of which at most `most` reach the chance MISS."""
    t, best = percent / 100, None
    for rows in range(1, 13):
        bands = math.ceil(math.log(MISS) / math.log(1 - t ** rows)) if t < 1 else 1
        if bands <= most or best is None:
            best = (bands, rows)
    return best


@kept("shingles", 2)
def permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and all windows of `size` values of the second, wrapped round."""
    first = np.random.default_rng(11).permutation(PLACES).astype(np.int32)
    second = np.random.default_rng(23).permutation(PLACES).astype(np.int32)
    return first, np.lib.stride_tricks.sliding_window_view(np.append(second, second[:size]), size)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    first, shifted = permutations(size)
    at = first[(shingles >> np.uint64(44)).astype(np.int64)]
    out = shifted[at[:CHUNK]].min(axis=0)
    for k in range(CHUNK, len(at), CHUNK):
        np.minimum(out, shifted[at[k:k + CHUNK]].min(axis=0), out=out)
    return out


def signatures(values: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A row per text, zero where the set is empty; texts are taken together, CHUNK shingles at a time."""
    out = np.zeros((len(starts) - 1, size), np.int32)
    first, shifted = permutations(size)
    full = np.flatnonzero(np.diff(starts))
    k = 0
    while k < len(full):
        begin = starts[full[k]]
        end = max(k + 1, int(np.searchsorted(starts[full + 1], begin + CHUNK, "right")))
        rows = full[k:end]
        if len(rows) == 1:
            out[rows[0]] = signature(values[begin:starts[rows[0] + 1]], size)
        else:
            at = first[(values[begin:starts[rows[-1] + 1]] >> np.uint64(44)).astype(np.int64)]
            out[rows] = np.minimum.reduceat(shifted[at], starts[rows] - begin, axis=0)
        k = end
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = mixed(np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1)))
    for k in range(rows):
        key = mixed(key ^ (parts[:, :, k] + np.uint64(0x632BE59BD9B4E019)))
    return key.view(np.int64)


def signed(items: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, n, digest of the set, band keys) of items (id, text); no digest for empty sets."""
    def run(batches):
        released("shingles")
        for batch in batches:
            at = 0
            for values, starts in sets_of(batch.column(1), words):
                n = np.diff(starts)
                keys = band_keys(signatures(values, starts, bands * rows), bands, rows)
                raw, ends = values.tobytes(), (starts * 8).tolist()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None
                          for a, b in zip(ends, ends[1:])]
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(n)), pa.array(n.astype(np.int32)), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["id", "n", "digest", "bands"])
                at += len(n)
            released("shingles")

    text_batches(items.sparkSession)
    return items.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "id long, n int, digest binary, bands array<long>")


def _dealt(reps: DataFrame, slots: int) -> DataFrame:
    """(slot, keys, ids): the band keys of reps (id, bands) and whose they are, many to a row. Equal
    keys have the same slot."""
    def run(batches):
        keys, ids, held = [], [], 0

        def sent():
            k, i = np.concatenate(keys), np.concatenate(ids)
            slot = (k.view(np.uint64) >> np.uint64(20)) % np.uint64(slots)
            order = np.argsort(slot, kind="stable")
            counts = np.bincount(slot.astype(np.int64), minlength=slots)
            full = np.flatnonzero(counts)
            ends = pa.array(np.append(0, np.cumsum(counts[full])).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(k[order])),
                 pa.ListArray.from_arrays(ends, pa.array(i[order]))], names=["slot", "keys", "ids"])

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy()
            keys.append(flat)
            ids.append(np.repeat(batch.column(0).to_numpy(), len(flat) // max(1, len(batch))))
            held += len(flat)
            if held >= DEALT:
                yield sent()
                keys, ids, held = [], [], 0
        if held:
            yield sent()

    return reps.mapInArrow(run, "slot int, keys array<long>, ids array<long>")


def bucket_members(reps: DataFrame, count: int, steps: Steps) -> DataFrame:
    """(key, id, first, m) of the bands that several of reps (id, bands) share: the smallest id of the
    bucket and its size.

    Keys are shuffled once, packed in arrays by slot, a third smaller than as rows. All of a slot is
    in one partition, where buckets are counted and met again without another shuffle; a partition
    has some TASK_KEYS keys.
    """
    spark = reps.sparkSession
    usual, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * MOST_BANDS // TASK_KEYS)
    slots = max(4 * usual, -(-count * MOST_BANDS // SLOT_KEYS))
    by = (parts, "slot") if parts > usual else ("slot",)
    packed = _dealt(reps, slots).repartition(*by).select("slot", F.explode(F.arrays_zip("keys", "ids")).alias("e"))
    keyed = packed.select("slot", F.col("e.keys").alias("key"), F.col("e.ids").alias("id"))
    buckets = keyed.groupBy("slot", "key").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1")
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    # Both sides lie by slot, one of the two join keys; Spark is to take that as good.
    spark.conf.set(name, "false")
    try:
        return steps.save(keyed.join(buckets.hint("shuffle_hash"), ["slot", "key"]).select("key", "id", "first", "m"), "members")
    finally:
        spark.conf.set(name, before)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets share at least percent / 100 of their union."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    shared = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b").filter(near)
            .filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b"))


def _shared(x: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values of x each of n sets has; flat holds their values in order, owner whose they are."""
    lo, hi = np.searchsorted(flat, x), np.searchsorted(flat, x, "right")
    many = hi - lo
    at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
    return np.bincount(owner[at], minlength=n)


def _by_value(flat: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(flat, kind="stable")
    return flat[order], owner[order]


def _block_links(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between rows marked `rest` and all rows of a block pair that join components.

    Two linked sets of n values share one of their n - ceil(percent n / 100) + 1 values that
    are rarest in the block, so only sets that share such a one are counted through.
    """
    ids, comps = pdf["id"].to_numpy(), pdf["comp"].tolist()
    sets = [np.asarray(s, np.int64) for s in pdf["set"]]
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, which, often = np.unique(values, return_inverse=True, return_counts=True)
    rarest = np.lexsort((values, often[which], owner))
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    early = rarest[place < (size - -(-percent * size // 100) + 1)[owner]]
    # lexsort keeps owners together, so place counts within each set in its new order.
    first, first_owner = _by_value(values[early], owner[early])
    starts = np.append(0, np.cumsum(np.bincount(owner[early], minlength=len(sets))))
    flat, flat_owner = _by_value(values, owner)
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    out = []
    for x in np.flatnonzero(pdf["rest"].to_numpy()):
        found = np.flatnonzero(_shared(values[early[starts[x]:starts[x + 1]]], first, first_owner, len(sets)))
        own = root(comps[x])
        found = np.array([y for y in found.tolist() if comps[y] != own and root(comps[y]) != own], np.int64)
        if len(found) > FEW:
            shared = _shared(sets[x], flat, flat_owner, len(sets))[found]
        else:
            shared = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in found], np.int64)
        for y in found[100 * shared >= percent * (size[x] + size[found] - shared)].tolist():
            a, b = root(comps[x]), root(comps[y])
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(ids[x]), int(ids[y])))
    return out


def rest_links(members: DataFrame, sets: DataFrame, percent: int, steps: Steps) -> DataFrame | None:
    """Links inside buckets (key, id, comp) that hold several components; None if there are none.

    Buckets with the same members are looked at once. A bucket's members outside its largest
    component are compared with all of it, in blocks of about BLOCK shingles on either side. A
    member goes to as many blocks as the others fill: to one, below BLOCK.
    """
    weight = steps.save(members.join(sets.select("id", F.col("n").cast("long").alias("w")), "id"), "weighted")
    sizes = weight.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.sum(
        F.xxhash64("id").cast("decimal(20,0)")).alias("h"))
    buckets = sizes.groupBy("key").agg(
        F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("h").alias("h"),
        F.max(F.struct("n", "comp", "w")).alias("main")).filter("comps > 1 AND n > 2")
    first = buckets.groupBy("n", "h").agg(F.min(F.struct("key", "main", "w")).alias("f")).select(
        "f.key", F.col("f.main.comp").alias("main"), "n", F.col("f.w").alias("w"), F.col("f.main.w").alias("w_main"))
    open_ = steps.save(first, "open-buckets")
    if not open_.limit(1).count():
        return None
    # Buckets of a few rows: their pairs across components, many buckets in one join.
    small = members.join(open_.filter(F.col("n") <= FEW).select("key"), "key")
    other = small.select("key", F.col("id").alias("b"), F.col("comp").alias("comp_b"))
    pairs = small.select("key", F.col("id").alias("a"), "comp").join(other, "key").filter(
        "a < b AND comp <> comp_b").select("a", "b").distinct()
    few = star_links(pairs, sets, percent)
    open_ = open_.filter(F.col("n") > FEW)
    blocks = F.ceil(F.col("w") / BLOCK)
    rests = F.greatest(F.ceil((F.col("w") - F.col("w_main")) / BLOCK), F.lit(1))
    rows = members.join(open_, "key").select(
        "key", "id", "comp", (F.col("comp") != F.col("main")).alias("out"), blocks.alias("blocks"), rests.alias("rests"))
    place = F.xxhash64("id")
    every = rows.select("key", "id", "comp", F.lit(False).alias("rest"), F.pmod(place, "blocks").alias("i"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("j"))
    outside = rows.filter("out").select(
        "key", "id", "comp", F.lit(True).alias("rest"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), F.pmod(place, "rests").alias("j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(pdf, percent), columns=["a", "b"], dtype="int64")

    asked = every.unionByName(outside).join(sets.select("id", "set"), "id")
    many = asked.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")
    return few.unionByName(many).distinct()


def near_groups(items: DataFrame, words: int, percent: int, steps: Steps,
                shape: tuple[int, int] | None = None) -> DataFrame:
    """(id, n, component) per row of items (id, text): the smallest id reachable by links.

    Rows with a null id or no words link with nothing (component = id). Rows that share an id
    are one node, so they share a component.
    """
    bands, rows = shape or band_shape(percent)
    banded, path = steps.replace(signed(items, words, bands, rows), "signatures", None)

    def sets_of_ids(asked: DataFrame) -> DataFrame:
        return (with_sets(items.join(small_or_shuffled(asked), "id", "left_semi"), words)
                .filter("n > 0").dropDuplicates(["id", "n", "set"]))

    return grouped(banded, path, sets_of_ids, percent, steps)


def grouped(banded: DataFrame, path: str, sets_of_ids: Callable[[DataFrame], DataFrame], percent: int,
            steps: Steps) -> DataFrame:
    """near_groups() of signed rows, stored at `path` and deleted here; sets_of_ids gives the
    (id, n, set) of the ids that are asked for."""
    sig = steps.save(banded.select("id", "n", "digest"), "digests")
    linked = sig.filter("n > 0 AND id IS NOT NULL")
    classes = steps.save(linked.groupBy("digest").agg(F.min("id").alias("cid"), F.count("*").alias("rows")), "classes")
    reps = banded.filter("n > 0").join(classes.select(F.col("cid").alias("id")), "id", "left_semi")
    members = bucket_members(reps.select("id", "bands"), classes.count(), steps)
    removed(banded.sparkSession, path)
    pairs = steps.save(members.filter("id <> first").select(
        F.col("id").alias("a"), F.col("first").alias("b")).distinct(), "pairs")
    asked = steps.save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "asked")
    sets = steps.save(sets_of_ids(asked), "sets")
    links = steps.save(star_links(pairs, sets, percent), "links")
    labels = components(links, steps)
    placed = members.filter("m > 2").join(labels, "id", "left").select(
        "key", "id", F.coalesce("label", "id").alias("comp"))
    more = rest_links(steps.save(placed, "placed"), sets, percent, steps)
    if more is not None:
        more = steps.save(more, "more-links")
        if more.limit(1).count():
            labels = components(links.unionByName(more), steps)
    of_class = steps.save(classes.join(labels, classes.cid == labels.id, "left").select(
        "digest", "rows", F.coalesce("label", "cid").alias("component")), "components")
    total = linked.count()
    joined = hot_join(linked.select("id", "n", "digest"), of_class, "digest", "rows", total)
    alone = sig.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return joined.select("id", "n", "component").unionByName(alone)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose shingle sets share at least percent / 100 of their union;
    component_id is the smallest doc_id reachable; that document is kept. Null texts, and texts
    without words, link with nothing and are kept, as are rows without a doc_id.
    """
    steps = Steps(docs.sparkSession, "minhash")
    items = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return near_groups(items, words, percent, steps).select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its near-duplicate group, columns as they
    are. Rows without doc_id stay; rows that share a doc_id are one document and stay or go
    together."""
    steps = Steps(docs.sparkSession, "minhash-distinct")
    groups = near_duplicates(docs, words, percent)
    gone = steps.save(groups.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small_or_shuffled(gone), docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def op3_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
