"""Helpers of the operators: stored steps, numbering, hot-key joins, connected components."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from domainsieve.sources.workdir import new_folder, removed, written

# A key with more than one in HOT_SHARE of the rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000
# Rows that one task of a numbering step should sort.
ROWS_PER_BUCKET = 200_000


class Steps:
    """Tables of one operator run in the shared folder, dropped by name when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, new_folder(spark, name), 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, self.path(name))

    def replace(self, df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
        """Store df, which may read the table at `old`; then delete that table."""
        path = self.path(name)
        table = written(df, path)
        if old:
            removed(self.spark, old)
        return table, path


    def cluster(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """Store df hash-distributed by `key`. Joins on the key read it where it lies and shuffle
        only their other side, if there are at least as many buckets as shuffle partitions."""
        name = f"clustered_{uuid.uuid4().hex}"
        (df.repartition(buckets, key).write.bucketBy(buckets, key)
         .option("path", self.path("clustered")).saveAsTable(name))
        return self.spark.table(name)


def buckets_for(rows: int, least: int = 16) -> int:
    return max(least, -(-rows // ROWS_PER_BUCKET))


def ranked(df: DataFrame, keys: Sequence[str], tie: Sequence[str], name: str, buckets: int,
           broadcast: bool = False, spread: Sequence[str] = ()) -> DataFrame:
    """Add `name`: 0, 1, … within `keys`, in the order of (hash bucket of `spread` or tie, tie).

    Rows are numbered inside (keys, bucket) and shifted by the sizes of the buckets before, so
    no task needs all rows of a key. df is read twice; give a stored table. `broadcast` may be
    set where keys times buckets has a small bound.
    """
    keys = list(keys)
    d = df.withColumn("_b", F.pmod(F.xxhash64(*(spread or tie)), F.lit(buckets)).cast("int"))
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = d.groupBy(*keys, "_b").count().select(
        *keys, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*tie))
    numbered = d.withColumn("_rn", inside)
    if broadcast:
        offsets = F.broadcast(offsets)
    on = F.lit(True)
    o = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_b").alias("_ob"), "_off")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = numbered.join(o, on & (F.col("_b") == F.col("_ob")))
    return joined.select(*df.columns, (F.col("_rn") - 1 + F.col("_off")).cast("long").alias(name))


def hot_join(d: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of d with `table`, unique in `key`, whose `count` says how many rows of d match.

    The keys that hold over one in HOT_SHARE of `total` rows, at most HOT_SHARE of them, are
    answered by a broadcast; only the others are shuffled. d is read twice; give a stored table.
    """
    hot = table.filter(F.col(count) * HOT_SHARE > F.lit(total))
    cold = table.filter(F.col(count) * HOT_SHARE <= F.lit(total))
    first = d.join(F.broadcast(hot), key)
    rest = d.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return first.unionByName(rest)


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(id, label): the smallest id that each node of `edges` (a, b) reaches.

    Each round hooks every node to its smallest neighbour if that is smaller, shortens the
    hooks to their roots by repeated self joins, and rewrites the edges to the roots. All
    steps are joins on stored tables; the edges left shrink from round to round.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(
        F.col("a") != F.col("b")).distinct()
    e, e_path = steps.replace(e, "edges", None)
    kind = e.schema["a"].dataType.simpleString()
    labels, l_path = None, None
    while e.limit(1).count():
        # Each b has a smaller neighbour, so it hooks; an id that is in no b is a root.
        p = e.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("p"))
        p, p_path = steps.replace(p, "hooks", None)
        while True:
            q = p.select(F.col("id").alias("p"), F.col("p").alias("up"))
            p2 = p.join(q, "p", "left").select(
                "id", F.coalesce("up", "p").alias("p"), F.col("up").isNotNull().alias("moved"))
            p2, path = steps.replace(p2, "hooks", None)
            moved = p2.filter("moved").limit(1).count()
            p = p2.select("id", "p")
            removed(spark, p_path)
            p_path = path
            if not moved:
                break
        if labels is None:
            new = p.select("id", F.col("p").alias("label"))
        else:
            q = p.select(F.col("id").alias("label"), F.col("p").alias("up"))
            seen = labels.join(q, "label", "left").select("id", F.coalesce("up", "label").alias("label"))
            fresh = p.join(labels.select("id"), "id", "left_anti").select("id", F.col("p").alias("label"))
            new = seen.unionByName(fresh)
        labels, l_path = steps.replace(new, "labels", l_path)
        pa = p.select(F.col("id").alias("a"), F.col("p").alias("pa"))
        pb = p.select(F.col("id").alias("b"), F.col("p").alias("pb"))
        moved_to = (e.join(pa, "a", "left").join(pb, "b", "left")
                    .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y")))
        e, e_path = steps.replace(
            moved_to.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter(F.col("a") != F.col("b")).distinct(), "edges", e_path)
        removed(spark, p_path)
    if labels is None:
        return spark.createDataFrame([], f"id {kind}, label {kind}")
    return labels


def text_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python in batches of fewer rows than the default of 10,000: some 2 MB of texts
    of usual length, of which the JVM and the worker each hold a copy or two outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)


_kept: list[tuple[str, Callable]] = []


def kept(group: str, most: int) -> Callable:
    """A cache of `most` results for what a worker keeps from task to task, see released()."""
    def wrap(f: Callable) -> Callable:
        cached = functools.lru_cache(maxsize=most)(f)
        _kept.append((group, cached))
        return cached
    return wrap


@functools.cache
def _trim() -> Callable[[int], int]:
    # Where the C library has no such call, nothing is to be done.
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda n: 0)


def released(group: str = "") -> None:
    """Give a worker's memory back to the system, before and between batches: what tasks of other
    groups have kept, and what has been freed."""
    for other, cached in _kept:
        if other != group:
            cached.cache_clear()
    pa.default_memory_pool().release_unused()
    _trim()(0)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def with_fields(df: DataFrame, more: dict[str, str]) -> T.StructType:
    """The schema of df with further columns, for functions over Arrow batches."""
    return T.StructType([*df.schema.fields, *[
        T.StructField(name, T.StructType.fromDDL(f"x {kind}")["x"].dataType) for name, kind in more.items()]])
