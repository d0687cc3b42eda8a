"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Senders (runs of rows of one input partition) cut the digests of their texts to short
fingerprints, sort and distinguish them, and send each owner its range as Golomb-Rice code. An
owner answers every sender with one bit per fingerprint: seen elsewhere too, or not. Rows whose
bit is set, or which the sender itself holds twice, are suspects; only their texts are shuffled
and compared byte by byte. A very common text reaches its owner once per sender, not per row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.llm.common import Steps, hot_join, released, text_batches
from domainsieve.operators.lookup import small_or_shuffled

# Rows of one sender, fingerprints of one owner: both bound the memory of a task.
SENDER_ROWS = 1 << 18
OWNER_ROWS = 1 << 19
# Bits of a fingerprint beyond log2 of the row count: about one false suspect in 2^10 rows.
SPARE_BITS = 10
# Fixed value: the characters that do not count.
BLANK = b" \t\n\x0b\x0c\r"


def rice_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Golomb-Rice code of increasing integers: k, unary quotients, k-bit remainders.

    Quotients and remainders are two bit streams, so that both are read without a loop.
    """
    if not len(values):
        return 0, b"", b""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    k = max(0, int(float(gaps.mean()) * 0.69).bit_length() - 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = (gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    q = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8))[:n * k].reshape(n, k).astype(np.uint64)
    low = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.uint64(0)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + low)


def _normalised(texts: pa.Array) -> list[bytes]:
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    return [t.as_py().translate(None, BLANK) for t in raw]


def digest_rows(docs: DataFrame, bits: int, owners: int) -> DataFrame:
    """Rows of kind 0: a digest per document. Rows of kind 1: a sender's message to an owner."""
    schema = ("kind int, doc_id long, sha string, n_cp int, rid long, sender long, owner int, pos int, "
              "own_copy boolean, n int, k int, unary binary, rest binary")

    def block(sender, ids, shas, lens):
        head = np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)
        fp = head >> np.uint64(64 - bits)
        distinct, where, counts = np.unique(fp, return_inverse=True, return_counts=True)
        # Owners hold equal ranges of fingerprints.
        owner_of = (distinct.astype(np.float64) * (owners / 2.0 ** bits)).astype(np.int64)
        owner_of = np.minimum(owner_of, owners - 1)
        first = np.searchsorted(owner_of, np.arange(owners + 1))
        n = len(ids)
        owner = owner_of[where]
        digests = pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(ids, pa.int64()), pa.array([s.hex() for s in shas]),
             pa.array(lens, pa.int32()), pa.array((sender << 20) + np.arange(n)),
             pa.array(np.full(n, sender)), pa.array(owner.astype(np.int32)),
             pa.array((where - first[owner]).astype(np.int32)), pa.array(counts[where] > 1),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
             pa.nulls(n, pa.binary())], names=names)
        sent = [(int(o), int(b - a), *rice_encode(distinct[a:b]))
                for o, a, b in zip(range(owners), first, first[1:]) if b > a]
        m = len(sent)
        o, c, k, u, r = zip(*sent)
        messages = pa.RecordBatch.from_arrays(
            [pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()),
             pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.array(np.full(m, sender)),
             pa.array(o, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.bool_()),
             pa.array(c, pa.int32()), pa.array(k, pa.int32()), pa.array(u, pa.binary()),
             pa.array(r, pa.binary())], names=names)
        return digests, messages

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        released()
        part, blocks = TaskContext.get().partitionId(), 0
        ids, shas, lens = [], [], []
        for batch in batches:
            texts = batch.column(1)
            ids += batch.column(0).to_pylist()
            lens += pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            shas += [hashlib.sha256(t).digest() for t in _normalised(texts)]
            if len(ids) >= SENDER_ROWS:
                yield from block((part << 20) + blocks, ids, shas, lens)
                ids, shas, lens, blocks = [], [], [], blocks + 1
        if ids:
            yield from block((part << 20) + blocks, ids, shas, lens)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def answers(messages: DataFrame) -> DataFrame:
    """Per sender and owner: a bitmap over the sender's fingerprints, set where others have it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [rice_decode(*row) for row in zip(pdf["n"], pdf["k"], pdf["unary"], pdf["rest"])]
        every = np.concatenate(lists)
        _, where, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared = counts[where] > 1
        ends = np.cumsum([len(x) for x in lists])[:-1]
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"],
                             "bitmap": [np.packbits(s).tobytes() for s in np.split(shared, ends)]})

    return messages.select("sender", "owner", "n", "k", "unary", "rest").groupBy("owner").applyInPandas(
        run, "sender long, owner int, bitmap binary")


def _blank_free() -> Column:
    return F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, code_points, like_kept.

    Texts are equal when equal without white space; null counts as empty. The row with the most
    code points stays, then the smallest doc_id (null last); of repeated rows one is kept.
    like_kept: doc_id and code points are those of the row that stays.
    """
    spark = docs.sparkSession
    text_batches(spark)
    steps = Steps(spark, "exact-dedup")
    total = docs.count()
    bits = min(63, max(16, total.bit_length() + SPARE_BITS))
    path = steps.path("digests")
    digest_rows(docs, bits, -(-max(total, 1) // OWNER_ROWS)).write.partitionBy("kind").parquet(path)
    schema = ("doc_id long, sha string, n_cp int, rid long, sender long, owner int, pos int, own_copy boolean, "
              "n int, k int, unary binary, rest binary, kind int")
    stored = spark.read.schema(schema).parquet(path)
    digests = stored.filter("kind = 0").select("doc_id", "sha", "n_cp", "rid", "sender", "owner", "pos", "own_copy")
    bitmaps = answers(stored.filter("kind = 1"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("pos") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.expr("shiftright(_byte, 7 - pos % 8) & 1")
    marked = steps.save(
        digests.join(bitmaps, ["sender", "owner"]).withColumn("_byte", byte.cast("int"))
        .select("doc_id", "sha", "n_cp", "rid", ((bit == 1) | F.col("own_copy")).alias("suspect")), "marked")
    suspects = marked.filter("suspect")
    found = steps.save(suspects.groupBy("sha").agg(
        F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                       "doc_id", "rid")).alias("best"), F.count("*").alias("group_size")), "found")
    # Byte by byte: the texts themselves are grouping keys, so equal ones meet already in the map task.
    texts = docs.select(_blank_free().alias("norm")).withColumn("sha", F.sha2("norm", 256))
    several = found.filter("group_size > 1").select("sha")
    compared = (texts.join(small_or_shuffled(several), "sha", "left_semi").groupBy("sha", "norm").agg(F.count("*").alias("n"))
                .groupBy("sha").agg(F.count("*").alias("texts"), F.sum("n").alias("rows")))
    checked = found.join(compared, "sha", "left").select(
        "sha", "best", F.when((F.col("group_size") == 1) | ((F.col("texts") == 1) & (F.col("rows") == F.col("group_size"))),
                              F.col("group_size")).otherwise(
            F.raise_error(F.concat(F.lit("different texts share the digest "), "sha"))).alias("group_size"))
    checked = steps.save(checked, "checked")
    of_suspects = hot_join(suspects, checked, "sha", "group_size", total).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"),
        F.col("n_cp").alias("code_points"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_cp") == -F.col("best.less"))).alias("like_kept"))
    single = marked.filter("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n_cp").alias("code_points"),
        F.lit(True).alias("like_kept"))
    return of_suspects.unionByName(single)


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one per group of equal texts; columns as they are."""
    steps = Steps(docs.sparkSession, "exact-distinct")

    def key(doc_id: Column, sha: Column, points: Column) -> Column:
        return F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("none")), sha, points.cast("string"))

    marks = steps.save(exact_groups(docs).filter("NOT kept").select(
        key(F.col("doc_id"), F.col("text_sha256"), F.col("code_points")).alias("__key"), "like_kept").distinct(), "marks")
    gone = marks.filter("NOT like_kept").select("__key")
    keyed = docs.withColumn("__key", key(F.col("doc_id").cast("long"), F.sha2(_blank_free(), 256), F.length(
        F.coalesce(F.col("text").cast("string"), F.lit("")))))
    left = keyed.join(small_or_shuffled(gone), "__key", "left_anti")
    # Rows that cannot be told from the one that stays: all but one of them go.
    repeated = marks.filter("like_kept").select("__key")
    if repeated.limit(1).count():
        one = left.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
        left = left.join(repeated, "__key", "left_anti").unionByName(one)
    return left.drop("__key")


def op9_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("code_points", "like_kept")


ORACLE = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t FROM documents),
 g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
 count(*) OVER (PARTITION BY t) AS group_size FROM d)
 SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g"""
