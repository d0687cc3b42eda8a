"""Substring deduplication: paragraphs that repeat, exactly or nearly, in other places, and
passages that repeat inside or across paragraphs.

Paragraphs are the lines of a text. Those of at least MIN_WORDS words are compared by MinHash
banding tuned for recall and confirmed by exact Jaccard similarity of their shingle sets; linked
ones form components. The first paragraph of a component, by doc_id and line, stays; the others
are removed from their documents. Of what is left, the later copies of runs of 50 equal words or
more are removed, whatever lines they are laid over (see passages.py). Characters of scripts
without white space count as words.

Texts are shuffled once, into a table clustered by doc_id. Every later step reads them there and
joins what it knows of a document, places and hashes alone; lines are never stored as text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import Steps, hot_join, released, text_batches
from domainsieve.llm.minhash import band_keys, grouped, signatures
from domainsieve.llm.passages import by_document, repeated_passages, without, without_lines
from domainsieve.llm.shingles import shingle_table, slices, spaced, word_hashes
from domainsieve.sources.workdir import removed

# Shorter paragraphs are left alone.
MIN_WORDS = 20
# Bands and rows: two paragraphs at the threshold of 0.8 share no band with a chance of 6e-7.
SHAPE = (20, 3)
NAMES = ("text_kept", "n_paragraphs", "n_removed")
# Bytes of text in a bucket of the clustered table.
BUCKET_BYTES = 64 << 20
_AT = ["doc_id", "h", "i"]
_KEY, _ID, _HASH, _ROW, _TEXT = "_key", "_id", "_h", "_row", "_text"


def _clustered(docs: DataFrame, steps: Steps) -> DataFrame:
    """docs (columns c0, c1, …, text in _text, doc_id in _id) with a hash of the text and a number for
    each row, clustered by doc_id; rows without one, which nothing is joined to, are spread."""
    size = docs.agg(F.sum(F.octet_length(_TEXT)).alias("n")).first()["n"] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = docs.withColumn(_ROW, F.monotonically_increasing_id())
    key = F.coalesce(_ID, F.xxhash64(_ROW))
    return steps.cluster(rows.withColumns({_KEY: key, _HASH: F.xxhash64(_TEXT)}), _KEY, buckets)


def _with_lists(docs: DataFrame, lists: DataFrame, name: str, how: str) -> DataFrame:
    """docs with column `name`: the x of lists (doc_id, list of (h, x)) that belong to the row's text.

    Null where there are none; with how "inner", such rows are left out.
    """
    side = lists.select(F.col("doc_id").alias("_list_id"), F.col("list").alias("_list")).hint("shuffle_hash")
    own = F.transform(F.filter("_list", lambda e: e.h == F.col(_HASH)), lambda e: e.x)
    joined = docs.join(side, F.col(_KEY) == F.col("_list_id"), how)
    found = joined.withColumn(name, F.when(F.col(_ID).isNotNull() & (F.size(own) > 0), own)).drop("_list_id", "_list")
    return found.filter(F.col(name).isNotNull()) if how == "inner" else found


def _line_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of all texts: the text, the line, where its words start, and all word hashes."""
    lines = pc.split_pattern(texts, "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    h, at = word_hashes(spaced(lines.flatten()))
    return owner, i, at, h


def _signed_lines(docs: DataFrame, words: int, least: int) -> DataFrame:
    """(row, doc_id, h, i, n, digest, bands) of the lines with at least `least` words."""
    bands, rows = SHAPE

    def run(batches):
        released("shingles")
        for batch in batches:
            for s, e in slices(batch.column(3)):
                owner, i, at, h = _line_hashes(batch.column(3).slice(s, e - s))
                many = np.diff(at)
                long_ = np.flatnonzero(many >= max(1, least))
                values, starts = shingle_table(h[np.repeat(many >= max(1, least), many)],
                                               np.append(0, np.cumsum(many[long_])), words)
                keys = band_keys(signatures(values, starts, bands * rows), bands, rows)
                raw, ends = values.tobytes(), (starts * 8).tolist()
                digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
                own = pa.array(owner[long_] + s)
                offsets = pa.array(np.arange(len(long_) + 1, dtype=np.int32) * bands)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(own) for k in range(3)], pa.array(i[long_].astype(np.int32)),
                     pa.array(np.diff(starts).astype(np.int32)), pa.array(digest, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
                    names=["row", *_AT, "n", "digest", "bands"])
            released("shingles")

    text_batches(docs.sparkSession)
    return docs.select(_ROW, _ID, _HASH, _TEXT).mapInArrow(
        run, "row long, doc_id long, h long, i int, n int, digest binary, bands array<long>")


def _line_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, n, set) of the lines that `want` of docs (row, text, want: array<struct<row, id, i>>) asks for."""
    def run(batches):
        released("shingles")
        for batch in batches:
            ids, texts = [], []
            for row, text, want in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = [(w["id"], w["i"]) for w in want if w["row"] == row]
                lines = text.split("\n") if own else []
                ids += [k for k, _ in own]
                texts += [lines[i] for _, i in own]
            column = pa.array(texts, pa.string())
            for s, e in slices(column):
                values, starts = shingle_table(*word_hashes(spaced(column.slice(s, e - s))), words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[s:e], pa.int64()), pa.array(np.diff(starts).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))],
                    names=["id", "n", "set"])
            released("shingles")

    return docs.select(_ROW, _TEXT, "want").mapInArrow(run, "id long, n int, set array<long>")


def repeated_paragraphs(docs: DataFrame, words: int, percent: int, min_words: int, steps: Steps) -> DataFrame:
    """(doc_id, h, i) of every paragraph that has an earlier one in its component; h tells texts
    of one doc_id apart, i is the line. docs is clustered."""
    texts = docs.filter(F.col(_ID).isNotNull() & F.col(_TEXT).isNotNull())
    # The numbers are stored with the rows, so all later steps see the same ones.
    banded, path = steps.replace(_signed_lines(texts, words, min_words).withColumn(
        "id", F.monotonically_increasing_id()), "lines", None)
    places = steps.save(banded.select("id", "row", *_AT), "places")

    def sets_of_ids(asked: DataFrame) -> DataFrame:
        want = places.join(asked, "id").groupBy("doc_id").agg(F.collect_list(F.struct("row", "id", "i")).alias("want"))
        return _line_sets(texts.join(want.hint("shuffle_hash"), F.col(_KEY) == F.col("doc_id")), words)

    inner = Steps(docs.sparkSession, "paragraph-groups")
    groups = steps.save(grouped(banded, path, sets_of_ids, percent, inner).select("id", "component"), "groups")
    removed(docs.sparkSession, inner.root)
    sizes = groups.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    total = groups.count()
    several = steps.save(hot_join(groups, steps.save(sizes, "sizes"), "component", "n", total)
                         .join(places, "id").select("component", *_AT), "several")
    first = steps.save(several.groupBy("component").agg(
        F.min(F.struct(*_AT)).alias("first"), F.count("*").alias("n")), "first")
    return hot_join(several, first, "component", "n", total).filter(
        F.struct(*_AT) > F.col("first")).select(*_AT).distinct()


def _cut(docs: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    """docs with `names`, from its lists of gone lines and starts of gone passages."""
    n_lines = F.when(F.col(_TEXT).isNull(), 0).otherwise(
        F.octet_length(_TEXT) - F.octet_length(F.replace(_TEXT, F.lit("\n"), F.lit(""))) + 1).cast("long")
    d = docs.withColumn(names[1], n_lines)
    some = F.col("gone").isNotNull() | F.col("starts").isNotNull()
    kept = [c for c in d.columns if c not in ("gone", "starts")]
    whole = d.filter(~some).select(*kept, F.col(_TEXT).alias(names[0]), F.lit(0).cast("long").alias(names[2]))
    at = [kept.index(_TEXT), len(kept), len(kept) + 1]

    def run(batches):
        for batch in batches:
            done = []
            for text, gone, starts in zip(*(batch.column(k).to_pylist() for k in at)):
                left, n = without_lines(text, gone) if gone else text, len(gone or ())
                if starts:
                    left, more = without(left, starts)
                    n += more
                done.append((left, n))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
                names=[*kept, names[0], names[2]])

    changed = d.filter(some).select(*kept, "gone", "starts").mapInArrow(run, whole.schema)
    return whole.unionByName(changed)


def _deduplicated(docs: DataFrame, words: int, percent: int, min_words: int, names: tuple[str, str, str],
                  passages: bool) -> DataFrame:
    spark, columns = docs.sparkSession, docs.columns
    steps, first = Steps(spark, "removed"), Steps(spark, "paragraphs")
    own = {c: f"c{k}" for k, c in enumerate(columns)}
    for c, name, kind in (("doc_id", _ID, "bigint"), ("text", _TEXT, "string")):
        if dict(docs.dtypes)[c] == kind:
            own[c] = name
    d = docs.toDF(*own.values())
    # A column of another type is kept beside the one that is worked with.
    d = d.withColumns({name: F.col(own[c]).cast(kind) for c, name, kind in (
        ("doc_id", _ID, "long"), ("text", _TEXT, "string")) if own[c] != name})
    table = _clustered(d, steps)
    gone = steps.save(by_document(repeated_paragraphs(table, words, percent, min_words, first), "i"), "gone")
    removed(spark, first.root)
    left = _with_lists(table, gone, "gone", "left")
    if passages:
        texts = left.filter(F.col(_ID).isNotNull() & F.col(_TEXT).isNotNull()).select(
            _KEY, _ID, _HASH, F.col(_ID).alias("doc_id"), F.col(_HASH).alias("h"), F.col(_TEXT).alias("text"), "gone")
        left = _with_lists(left, repeated_passages(texts, _with_lists, steps), "starts", "left")
    else:
        left = left.withColumn("starts", F.lit(None).cast("array<int>"))
    inner = ("_kept", "_lines", "_removed")
    out = dict(zip(names, inner))
    return _cut(left, inner).select(
        *[F.col(own[c]).alias(c) for c in columns if c not in out], *[F.col(v).alias(k) for k, v in out.items()])


def dedup_paragraphs(docs: DataFrame, words: int = 5, percent: int = 80, min_words: int = MIN_WORDS,
                     names: tuple[str, str, str] = NAMES) -> DataFrame:
    """docs with text_kept (the text without removed paragraphs), n_paragraphs and n_removed, or
    other `names`; columns of these names are replaced, all others stay.

    Rows with the same doc_id and text are one document and get the same result; rows without
    doc_id and null texts stay whole.
    """
    return _deduplicated(docs, words, percent, min_words, names, passages=False)


def dedup_substrings(docs: DataFrame, words: int = 5, percent: int = 80, min_words: int = MIN_WORDS,
                     names: tuple[str, str, str] = NAMES) -> DataFrame:
    """As dedup_paragraphs(), and text_kept also loses repeated passages; n_removed counts
    paragraphs gone as a whole."""
    return _deduplicated(docs, words, percent, min_words, names, passages=True)


def op5_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select(
        "doc_id", "n_paragraphs", "n_removed", F.col("text_kept").alias("text"))
