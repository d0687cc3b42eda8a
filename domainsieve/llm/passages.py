"""Repeated passages: runs of PASSAGE equal words or more, wherever lines begin and end.

The smallest hash of the stretches of HALF words within PASSAGE words is the passage's anchor: it
depends on those words alone, and neighbouring passages mostly share it. Passages whose anchor is
found once in the corpus are not repeated. The others are grouped by all their words; every
passage but the first of a group, by doc_id and place, is taken out. No text is compared with
another one, so groups of any size cost their rows.

A passage that overlaps the first of its group stays, so that each word taken out is still found
in an earlier place.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import Steps, hot_join, released, text_batches
from domainsieve.llm.shingles import UNSPACED, mixed, slices, spaced, word_hashes

HALF = 25
PASSAGE = 2 * HALF
# Stretches of HALF words within a passage.
WINDOW = PASSAGE - HALF + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+")
_AT = ["doc_id", "h"]


def _joined(left: np.ndarray, right: np.ndarray, ahead: int) -> np.ndarray:
    """Hashes of stretches in `left`, each followed by the one in `right` that starts `ahead` further on."""
    n = max(0, min(len(left), len(right) - ahead))
    return mixed(left[:n] * _ODD + right[ahead:ahead + n])


def stretches(h: np.ndarray) -> np.ndarray:
    """Hashes of the HALF = 16 + 8 + 1 words from each place on."""
    size = {1: h}
    for n in (1, 2, 4, 8):
        size[2 * n] = _joined(size[n], size[n], n)
    return _joined(_joined(size[16], size[8], 16), h, 24)


def anchors(s: np.ndarray) -> np.ndarray:
    """The smallest of each WINDOW = 16 + 10 neighbours."""
    m = s
    for n in (1, 2, 4, 8):
        m = np.minimum(m[:-n], m[n:])
    return np.minimum(m[:-10], m[10:])


def passages(column: pa.Array):
    """Per slice of a column of texts: its first row, and of all passages the row, the place in
    words, the hashes of both halves and the anchor."""
    for start, end in slices(column):
        h, at = word_hashes(spaced(column.slice(start, end - start)))
        if len(h) < PASSAGE:
            continue
        s = stretches(h)
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:len(h) - PASSAGE + 1]
        places = np.arange(len(owner))
        whole = np.flatnonzero(places + PASSAGE <= at[1:][owner])
        row = owner[whole]
        yield start, row, whole - at[row], s[whole], s[whole + HALF], anchors(s)[whole]


def without_lines(text: str, gone: list[int]) -> str:
    out = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in out)


def kept_texts(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """texts without the lines in `gone`, which is null or empty for most."""
    some = np.flatnonzero(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
    if not len(some):
        return texts
    mask = np.zeros(len(texts), bool)
    mask[some] = True
    cut = [without_lines(texts[i].as_py(), gone[i].as_py()) for i in some.tolist()]
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(cut, pa.string()))


def _anchored(docs: DataFrame) -> DataFrame:
    """(doc_id, h, key) of docs (doc_id, h, text, gone): every anchor once per WINDOW passages in a
    row that have it, as no single stretch is in more of them."""
    def run(batches):
        released("shingles")
        for batch in batches:
            for start, row, place, _, _, key in passages(kept_texts(batch.column(2), batch.column(3))):
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                k = np.arange(len(key))
                since = k - np.maximum.accumulate(np.where(new, k, 0))
                out = np.flatnonzero(since % WINDOW == 0)
                rows = pa.array(row[out] + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key[out].view(np.int64))],
                    names=[*_AT, "key"])
            released("shingles")

    return docs.select(*_AT, "text", "gone").mapInArrow(run, "doc_id long, h long, key long")


def _asked(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at, key) of the passages of docs (doc_id, h, text, gone, keys) whose anchor is in keys."""
    def run(batches):
        released("shingles")
        for batch in batches:
            keys = batch.column(4)
            flat, ends = keys.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(keys.value_lengths().to_numpy()))
            for start, row, place, a, b, key in passages(kept_texts(batch.column(2), batch.column(3))):
                out = [np.zeros(0, np.int64)]
                cuts = np.append(0, np.flatnonzero(np.diff(row)) + 1)
                for lo, hi in zip(cuts.tolist(), np.append(cuts[1:], len(row)).tolist()):
                    if hi > lo:
                        r = row[lo] + start
                        out.append(lo + np.flatnonzero(np.isin(key[lo:hi], flat[ends[r]:ends[r + 1]])))
                k = np.concatenate(out)
                rows = pa.array(row[k] + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[k].astype(np.int32)),
                     pa.StructArray.from_arrays([pa.array(a[k].view(np.int64)), pa.array(b[k].view(np.int64))], ["a", "b"])],
                    names=[*_AT, "at", "key"])
            released("shingles")

    return docs.select(*_AT, "text", "gone", "keys").mapInArrow(
        run, "doc_id long, h long, at int, key struct<a: long, b: long>")


def without(text: str, starts: list[int]) -> tuple[str, int]:
    """text without the passages that start at these words, and how many lines went as a whole."""
    gone = np.zeros(max(starts) + PASSAGE + 1, np.int64)
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.asarray(starts) + PASSAGE, -1)
    gone = np.cumsum(gone) > 0
    kept, lines, n = [], 0, 0
    for line in text.split("\n"):
        spans = [m.span() for m in _WORD.finditer(line)]
        out = np.zeros(len(spans), bool)
        part = gone[n:n + len(spans)]
        out[:len(part)] = part
        n += len(spans)
        if not out.any():
            kept.append(line)
        elif out.all():
            lines += 1
        else:
            # A word goes with the space after it; those at the end of a line with the space before.
            last = int(np.flatnonzero(~out)[-1])
            pieces = [line[:spans[0][0]]]
            for k in np.flatnonzero(~out).tolist():
                pieces.append(line[spans[k][0]:spans[k][1] if k == last else spans[k + 1][0]])
            pieces.append(line[spans[-1][1]:])
            kept.append("".join(pieces))
    return "\n".join(kept), lines


def repeated_passages(docs: DataFrame, with_lists, steps: Steps) -> DataFrame:
    """(doc_id, starts: array<struct<h, x>>): the places, in words of the text without its gone
    lines, of the passages that go. docs has (doc_id, h, text, gone); with_lists(df, column, how)
    brings to it a list of values per (doc_id, h). Rows with the same doc_id and h are one document.
    """
    text_batches(docs.sparkSession)
    found = steps.save(_anchored(docs), "anchors")
    repeated = steps.save(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-anchors")
    keys = steps.save(by_document(hot_join(found, repeated, "key", "n", found.count()).select(*_AT, "key").distinct(),
                                  "key"), "anchors-of")
    asked = steps.save(_asked(with_lists(docs, keys, "keys", "inner")), "passages")
    first = steps.save(asked.groupBy("key").agg(
        F.min(F.struct(*_AT, "at")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-passages")
    apart = (F.struct(*_AT) > F.struct("first.doc_id", "first.h")) | (F.col("at") >= F.col("first.at") + PASSAGE)
    gone = hot_join(asked, first, "key", "n", asked.count()).filter(apart).select(*_AT, "at").distinct()
    return steps.save(by_document(gone, "at"), "starts")


def by_document(rows: DataFrame, value: str) -> DataFrame:
    """(doc_id, list: array<struct<h, x>>) of rows (doc_id, h, value): what belongs to texts of an id."""
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("h", F.col(value).alias("x"))).alias("list"))
