"""Files that each hold one JSON array, read by many tasks.

Spark's text source deals a file out in splits, cut at closing braces. What a brace means depends on
the text before it: whether it stands in a string, and how deep. So the pieces are read twice. First
every split is summed up for both cases, beginning inside a string or outside: where it ends, and by
how much it goes deeper. One row per split then tells, file by file, how each really begins. Knowing
that, the second pass cuts each split at the commas of the outermost array; elements that lie across
splits are put together from their ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.operators.lookup import small_or_shuffled
from domainsieve.sources.workdir import new_folder, written

_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|["\[\]{},]', re.S)
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_DEEPER = {"[": 1, "{": 1, "]": -1, "}": -1}
_BLANK = " \t\r\n﻿"


def _tokens(text: str, quoted: bool) -> Iterator[tuple[int, str]]:
    """(place, character) of brackets and commas outside strings; at last (len, '"') if text ends
    inside one."""
    at = 0
    if quoted:
        end = _REST_OF_STRING.match(text)
        if not end:
            yield len(text), '"'
            return
        at = end.end()
    for m in _TOKEN.finditer(text, at):
        token = m.group()
        if token == '"':
            yield len(text), '"'
            return
        if token[0] != '"':
            yield m.start(), token


def _runs(batch: pa.RecordBatch, last: tuple | None) -> Iterator[tuple[tuple, int, str]]:
    """(split, first row, text) for each stretch of rows of one split, with the braces put back.

    `last` is the split that the rows before belong to.
    """
    files, starts, values = (batch.column(i).to_pylist() for i in range(3))
    i = 0
    while i < len(values):
        split, j = (files[i], starts[i]), i + 1
        while j < len(values) and (files[j], starts[j]) == split:
            j += 1
        # Every piece but the first of a file comes after a brace.
        first = split != last and split[1] == 0
        yield split, i, ("" if first else "}") + "}".join(values[i:j])
        last, i = split, j


_SUMMARY = "file string, start long, after_open boolean, deeper_open int, after_quoted boolean, deeper_quoted int"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, sums = None, None

    def row():
        return pa.RecordBatch.from_pylist([{
            "file": split[0], "start": split[1], "after_open": sums[0][0], "deeper_open": sums[0][1],
            "after_quoted": sums[1][0], "deeper_quoted": sums[1][1]}], schema=_SUMMARY_ARROW)

    for batch in batches:
        for own, _, text in _runs(batch, split):
            if own != split:
                if split is not None:
                    yield row()
                split, sums = own, [[False, 0], [True, 0]]
            for s in sums:
                end, deeper = False, 0
                for _, token in _tokens(text, s[0]):
                    end, deeper = token == '"', deeper + _DEEPER.get(token, 0)
                s[0], s[1] = end, s[1] + deeper
    if split is not None:
        yield row()


_SUMMARY_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("after_open", pa.bool_()),
                            ("deeper_open", pa.int32()), ("after_quoted", pa.bool_()), ("deeper_quoted", pa.int32())])


def _begins(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """How each split of a file begins: inside a string or not, and how deep."""
    out, quoted, depth = [], False, 0
    for r in rows.sort_values("start").itertuples():
        out.append((r.file, r.start, quoted, depth))
        depth += r.deeper_quoted if quoted else r.deeper_open
        quoted = r.after_quoted if quoted else r.after_open
    return pd.DataFrame(out, columns=["file", "start", "quoted", "depth"])


_PARTS = "file string, start long, kind string, text string, opened int, closed int, wrong int"
_PARTS_ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("text", pa.string()),
                          ("opened", pa.int32()), ("closed", pa.int32()), ("wrong", pa.int32())])


class _Cutter:
    """Cuts the text of one split. Its ends come out as `head` and `tail`, or as one `middle`
    where no element begins or ends in the split; opened and closed count the outermost array's
    brackets, wrong what else may not stand outside it."""

    def __init__(self, split: tuple, quoted: bool, depth: int):
        self.split, self.quoted, self.depth = split, quoted, depth
        self.open_text: list[str] = []
        self.cut = False
        self.counts = [0, 0, 0]

    def add(self, text: str) -> Iterator[tuple]:
        done, self_quoted = 0, False
        for at, token in _tokens(text, self.quoted):
            if token == '"':
                self_quoted = True
                break
            before = self.depth
            self.depth += _DEEPER.get(token, 0)
            if not (before == 1 and token in ",]" or before == 0):
                continue
            opens, closes = before == 0 and token == "[", before == 1 and token == "]"
            self.counts[0] += opens
            self.counts[1] += closes
            self.counts[2] += before == 0 and not opens
            self.open_text.append(text[done:at])
            yield from self._end("element", outside=before == 0)
            self.cut, done = True, at + 1
        self.quoted = self_quoted
        self.open_text.append(text[done:])

    def _end(self, kind: str, outside: bool = False) -> Iterator[tuple]:
        text = "".join(self.open_text)
        self.open_text = []
        if not self.cut and kind == "element":
            kind = "head"
        if outside and kind == "element":
            self.counts[2] += bool(text.strip(_BLANK))
        else:
            yield (*self.split, kind, text, 0, 0, 0)

    def close(self) -> Iterator[tuple]:
        yield from self._end("tail" if self.cut else "middle")
        yield (*self.split, "count", None, *self.counts)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = None
    for batch in batches:
        rows: list[tuple] = []
        for own, i, text in _runs(batch, cutter.split if cutter else None):
            if cutter is None or own != cutter.split:
                rows += cutter.close() if cutter else ()
                cutter = _Cutter(own, batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
            rows += cutter.add(text)
        yield _record(rows)
    if cutter:
        yield _record(list(cutter.close()))


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PARTS_ARROW)],
                                      schema=_PARTS_ARROW)


def _joined(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """The elements of a file that lie across splits; what stands before and after the array
    comes as an element marked outside. At most two rows per split."""
    out, text = [], []
    order = {"head": 0, "middle": 0, "tail": 1}
    rows = rows.assign(at=rows["kind"].map(order)).sort_values(["start", "at"])
    for r in rows.itertuples():
        text.append(r.text)
        if r.kind == "head":
            out.append((key[0], "".join(text), not out))
            text = []
        elif r.kind == "tail":
            text = [r.text]
    out.append((key[0], "".join(text), True))
    return pd.DataFrame(out, columns=["file", "text", "outside"])


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element): JSON text of the elements of files that hold one array each.

    A file that is not one array, or that has an element that is no JSON, gives no rows.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins = (pieces.mapInArrow(_summed, _SUMMARY).groupBy("file")
              .applyInPandas(_begins, "file string, start long, quoted boolean, depth int"))
    # One row for each split that Spark reads. A broadcast join leaves the pieces in their order.
    known = pieces.join(F.broadcast(begins), ["file", "start"]).select("file", "start", "value", "quoted", "depth")
    parts = written(known.mapInArrow(_cut, _PARTS), new_folder(spark, "json-parts"))
    ends = parts.filter(F.col("kind").isin("head", "middle", "tail")).select("file", "start", "kind", "text")
    across = ends.groupBy("file").applyInPandas(_joined, "file string, text string, outside boolean")
    whole = parts.filter("kind = 'element'").select("file", "text", F.lit(False).alias("outside"))
    texts = written(whole.unionByName(across), new_folder(spark, "json-elements"))
    blank = F.trim(F.translate("text", _BLANK, " " * len(_BLANK))) == ""
    counts = parts.filter("kind = 'count'").groupBy("file").agg(
        F.sum("opened").alias("opened"), F.sum("closed").alias("closed"), F.sum("wrong").alias("wrong"))
    per_file = texts.groupBy("file").agg(
        F.count_if(~F.col("outside")).alias("n"), F.count_if(~F.col("outside") & blank).alias("blanks"),
        F.count_if(F.col("outside") & ~blank).alias("stray"),
        F.count_if(~F.col("outside") & ~blank & F.try_parse_json("text").isNull()).alias("broken"))
    good = counts.join(per_file, "file").filter(
        "opened = 1 AND closed = 1 AND wrong = 0 AND stray = 0 AND broken = 0 AND (blanks = 0 OR n = 1)")
    return (texts.filter(~F.col("outside") & ~blank)
            .join(small_or_shuffled(good.select("file")), "file").select("file", F.col("text").alias("element")))
