"""Benchmark decontamination by an Aho-Corasick automaton over the benchmark's normalised text.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in lower case. A benchmark
item's windows are its stretches of `size` words; a shorter item that has words is one window. The
automaton holds every distinct window as a sequence of word numbers, and each text is run through
it once; words that no window has are number 0, which leads back to the root. Where a window ends,
its words are hit; positions come back as spans of the original text.

The windows are few beside the texts, but their number has no bound of its own, so it is measured:
the automaton takes at most BLOCK_WORDS words of windows. A benchmark within that is one automaton,
sent to all tasks, and texts are neither stored nor shuffled. A larger one is cut into blocks by
item; then texts are numbered and stored, run through one automaton after the other, and only
hits are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.llm.common import Steps, text_batches, with_fields

SIZE = 10
# Words of windows in one automaton: measured at some 70 bytes each in a worker.
BLOCK_WORDS = 4_000_000
# Bytes of a text that are cut into words at once.
PIECE = 1 << 20
# Digests kept for sets of windows that occur again, per task.
KEPT_SETS = 10_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(start, piece) of data, cut between words, each longer than PIECE only by its last word."""
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        rest = _WORD.match(data, end)
        end = rest.end() if rest else end
        yield at, data[at:end]
        at = end


def words_of(text: str | None) -> list[str]:
    return [w.decode() for w in _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())]


@dataclass
class Windows:
    """A block of the benchmark. items[w] are the numbers of the items with window w."""
    words: list[str] = field(default_factory=list)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def windows_of(rows: Sequence[tuple[str, str | None]], size: int) -> Windows:
    """Distinct windows of items (name, text), texts of one name together. Words count from 1."""
    out, number, place = Windows(), {}, {}
    for name, text in rows:
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        if not ids:
            continue
        if not out.names or out.names[-1] != name:
            out.names.append(name)
        for i in range(max(1, len(ids) - size + 1)):
            window = tuple(ids[i:i + size])
            w = place.setdefault(window, len(place))
            if w == len(out.windows):
                out.windows.append(window)
                out.items.append([])
            if not out.items[w] or out.items[w][-1] != len(out.names) - 1:
                out.items[w].append(len(out.names) - 1)
    out.words = list(number)
    return out


class Scanner:
    """The automaton of a block, built once in each worker process."""
    _built: dict[str, Scanner] = {}

    def __init__(self, block: Windows):
        self.block = block
        self.number = {w.encode(): i + 1 for i, w in enumerate(block.words)}
        self.lengths = [len(w) for w in block.windows]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for w, window in enumerate(block.windows):
            self.automaton.add_word(window, w)
        self.automaton.make_automaton()
        self.longest = max(self.lengths, default=1)

    @classmethod
    def get(cls, key: str, block: Windows) -> Scanner:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(block)
        return cls._built[key]

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[int]]:
        """Words, spans of hit words [first, last], and windows that occur."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        n, before, spans, found = 0, [], [], set()
        for _, piece in _pieces(data):
            ids = [self.number.get(w, 0) for w in _WORD.findall(piece)]
            run = before + ids
            for end, w in self.automaton.iter(tuple(run)) if self.lengths else ():
                if end < len(before):
                    continue
                found.add(w)
                last = n - len(before) + end
                first = last - self.lengths[w] + 1
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append([first, last])
            n += len(ids)
            before = run[max(0, len(run) - self.longest + 1):]
        return n, spans, found


def character_spans(text: str | None, spans: Sequence[Sequence[int]]) -> list[list[int]]:
    """Spans of words as [start, end) in characters of the original text."""
    if not spans:
        return []
    data = (text or "").encode("utf-8", "surrogatepass")
    lower = data.lower()
    wanted = sorted({w for s in spans for w in s})
    byte_at, n, k = {}, 0, 0
    for at, piece in _pieces(lower):
        for m in _WORD.finditer(piece):
            if k < len(wanted) and n == wanted[k]:
                byte_at[n], k = (at + m.start(), at + m.end()), k + 1
            n += 1
    out, done, chars = [], 0, 0
    for first, last in spans:
        pair = []
        for b in (byte_at[first][0], byte_at[last][1]):
            chars += len(data[done:b].decode("utf-8", "surrogatepass"))
            done = b
            pair.append(chars)
        out.append(pair)
    return out


def items_digest(names: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode("utf-8", "surrogatepass")).hexdigest()


def _merged(spans: Sequence[Sequence[int]]) -> list[list[int]]:
    out = []
    for first, last in sorted(spans):
        if out and out[-1][1] >= first - 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


_RESULT = {"_n_words": "long", "_n_hit": "long", "_n_items": "long", "_sha": "string",
           "_spans": "array<array<int>>"}


def _scanned(docs: DataFrame, text: str, block: Windows, key: str) -> DataFrame:
    """docs with the columns of _RESULT, by one automaton, without a shuffle."""
    at, schema = docs.columns.index(text), with_fields(docs, _RESULT)
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        scanner, digests = Scanner.get(key, sent.value), {}
        for batch in batches:
            rows = []
            for text in batch.column(at):
                text = text.as_py()
                n, spans, found = scanner.scan(text)
                which = tuple(sorted(found))
                if which not in digests:
                    if len(digests) >= KEPT_SETS:
                        digests.clear()
                    items = {i for w in which for i in scanner.block.items[w]}
                    digests[which] = len(items), items_digest([scanner.block.names[i] for i in items])
                rows.append((n, sum(b - a + 1 for a, b in spans), *digests[which], character_spans(text, spans)))
            more = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


_ARROW = [pa.field(name, kind) for name, kind in zip(_RESULT, (
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32()))))]


def _block_hits(texts: DataFrame, block: Windows, key: str) -> DataFrame:
    """(id, spans, names) of the texts (id, text) in which windows of the block occur."""
    sent = texts.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        scanner = Scanner.get(key, sent.value)
        for batch in batches:
            rows = []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, spans, found = scanner.scan(text.as_py())
                if found:
                    rows.append((id_, spans, [scanner.block.names[i] for i in
                                              {i for w in found for i in scanner.block.items[w]}]))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32()))),
                     pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["id", "spans", "names"])

    return texts.mapInArrow(run, "id long, spans array<array<int>>, names array<string>")


def _in_blocks(docs: DataFrame, text: str, blocks: Iterator[Windows], steps: Steps) -> DataFrame:
    """As _scanned(), by one automaton after the other over stored texts."""
    numbered = steps.save(docs.withColumn("_row", F.monotonically_increasing_id()), "texts")
    texts, hits = numbered.select(F.col("_row").alias("id"), F.col(text).alias("text")), None
    for i, block in enumerate(blocks):
        found = steps.save(_block_hits(texts, block, f"{steps.root}-{i}"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    # A row's spans and items are bounded by its words and the benchmark's items with them.
    gathered = hits.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("_all"),
                                      F.flatten(F.collect_list("names")).alias("_names"))
    joined = numbered.join(gathered, F.col("_row") == F.col("id"), "left").drop("id", "_row")
    at, schema = docs.columns.index(text), with_fields(docs, _RESULT)
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans, names in zip(batch.column(at), batch.column(width).to_pylist(),
                                          batch.column(width + 1).to_pylist()):
                text, spans, names = text.as_py(), _merged(spans or []), set(names or [])
                data = (text or "").encode("utf-8", "surrogatepass").lower()
                n = sum(len(_WORD.findall(piece)) for _, piece in _pieces(data))
                rows.append((n, sum(b - a + 1 for a, b in spans), len(names), items_digest(list(names)),
                             character_spans(text, spans)))
            more = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=schema.names)

    return joined.mapInArrow(run, schema)


def _blocks(items: DataFrame, words: int, size: int) -> Iterator[Windows]:
    """The benchmark's windows, at most `words` words of them at a time but for one long item.

    Rows come to the driver one stored partition at a time and leave it with their block.
    """
    rows, held = [], 0
    for r in items.toLocalIterator():
        need = len(words_of(r["text"])) * size
        if rows and held + need > words:
            yield windows_of(rows, size)
            rows, held = [], 0
        rows.append((r["name"], r["text"]))
        held += need
    if rows:
        yield windows_of(rows, size)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                 item_text: str = "text", size: int = SIZE, block_words: int = BLOCK_WORDS,
                 names: Sequence[str] = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated",
                                         "spans")) -> DataFrame:
    """docs with `names`: words, hit words, items with an occurring window, the SHA-256 of their
    names (as strings, sorted, with commas between), whether any word is hit, and the hit
    stretches as [start, end) in characters of the text; stretches that touch are one.

    A null or empty text has no words and no hits; a null item text has no windows, and a null item
    name is the empty string. Items with the same name are one, with the windows of all. Repeated
    rows each count. An empty benchmark hits nothing; empty docs give an empty table. Columns of
    docs that bear one of `names` are replaced. Texts of any length are cut into words piece by piece.
    """
    spark = docs.sparkSession
    text_batches(spark)
    steps = Steps(spark, "decontaminate")
    items = steps.save(benchmark.filter(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"),
        F.col(item_text).cast("string").alias("text"))
        .groupBy("name").agg(F.collect_set("text").alias("texts"))
        .select("name", F.explode("texts").alias("text")), "items")
    columns = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(columns)}
    d = docs.toDF(*own.values())
    text = own[text_col]
    if d.schema[text].dataType.simpleString() != "string":
        d = d.withColumn(text, F.col(text).cast("string"))
    # A word takes a byte and a space at least, so characters bound the windows' words.
    bound = items.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0)).alias("n")).first()["n"] * size
    if bound <= block_words:
        block = next(_blocks(items, block_words, size), Windows())
        result = _scanned(d, text, block, steps.root)
    else:
        blocks = _blocks(items, block_words, size)
        first = next(blocks, Windows())
        second = next(blocks, None)
        if second is None:
            result = _scanned(d, text, first, steps.root)
        else:
            result = _in_blocks(d, text, chain([first, second], blocks), steps)
    n_words, n_hit, n_items, sha, flag, spans = names
    return result.select(
        *[F.col(own[c]).alias(c) for c in columns if c not in names], F.col("_n_words").alias(n_words),
        F.col("_n_hit").alias(n_hit), F.col("_n_items").alias(n_items), F.col("_sha").alias(sha),
        (F.col("_n_hit") > 0).alias(flag), F.col("_spans").alias(spans))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its words, hit words, items found, their digest, and the flag."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contaminated(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

# By a join on windows as text.
ORACLE = f"""WITH item AS (
  SELECT item_id, words, least({SIZE}, len(words)) AS k
  FROM (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL) AS t WHERE len(words) > 0),
win AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS w
  FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM item) AS t),
doc AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS words FROM documents),
place AS (
  SELECT doc_id, k, i, array_to_string(list_slice(words, i, i + k - 1), ' ') AS w
  FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
        FROM doc CROSS JOIN (SELECT DISTINCT k FROM win) AS ks WHERE len(words) >= k) AS t),
found AS (SELECT doc_id, item_id, i, place.k AS k FROM place JOIN win ON place.k = win.k AND place.w = win.w),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM found) AS d) AS t
  GROUP BY doc_id),
item_list AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) AS t GROUP BY doc_id)
SELECT doc.doc_id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit ON doc.doc_id = hit.doc_id LEFT JOIN item_list ON doc.doc_id = item_list.doc_id"""
