"""Spelling variants: words that differ by one edit, found by probing Bloom filters.

Two words are near if one inserted, deleted or replaced code point turns one into the other. Every
word's edits are generated and probed against blocked Bloom filters of the vocabulary, sharded by
word length; only the edits that a filter holds are shuffled, to an exact join with the vocabulary
that removes the false ones. A deletion finds the pair from its longer word, a replacement by a
later letter from the word with the earlier one, so each pair comes up once.

A word's hash is a sum over its places, so all edits of a batch of words are hashed and probed as
arrays, and no edited word exists as text before its probe succeeds. A block is 64 bits; a word
sets BITS of them. Filters grow with the vocabulary. They are numbered as one row of blocks and
broadcast PASS_BLOCKS at a time, in as many passes as that takes; a probe is answered in the pass
that holds its block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.llm.common import Steps, text_batches
from domainsieve.llm.shingles import mixed
from domainsieve.sources.workdir import removed

MIN_LENGTH = 7
MIN_COUNT = 2
# A form has at least so many times the occurrences of its variant.
RATIO = 10
# One in so many (document, run) pairs loses a code point in noisy_words().
NOISE = 31

# Lengths from here on share a shard, so there are at most so many shards.
LONG = 64
BITS, BITS_A_WORD = 5, 24
LEAST_BLOCKS = 1024
# Blocks of one pass: 16 MB.
PASS_BLOCKS = 1 << 21
# Places of words that are edited at once.
SLICE = 1 << 17

# Words held by a counting task before it sends its counts on, and their code points.
COUNTED, COUNTED_CHARS = 100_000, 8 << 20
PIECE = 1 << 20
_RUN_CHARS = "A-Za-zÀ-ÿ"
_NOT_RUN = re.compile(f"[^{_RUN_CHARS}]")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))


# -- words of documents --------------------------------------------------------

def _pieces(text: str) -> Iterator[str]:
    """text in pieces that are cut where no run goes on."""
    at = 0
    while at < len(text):
        gap = _NOT_RUN.search(text, at + PIECE)
        end = gap.start() if gap and at + PIECE < len(text) else len(text)
        yield text[at:end]
        at = end


def noisy_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE,
                min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of the texts' letter runs, A-Z in lower case, some of them with a planted slip.

    A run is a longest stretch of A-Z, a-z and U+00C0 to U+00FF. With h the CRC-32 of
    "<id>:<run>", a run whose h is a multiple of `noise` loses its code point h % length. Words
    shorter than min_length are left out. Null texts have no runs; a null id is the empty string.
    A task holds a bounded number of words and sends partial counts; equal words may be counted
    by several tasks and are added up after one shuffle.
    """
    run_of = re.compile(f"[{_RUN_CHARS}]{{{max(1, min_length)},}}")

    def count(batches):
        total, chars = Counter(), 0

        def sent():
            table = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                                pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return table

        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1)):
                start = zlib.crc32(f"{id_.as_py() or ''}:".encode())
                # Of bytes, lower() changes A-Z alone.
                lower = (text.as_py() or "").encode().lower().decode()
                for piece in _pieces(lower):
                    for word, n in Counter(run_of.findall(piece)).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % noise == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1:]
                            if len(word) < min_length or not word:
                                continue
                        if word not in total:
                            chars += len(word)
                        total[word] += n
                    if len(total) >= COUNTED or chars >= COUNTED_CHARS:
                        yield sent()
                        chars = 0
        if total:
            yield sent()

    text_batches(docs.sparkSession)
    return (docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
            .mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))


# -- filters ------------------------------------------------------------------

@dataclass
class Layout:
    """Where each shard's blocks lie in the one row of blocks."""
    start: np.ndarray
    blocks: np.ndarray

    @classmethod
    def of(cls, words: dict[int, int]) -> Layout:
        blocks = np.zeros(LONG + 1, np.uint64)
        for shard, n in words.items():
            blocks[shard] = max(LEAST_BLOCKS, -(-n * BITS_A_WORD // 64))
        return cls(np.append(np.uint64(0), np.cumsum(blocks))[:-1].astype(np.uint64), blocks)

    def total(self) -> int:
        return int(self.start[-1] + self.blocks[-1])

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and bits of hashes of words of one length."""
        h, shard = mixed(h), min(length, len(self.blocks) - 1)
        block = ((h >> np.uint64(32)) * self.blocks[shard] >> np.uint64(32)) + self.start[shard]
        bits = np.zeros(h.shape, np.uint64)
        for j in range(BITS):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * j)) & np.uint64(63))
        return block, bits


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _code_points(words: Sequence[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _by_length(words: Sequence[str]) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of words, some at a time."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, own in groups.items():
        step = max(1, SLICE // max(1, length))
        for s in range(0, len(own), step):
            yield length, own[s:s + step]


def _letter(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64) + np.uint64(1))


def _filter_rows(vocabulary: DataFrame, layout: Layout) -> DataFrame:
    """(block, bits) of all words, one row per block that has any."""
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, own in _by_length(words):
                codes = _code_points([words[i] for i in own], length)
                block, bits = layout.place((_letter(codes) * _powers(length)).sum(1, dtype=np.uint64), length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.astype(np.int64)), pa.array(bits.view(np.int64))], names=["block", "bits"])

    return (vocabulary.select("word").mapInArrow(run, "block long, bits long")
            .groupBy("block").agg(F.bit_or("bits").alias("bits")))


def _probe(words: list[str], length: int, letters: np.ndarray, shortest: int,
           has) -> Iterator[tuple[int, str]]:
    """(place of word, edited word) of words of one length, where has(hashes, length) says yes."""
    codes = _code_points(words, length)
    at = np.searchsorted(letters, codes)
    value, power = _letter(letters), _powers(length)
    own = value[at]
    before = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(own * power, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    if length - 1 >= shortest:
        cut = before[:, :-1] + (whole - before[:, 1:]) * _INVERSE
        # Of equal letters in a row, deleting the first is enough.
        first = np.ones(codes.shape, bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        for r, i in zip(*np.nonzero(has(cut, length - 1) & first)):
            yield r, words[r][:i] + words[r][i + 1:]
    for a in range(1, len(letters)):
        earlier = at < a
        new = whole + (value[a] - own) * power
        for r, i in zip(*np.nonzero(has(new, length) & earlier)):
            yield r, words[r][:i] + chr(letters[a]) + words[r][i + 1:]


def _candidates(vocabulary: DataFrame, filters: np.ndarray, first: int, layout: Layout, letters: np.ndarray,
                shortest: int) -> DataFrame:
    """(word, n, edit) of the edits that this pass's blocks hold."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        held = sent.value

        def has(h, length):
            block, bits = layout.place(h, length)
            block -= np.uint64(first)
            # Blocks before this pass wrap around to very large numbers.
            inside = block < np.uint64(len(held))
            block[~inside] = 0
            return inside & ((held[block] & bits) == bits)

        for batch in batches:
            words, ns = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, own in _by_length(words):
                found = list(_probe([words[i] for i in own], length, letters, shortest, has))
                if found:
                    at = np.array(own)[[r for r, _ in found]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([words[i] for i in at], pa.string()), pa.array(ns[at]),
                         pa.array([e for _, e in found], pa.string())], names=["word", "n", "edit"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_pairs(vocabulary: DataFrame, steps: Steps) -> DataFrame:
    """(word, n, other, other_n): each pair of near words once. vocabulary (word, n) is stored."""
    spark = vocabulary.sparkSession
    sizes = (vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("shard")).count().collect())
    layout = Layout.of({r["shard"]: r["count"] for r in sizes})
    # At most all code points there are.
    letters = np.array(sorted(ord(r["c"]) for r in vocabulary.select(
        F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c != ''").distinct().collect()), np.uint32)
    shortest = min((r["shard"] for r in sizes), default=1)
    total, found = layout.total(), None
    rows = steps.save(_filter_rows(vocabulary, layout), "filters")
    text_batches(spark)
    for first in range(0, total, PASS_BLOCKS):
        some = rows.filter(F.col("block").between(first, first + PASS_BLOCKS - 1)).toArrow()
        filters = np.zeros(min(PASS_BLOCKS, total - first), np.uint64)
        filters[some["block"].to_numpy() - first] = some["bits"].to_numpy().view(np.uint64)
        edits = steps.save(_candidates(vocabulary, filters, first, layout, letters, max(1, shortest)), "edits")
        found = edits if found is None else found.unionByName(edits)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.join(exact, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n")


# -- forms ----------------------------------------------------------------------

def _roots(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root) of forms (word, up): the last word that the ups lead to, by pointer doubling.

    n grows by the ratio at each step up, so chains are short and without circles.
    """
    p, path = steps.replace(forms, "roots", None)
    while True:
        q = p.select(F.col("word").alias("up"), F.col("up").alias("upper"))
        new, new_path = steps.replace(p.join(q, "up", "left").select(
            "word", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "roots", None)
        moved = new.filter("moved").limit(1).count()
        p = new.select("word", "up")
        removed(forms.sparkSession, path)
        path = new_path
        if not moved:
            return p.select("word", F.col("up").alias("root"))


def variants(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of counted words (word, n).

    Kept are words of at least min_length code points whose counts add up to at least min_count;
    null and empty words and null counts are left out, repeated rows add up. n_near counts a
    word's near words. Its form is the near word of largest n (of ties, the smallest in code-point
    order) where that n is at least ratio (above 1) times its own, else null; root is the last
    word that forms lead to, the word itself if it has none. An empty table gives an empty one;
    columns beside word and n are ignored.
    """
    if ratio <= 1:
        raise ValueError("ratio: above 1")
    steps = Steps(words.sparkSession, "spelling")
    vocabulary = steps.save(
        words.select(F.col("word").cast("string").alias("word"), F.col("n").cast("long").alias("n"))
        .filter((F.length("word") >= max(1, min_length)) & F.col("n").isNotNull())
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count), "vocabulary")
    pairs = steps.save(near_pairs(vocabulary, steps), "pairs")
    both = pairs.select("word", "other", "other_n").unionByName(
        pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("best"))
    is_form = -F.col("best.m") >= F.col("n") * ratio
    table = steps.save(vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.m")).alias("form_n")), "forms")
    roots = _roots(table.filter("form IS NOT NULL").select("word", F.col("form").alias("up")), steps)
    return table.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents that occurs twice or more, with its form and root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(noisy_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")
