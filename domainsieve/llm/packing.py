"""Packing of tokenised documents into sequences of one length.

Documents longer than a sequence are cut; every full piece is a sequence of its own. The
pieces left are packed shortest pack first over the histogram of their lengths: lengths are
placed longest first, each into the emptiest packs that have room, and only counts of packing
patterns are kept. The histogram has one entry per length, so the driver's work is bounded by
the sequence length and not by the data. Pieces are then numbered within their length, and the
number says which pattern, which sequence of it, and which place.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import Steps, buckets_for, kept, ranked, released, text_batches
from domainsieve.llm.shingles import mixed

SEQUENCE = 4096
# Bytes of the table of units and ids that a worker remembers.
REMEMBERED = 32 << 20
# Longer units, in bytes, and those of more ids are not remembered. An entry takes so many bytes beside its unit.
LONGEST, MOST_IDS = 31, 12
OVERHEAD = 2 + 2 * MOST_IDS
# Bytes of text that a worker tokenises at once.
SLICE_BYTES = 2 << 20
_ODD, _LETTER, _DIGIT, _MARK = range(4)
# The kind of each byte. Two-byte characters up to U+023F are letters that the tokenizer's first
# steps keep as one letter each; two signs and the dotted capital I among them are not.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[ord(c) for c in "'|"]] = _ODD
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xC9)]] = _LETTER
_NO_LETTERS = [int.from_bytes(c.encode(), "big") for c in "\u00D7\u00F7\u0130"]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
# Which bytes of a key belong to a unit of so many bytes.
_INSIDE = np.where(np.arange(LONGEST + 1) < np.arange(LONGEST + 2)[:, None], 255, 0).astype(np.uint8)


def _expanded(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All places of runs of `lens` that begin at `starts`, in a row."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((starts - (ends - lens)).astype(np.int32), lens) + np.arange(total, dtype=np.int32)


def units(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of large strings in a row: their bytes, where each begins, whether it is odd, and
    each word's first unit.

    A run of letters, a digit and a run of marks are single steps of the tokenizer and do not
    depend on what stands beside them; A-Z are in lower case there. A word with anything else, or
    with an apostrophe or part of a special token, is odd and one unit as it stands.
    """
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(words) + 1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8, n)
    kind = _KIND[data]
    kind[:-1][np.isin(data[:-1].astype(np.uint16) << 8 | data[1:], _NO_LETTERS)] = _ODD
    before = np.append(0, np.cumsum(kind == _ODD))[offsets]
    odd = np.repeat(before[1:] > before[:-1], np.diff(offsets))
    begins = np.zeros(n + 1, bool)
    begins[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~odd[1:]
    begins[offsets] = True
    start = np.flatnonzero(begins[:-1])
    return np.where(odd, data, _LOWER[data]), start, odd[start], np.searchsorted(start, offsets)


class WordTokenizer:
    """Ids of whole texts. A unit has the same ids in any text, since the tokenizer drops white
    space and no step of it looks across; so units are remembered, each in the one slot of a table
    that its hash says, where a newer one replaces it. Slots hold whole units and are compared."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        size = self.t.get_vocab_size()
        self.ends = np.array([(self.t.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in self.table or ())

    @property
    def seen(self) -> list[str]:
        """All units that are remembered."""
        raw = self.table[0].view(np.uint8) if self.table else np.zeros((0, LONGEST + 1), np.uint8)
        return [k[:k[-1]].tobytes().decode() for k in raw if k[-1]]

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, ids and numbers of ids of all slots."""
        if self.table is None:
            n = max(1, REMEMBERED // (LONGEST + 2 + MOST_IDS * np.dtype(self.kind).itemsize))
            self.table = (np.zeros((n, (LONGEST + 1) // 8), np.uint64), np.zeros((n, MOST_IDS), self.kind),
                          np.zeros(n, np.uint8))
        return self.table

    def plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words in a row, each taken by itself, and how many each has."""
        ids = [e.ids for e in self.t.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.kind), np.fromiter(map(len, ids), np.int64, len(ids))

    def single(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As plain(), for units that are not odd: each ends with the one id that carries a word end."""
        parts = [words[at:at + 64] for at in range(0, len(words), 64)]
        out = []
        for part, e in zip(parts, self.t.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            out.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self.plain(part))
        return np.concatenate([ids for ids, _ in out]), np.concatenate([n for _, n in out])

    def learned(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, encode: Callable
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units that are not remembered: the ids and numbers of ids of distinct ones, which one
        each is, and where each distinct one is found first."""
        raw, order = data.tobytes(), {}
        which = np.array([order.setdefault(raw[a:b], len(order)) for a, b in zip(start.tolist(), end.tolist())])
        ids, n = encode([w.decode() for w in order])
        return ids, n, which, np.unique(which, return_index=True)[1]

    def remember(self, key: np.ndarray, slot: np.ndarray, ids: np.ndarray, n: np.ndarray, size: np.ndarray) -> None:
        """Keep units (their keys, slots, ids, numbers of ids and bytes) where they are short."""
        keys, rows, counts = self.slots()
        own = np.flatnonzero((size <= LONGEST) & (n <= MOST_IDS))
        own = own[np.unique(slot[own], return_index=True)[1]]
        at = np.cumsum(n) - n
        row = np.zeros((len(own), MOST_IDS), self.kind)
        row[np.arange(MOST_IDS) < n[own, None]] = ids[_expanded(at[own], n[own])]
        keys[slot[own]], rows[slot[own]], counts[slot[own]] = key[own], row, n[own]

    def unit_ids(self, data: np.ndarray, start: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, and where in them those of each unit begin and how many they are."""
        end = np.append(start[1:], len(data))
        size = end - start
        raw = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(LONGEST + 1, np.uint8)), LONGEST + 1)[start]
        raw &= _INSIDE[np.minimum(size, LONGEST + 1)]
        raw[:, LONGEST] = np.minimum(size, 255)
        key = raw.view(np.uint64)
        h = key[:, 0]
        for k in range(1, key.shape[1]):
            h = mixed(h) + key[:, k]
        keys, rows, counts = self.slots()
        slot = (mixed(h) % np.uint64(len(keys))).astype(np.int64)
        known = (size <= LONGEST) & (keys[slot] == key).all(axis=1)
        at, n = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        found = np.flatnonzero(known)
        out, total = [rows[slot[found]].ravel()], len(found) * MOST_IDS
        at[found], n[found] = np.arange(len(found)) * MOST_IDS, counts[slot[found]]
        for new, encode in ((np.flatnonzero(~known & ~odd), self.single), (np.flatnonzero(~known & odd), self.plain)):
            if len(new):
                ids, lens, which, first = self.learned(data, start[new], end[new], encode)
                at[new], n[new] = (total + np.cumsum(lens) - lens)[which], lens[which]
                own = new[first]
                self.remember(key[own], slot[own], ids, lens, size[own])
                out.append(ids)
                total += len(ids)
        return np.concatenate(out), at, n

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and where each text starts; null texts have none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        data, start, odd, first = units(coded.dictionary)
        ids, at, n = self.unit_ids(data, start, odd)
        which = coded.indices.to_numpy()
        several = np.diff(first)[which]
        unit = _expanded(first[which], several)
        ends = np.append(0, np.cumsum(n[unit]))
        bounds = ends[np.append(0, np.cumsum(several))[offsets - offsets[0]]]
        return ids[_expanded(at[unit], n[unit])].astype("<u4"), bounds


@kept("packing", 2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """(start, end) of runs of rows with about `most` bytes of text; one long text is one run."""
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lens):
        yield start, len(lens)


def pieces(docs: DataFrame, path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens.

    A document is its ids and end_id, cut every `sequence` ids. A null or empty text is end_id
    alone. Rows with a null or repeated doc_id are documents like others.
    """
    def run(batches):
        released("packing")
        tok = word_tokenizer(path)
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1)
            rows = []
            for s, e in slices(texts):
                ids, bounds = tok.encode(texts.slice(s, e - s))
                for k in range(e - s):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), sequence):
                        part = own[at:at + sequence]
                        rows.append((ids_of[s + k], at, len(part), zlib.crc32(part), len(own)))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            released("packing")

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple]:
    """Patterns (number of packs, [(length, copies, offset), …]) that hold all pieces.

    Packs with the same content are one pattern with a count. A length goes into the emptiest
    pattern with room; several copies at once where one would leave it still the emptiest.
    """
    open_: dict[int, list] = {}
    room: list[int] = []
    done: list[tuple] = []

    def add(space: int, count: int, content: tuple) -> None:
        if space == 0:
            done.append((count, content))
            return
        if space not in open_:
            open_[space] = []
            heapq.heappush(room, -space)
        open_[space].append((count, content))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = -room[0] if room else 0
            if space < length:
                # No pack has room: open packs that hold as many copies as fit, and one for the rest.
                space, content, copies = sequence, (), min(left, sequence // length)
                count = left // copies
                used = count * copies
            else:
                group = open_[space]
                count, content = group.pop()
                if not group:
                    del open_[space]
                    heapq.heappop(room)
                second = -room[0] if room else 0
                copies = max(1, min(space // length, (space - second) // length))
                if left < count:
                    add(space, count - left, content)
                    count, copies = left, 1
                else:
                    copies = min(copies, left // count)
                used = count * copies
            offset = sequence - space
            add(space - copies * length, count, (*content, (length, copies, offset)))
            left -= used
    for groups in open_.values():
        done.extend(groups)
    return done


def place_rows(patterns: list[tuple]) -> list[tuple]:
    """(length, first rank, last rank, packs, first sequence, offset) of every place."""
    rows, rank, sequence = [], {}, 0
    for count, content in patterns:
        for length, copies, offset in content:
            first = rank.get(length, 0)
            rank[length] = first + count * copies
            rows.append((length, first, first + count * copies - 1, count, sequence, offset))
        sequence += count
    return rows


def pack(docs: DataFrame, path: str, end_id: int = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of all docs with sequence_id and offset in it; see pieces() for the columns."""
    spark = docs.sparkSession
    steps = Steps(spark, "packing")
    cut = steps.save(pieces(docs, path, end_id, sequence), "pieces")
    # At most `sequence` rows.
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    total = sum(histogram.values())
    places = spark.createDataFrame(
        place_rows(shortest_pack_first(histogram, sequence)),
        "_len long, _first long, _last long, _packs long, _seq long, _at long")
    numbered = ranked(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", buckets_for(total))
    nth = F.col("_rank") - F.col("_first")
    return numbered.join(F.broadcast(places), (F.col("length") == F.col("_len")) & F.col("_rank").between(
        F.col("_first"), F.col("_last"))).select(
        *cut.columns, (F.col("_seq") + nth % F.col("_packs")).alias("sequence_id"),
        (F.col("_at") + F.floor(nth / F.col("_packs")) * F.col("length")).cast("long").alias("offset"))


def op2_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                public_tokenizers.path("word_bpe_49k.json"))
