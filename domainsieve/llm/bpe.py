"""Byte-level BPE encoding and decoding.

A text is cut by the pattern into matches; each match is merged by the rank file. The merge
loop keeps a segment tree over the match's byte positions: a leaf holds the rank of the pair
that starts there, a node the leftmost smallest rank below it. A merge reads the root and
updates three leaves (the merged pair, the swallowed byte, the left neighbour) in logarithmic
time. Short matches run in batches, one tree per row of an array; long ones run one by one.

Documents stay where they are: no shuffle. Each worker keeps a bounded memory of units (a
stretch without white space, with the one space before it) that it has seen.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import with_fields

# Units longer than this many bytes are merged one by one.
BATCH_BYTES = 64
# Bytes of units and ids that a worker remembers; beyond, it keeps those of the texts at hand.
REMEMBERED = 200 << 20
# Longer units are not remembered. Each one kept takes so many bytes beside its own.
LONGEST, OVERHEAD = 64, 180
_NONE = np.int64(1) << 40
# The white space of Unicode, as the pattern's \s means it.
_WHITE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Ranks:
    """A rank file: bytes of each id, and the ranks of pairs of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(t): int(r) for t, r in rows}
        top = max(self.ids.values()) + 1
        self.bytes_of = [b""] * top
        for t, r in self.ids.items():
            self.bytes_of[r] = t
        self.byte_id = np.zeros(256, np.int64)
        for b in range(256):
            self.byte_id[b] = self.ids[bytes([b])]
        keys, ranks = [], []
        for t, r in self.ids.items():
            for cut in range(1, len(t)):
                a, b = self.ids.get(t[:cut]), self.ids.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int64)[order], 0)
        self.pair = dict(zip(keys, ranks))

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; _NONE where it is no token or where a side is missing (-1)."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], _NONE)


def merge_batch(units: list[bytes], ranks: Ranks) -> list[bytes]:
    """Ids of units of at most BATCH_BYTES bytes, as little-endian unsigned 32-bit integers."""
    n, longest = len(units), max(map(len, units))
    size = 1 << max(1, (longest - 1).bit_length())
    lens = np.fromiter(map(len, units), np.int64, n)
    flat = np.frombuffer(b"".join(u.ljust(size, b"\0") for u in units), np.uint8).reshape(n, size)
    place = np.arange(size)
    token = np.where(place < lens[:, None], ranks.byte_id[flat], -1)
    after = np.tile(np.append(place[1:], size), (n, 1))
    before = np.tile(place - 1, (n, 1))
    right = np.full_like(token, -1)
    right[:, :-1] = token[:, 1:]
    # Heap layout: node k has children 2k and 2k+1, leaves start at `size`. A node's value is
    # rank * size + position, so that the smallest value is the leftmost smallest rank.
    tree = np.empty((n, 2 * size), np.int64)
    tree[:, size:] = ranks.of_pairs(token, right) * size + place
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
    limit = _NONE * size
    live = np.flatnonzero(tree[:, 1] < limit)
    while live.size:
        rank, p = tree[live, 1] // size, tree[live, 1] % size
        q = after[live, p]
        r = after[live, q]
        token[live, p] = rank
        token[live, q] = -1
        after[live, p] = r
        inside = r < size
        before[live[inside], r[inside]] = p[inside]
        o = before[live, p]
        next_token = np.where(inside, token[live, np.minimum(r, size - 1)], -1)
        left = o >= 0
        prev_token = token[live[left], o[left]]
        for rows, leaf, value in (
                (live, q, np.full(live.size, limit)),
                (live, p, ranks.of_pairs(rank, next_token) * size + p),
                (live[left], o[left], ranks.of_pairs(prev_token, rank[left]) * size + o[left])):
            tree[rows, size + leaf] = value
            node = (size + leaf) >> 1
            while node.size and node[0]:
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                node >>= 1
        live = live[tree[live, 1] < limit]
    kept = token >= 0
    ids = token[kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(axis=1)) * 4
    starts = np.append(0, ends[:-1])
    return [ids[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def merge_one(unit: bytes, ranks: Ranks) -> bytes:
    """Ids of one unit of any length, by the same tree in plain lists."""
    n = len(unit)
    size = 1 << max(1, (n - 1).bit_length())
    token = ranks.byte_id[np.frombuffer(unit, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair, none = ranks.pair, int(_NONE)
    limit = none * size
    tree = [limit] * (2 * size)
    for i in range(n - 1):
        r = pair.get(token[i] << 32 | token[i + 1])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low
            k >>= 1

    while tree[1] < limit:
        rank, p = divmod(tree[1], size)
        q = after[p]
        r = after[q]
        token[p], token[q], after[p] = rank, -1, r
        put(q, limit)
        if r < n:
            before[r] = p
        found = pair.get(rank << 32 | token[r]) if r < n else None
        put(p, limit if found is None else found * size + p)
        o = before[p]
        if o >= 0:
            found = pair.get(token[o] << 32 | rank)
            put(o, limit if found is None else found * size + o)
    return np.array([t for t in token if t >= 0], "<u4").tobytes()


class Encoder:
    """Texts to packed ids. Keeps the short units it has seen, up to REMEMBERED bytes."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.pattern = Ranks(path), regex.compile(pattern)
        # A unit ends where white space starts, so that no match of the pattern crosses units.
        self.units = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall
        # White space other than space and line feed, or the mark that split() uses.
        self.other = re.compile("[\\x00" + _WHITE.replace("\\x09-\\x0d\\x20", "\\x09\\x0b-\\x0d") + "]").search
        self.seen: dict[str, bytes] = {}
        self.size = 0

    def split(self, text: str) -> list[str]:
        """Units of a text. Single spaces and line feeds need no pattern, only a split."""
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or self.other(text):
            return self.units(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").removeprefix("\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        seen, out, open_, lists = self.seen, [], [], []
        for t in texts:
            units = self.split(t)
            lists.append(units)
            ids = list(map(seen.get, units))
            if None in ids:
                open_.append((len(out), units, ids))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        if open_:
            new = self.learned({u for _, units, ids in open_ for u, i in zip(units, ids) if i is None})
            for at, units, ids in open_:
                out[at] = b"".join([new[u] if i is None else i for u, i in zip(units, ids)])
            self.remember(new, lists)
        return out

    def remember(self, more: dict[str, bytes], current: list[list[str]]) -> None:
        """Keep short units; when that is too much, only those of the lists in `current`."""
        for u, ids in more.items():
            if len(u) <= LONGEST:
                self.seen[u] = ids
                self.size += len(u) + len(ids) + OVERHEAD
        if self.size > REMEMBERED:
            self.seen = {u: self.seen[u] for units in current for u in units if u in self.seen}
            self.size = sum(len(u) + len(ids) + OVERHEAD for u, ids in self.seen.items())

    def learned(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are not remembered."""
        matches = {u: self.pattern.findall(u) for u in units}
        pieces = {m for found in matches.values() for m in found}
        ids: dict[str, bytes] = {}
        short: dict[int, list[str]] = {}
        for m in pieces:
            raw = m.encode()
            known = self.ranks.ids.get(raw)
            if known is not None:
                ids[m] = known.to_bytes(4, "little")
            elif len(raw) > BATCH_BYTES:
                ids[m] = merge_one(raw, self.ranks)
            else:
                short.setdefault((len(raw) - 1).bit_length(), []).append(m)
        for group in short.values():
            for at in range(0, len(group), 4096):
                part = group[at:at + 4096]
                ids.update(zip(part, merge_batch([m.encode() for m in part], self.ranks)))
        return {u: b"".join([ids[m] for m in found]) for u, found in matches.items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _batches(values: pa.Array, chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Texts of a column in lists of about `chars` characters; null is the empty text."""
    start, held, size = 0, [], 0
    for i, v in enumerate(values):
        t = v.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= chars:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encode(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with `ids` (array<int>), the ids of the whole text; null text has no ids.

    Rows keep their order and number; repeated rows are encoded each. Input columns stay.
    """
    def run(batches):
        enc = encoder(path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            packed = [p for _, ts in _batches(batch.column(at)) for p in enc.encode(ts)]
            lens = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
            offsets = np.append(0, np.cumsum(lens)).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    kept = docs.drop("ids")
    return kept.mapInArrow(run, with_fields(kept, {"ids": "array<int>"}))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded` (binary): the bytes that the ids stand for; null ids give none."""
    def run(batches):
        table = encoder(path, public_tokenizers.PATTERN).ranks.bytes_of
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = [b"".join(map(table.__getitem__, v.as_py() or [])) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    kept = rows.drop("decoded")
    return kept.mapInArrow(run, with_fields(kept, {"decoded": "binary"}))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes they decode to.

    Encodes and decodes in one pass and keeps neither ids nor texts. A null text counts as
    empty; rows with a null id or a repeated id are kept as they are.
    """
    def run(batches):
        enc = encoder(path, public_tokenizers.PATTERN)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for _, texts in _batches(batch.column(1)):
                for packed in enc.encode(texts):
                    counts.append(len(packed) // 4)
                    of_ids.append(hashlib.sha256(packed).hexdigest())
                    of_bytes.append(hashlib.sha256(enc.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                   public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
