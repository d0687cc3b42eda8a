"""Word shingles of texts as 64-bit values, in Arrow batches.

Words are stretches without white space, with A-Z in lower case. A text's set holds its
distinct shingles of `words` words; a text with fewer words has the whole sequence as its one
shingle, a text without words the empty set. Two texts are compared by their full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from domainsieve.llm.common import kept, released, text_batches

SLICE_BYTES = 2 << 20
# Bytes of text whose words are hashed at once.
HASH_BYTES = 1 << 19
# Thai and Lao, Myanmar, Khmer, kana, Han, compatibility Han.
UNSPACED = "\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A random value for each byte, the same for A-Z as for a-z.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 2 ** 64)
# Longer words are hashed one by one; of shorter ones no two differ by a multiple of 2 ** 64 for any base.
_LONG_WORD = 256


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@kept("shingles", 1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, HASH_BYTES + 1), _powers(_INVERSE, HASH_BYTES + 1)


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:end], which do not depend on where they lie."""
    n = len(data)
    # More than HASH_BYTES are one word.
    power, inverse = _kept_powers() if n <= HASH_BYTES else (_powers(_BASE, n), _powers(_INVERSE, 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k]:end[k]].tobytes().lower())
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and where each text starts."""
    own = pa.concat_arrays([pc.fill_null(texts, ""), pa.array([], pa.string())])
    offsets = np.frombuffer(own.buffers()[1], np.int32, len(own) + 1) if len(own) else np.zeros(1, np.int32)
    if not offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(own) + 1, np.int64)
    data = np.frombuffer(own.buffers()[2], np.uint8, offsets[-1])
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    # A word begins after white space or with its text, and ends before white space or with its text.
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out, k = np.zeros(len(start), np.uint64), 0
    while k < len(start):
        # Some words at a time, so that a very long text takes no more memory than its own.
        low = int(start[k])
        stop = max(k + 1, int(np.searchsorted(end, low + HASH_BYTES, "right")))
        out[k:stop] = _hashed(data[low:int(end[stop - 1])], start[k:stop] - low, end[k:stop] - low)
        k = stop
    return out, np.searchsorted(start, offsets)


def spaced(texts: pa.Array) -> pa.Array:
    """texts with a space on both sides of every character of the scripts that write none, so that
    each is a word of its own."""
    own = pa.concat_arrays([pc.fill_null(texts, ""), pa.array([], pa.string())])
    data = own.buffers()[2]
    # Their UTF-8 begins with a byte from E0 on, which few other texts have.
    if data is None or not (np.frombuffer(data, np.uint8) >= 0xE0).any():
        return own
    return pc.replace_substring_regex(own, f"([{UNSPACED}])", r" \1 ")


def shingle_set(h: np.ndarray, words: int) -> np.ndarray:
    """Sorted distinct shingles of a text's word hashes."""
    if not len(h):
        return h
    size = min(words, len(h))
    s = np.full(len(h) - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        s = mixed(s * _ODD[k % 3] + h[k:len(h) - size + 1 + k])
    return np.unique(s)


def _order(s: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The order by owner, then value."""
    if not len(owner) or int(owner.max()) >= 1 << 20:
        return np.lexsort((s, owner))
    # One sort by the owner and the upper bits, unless two values of an owner differ only below.
    both = owner.astype(np.uint64) << np.uint64(44) | s >> np.uint64(20)
    order = np.argsort(both)
    near = both[order]
    values = s[order]
    if ((near[1:] == near[:-1]) & (values[1:] != values[:-1])).any():
        return np.lexsort((s, owner))
    return order


def shingle_table(h: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All sets of shingle_set() in a row, for texts that start at `at` in h: values, and where
    each text's set starts. One pass over all texts at once."""
    lens = np.diff(at)
    owner = np.repeat(np.arange(len(lens)), lens)
    many = max(0, len(h) - words + 1)
    s = np.full(many, np.uint64(words), np.uint64)
    for k in range(words):
        s = mixed(s * _ODD[k % 3] + h[k:k + many])
    # Shingles that reach into the next text do not count.
    whole = np.arange(len(s)) + words <= at[1:][owner[:len(s)]]
    s, owner = s[whole], owner[:len(s)][whole]
    few = np.flatnonzero((lens > 0) & (lens < words))
    if len(few):
        s = np.append(s, np.concatenate([shingle_set(h[at[i]:at[i + 1]], words) for i in few]))
        owner = np.append(owner, few)
    order = _order(s, owner)
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    return s[new], np.append(0, np.cumsum(np.bincount(owner[new], minlength=len(lens))))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    lens = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lens.tolist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lens):
        yield start, len(lens)


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of a column's texts, some rows at a time; see shingle_table()."""
    for s, e in slices(column):
        yield shingle_table(*word_hashes(column.slice(s, e - s)), words)


def with_sets(items: DataFrame, words: int) -> DataFrame:
    """(id, n, set) of items (id, text); the empty set is an empty array."""
    def run(batches):
        released("shingles")
        for batch in batches:
            at = 0
            for values, starts in sets_of(batch.column(1), words):
                lens = np.diff(starts)
                sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(lens)), pa.array(lens.astype(np.int32)), sets],
                    names=["id", "n", "set"])
                at += len(lens)
            released("shingles")

    text_batches(items.sparkSession)
    return items.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "id long, n int, set array<long>")
