import random

import numpy as np
import pyarrow as pa

from domainsieve.llm import shingles as sh
from llm_helpers import shingles, words


def texts(rng):
    stock = ["a", "B", "b", "ab", "ÀB", "àb", "x" * 255, "x" * 256, "x" * 257, "Y" * 300, "y" * 300, "日本", "\x00", "\x85"]
    gaps = [" ", "\t", "\n", "\r\n", "\x0b", "\x0c ", "   "]
    return ["".join(rng.choice(gaps) * rng.randrange(2) + rng.choice(stock) + rng.choice(gaps) for _ in range(rng.randrange(30)))
            + rng.choice(["", "end"]) for _ in range(200)] + ["", " ", "one", None]


def test_words_have_one_hash_wherever_they_lie(monkeypatch):
    rng = random.Random(1)
    rows = texts(rng)
    h, at = sh.word_hashes(pa.array(rows))
    of = {}
    for t, a, b in zip(rows, at, at[1:]):
        found = words(t)
        assert len(found) == b - a
        for w, x in zip(found, h[a:b].tolist()):
            assert of.setdefault(w, x) == x
    assert len(set(of.values())) == len(of)
    sh._kept_powers.cache_clear()
    monkeypatch.setattr(sh, "HASH_BYTES", 120)
    assert (sh.word_hashes(pa.array(rows))[0] == h).all()
    monkeypatch.undo()
    sh._kept_powers.cache_clear()
    part = sh.word_hashes(pa.array(rows).slice(50, 20))
    assert (part[0] == h[at[50]:at[70]]).all()
    assert [len(x) for x in sh.word_hashes(pa.array([], pa.string()))] == [0, 1]


def test_no_two_of_many_words_share_a_hash():
    made = [f"{i:x}" for i in range(200_000)] + [f"{i}" * 2 for i in range(100_000)]
    distinct = list(dict.fromkeys(made))
    assert len(np.unique(sh.word_hashes(pa.array(distinct))[0])) == len(distinct)


def test_sets_are_those_of_the_words():
    rng = random.Random(2)
    rows = texts(rng)
    for size in (1, 3, 5):
        values, starts = sh.shingle_table(*sh.word_hashes(pa.array(rows)), size)
        sets = [frozenset(values[a:b].tolist()) for a, b in zip(starts, starts[1:])]
        want = [shingles(t, size) for t in rows]
        assert [len(s) for s in sets] == [len(s) for s in want]
        for i in range(0, 200, 7):
            for j in range(i, 200, 11):
                assert len(sets[i] & sets[j]) == len(want[i] & want[j])
        assert all((np.diff(values[a:b].astype(float)) >= 0).all() for a, b in zip(starts, starts[1:]))


def test_order_where_upper_bits_tie():
    s = np.array([5, 3, 5, 4, 1 << 50], np.uint64)
    owner = np.array([0, 0, 0, 0, 0])
    assert s[sh._order(s, owner)].tolist() == [3, 4, 5, 5, 1 << 50]
