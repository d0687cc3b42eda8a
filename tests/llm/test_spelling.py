import random
import re
import zlib
from collections import Counter

import pytest
from llm_helpers import LOWER, docs

from domainsieve.llm import spelling


def counted(rows, noise=31, least=7):
    total = Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= least:
                total[run] += 1
    return total


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, ratio=10):
    words = sorted(counts)
    near_of = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, others in near_of.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= ratio * counts[w]:
                form[w] = best
    out = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.add((w, counts[w], len(near_of[w]), form.get(w), counts[form[w]] if w in form else None, root))
    return out


def result(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def texts(seed, n, words=60):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(5, 9))) for _ in range(words)]
    rows = []
    for i in range(n):
        some = []
        for _ in range(rng.randint(0, 40)):
            w = stock[min(int(rng.expovariate(0.1)), words - 1)]
            if rng.random() < 0.1:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "b", w[k] + "a", "É"]) + w[k + 1:]
            some.append(w.upper() if rng.random() < 0.05 else w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(some)))
    return rows


def test_words_of_documents(spark):
    rows = [*texts(1, 80), (None, "nothing Nothing"), (901, None), (902, ""), (903, "naïvetés×÷ÿ-naïvetés"), (903, "again again")]
    assert {r["word"]: r["n"] for r in spelling.noisy_words(docs(spark, rows)).collect()} == counted(rows)


def test_words_are_counted_alike_in_small_pieces_and_memories(spark, monkeypatch):
    rows = [(7, " ".join(t for _, t in texts(2, 60)))]
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert "".join(spelling._pieces(rows[0][1])) == rows[0][1]
    whole = Counter(re.findall("[A-Za-zÀ-ÿ]{7,}", rows[0][1]))
    assert sum((Counter(re.findall("[A-Za-zÀ-ÿ]{7,}", p)) for p in spelling._pieces(rows[0][1])), Counter()) == whole
    assert {r["word"]: r["n"] for r in spelling.noisy_words(docs(spark, rows)).collect()} == counted(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_variants_equal_all_pairs(spark, seed):
    rows = texts(seed, 200)
    counts = {w: n for w, n in counted(rows).items() if n >= 2}
    got = result(spelling.variants(spelling.noisy_words(docs(spark, rows))))
    assert got == brute(counts)
    assert sum(f is not None for _, _, _, f, _, _ in got) > 5


def test_several_passes_and_full_filters(spark, monkeypatch):
    rng = random.Random(5)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))): rng.choice([1, 2, 30, 500])
              for _ in range(700)}
    monkeypatch.setattr(spelling, "PASS_BLOCKS", 40)
    monkeypatch.setattr(spelling, "LEAST_BLOCKS", 4)
    monkeypatch.setattr(spelling, "BITS_A_WORD", 4)
    monkeypatch.setattr(spelling, "LONG", 6)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert result(spelling.variants(words, 4, 1, 3)) == brute(counts, 3)


def test_chain_of_forms_and_ties(spark):
    counts = {"colouring": 100_000, "coloring": 900, "colorin": 8, "colorinq": 8, "zzzzzzz": 3, "zzzzzza": 30, "zzzzzzb": 30}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got["colorin"]["form"] == "coloring" and got["colorin"]["root"] == "colouring"
    assert got["zzzzzzz"]["form"] == "zzzzzza" and got["zzzzzzz"]["n_near"] == 2
    assert got["zzzzzza"]["form"] is None and got["zzzzzza"]["root"] == "zzzzzza"


def test_edges(spark):
    words = spark.createDataFrame(
        [("repeated", 1, 5), ("repeated", 1, 6), (None, 4, 1), ("", 9, 1), ("nothing", None, 1), ("x" * 5000, 2, 0),
         ("x" * 4999, 40, 0), ("\U0001F600" * 7, 2, 0), ("\U0001F600" * 8, 3, 0)], "word string, n long, form int")
    got = {r["word"]: (r["n"], r["n_near"], r["form"]) for r in spelling.variants(words).collect()}
    assert got == {"repeated": (2, 0, None), "x" * 5000: (2, 1, "x" * 4999), "x" * 4999: (40, 1, None),
                   "\U0001F600" * 7: (2, 1, None), "\U0001F600" * 8: (3, 1, None)}
    assert spelling.variants(words.limit(0)).count() == 0
    assert spelling.noisy_words(docs(spark, [])).count() == 0
