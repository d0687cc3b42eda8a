"""Exact, near, paragraph and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from domainsieve.llm import exact_dedup, line_runs, minhash, paragraphs
from domainsieve.llm.common import Steps, components as spark_components
from llm_helpers import components, docs, edited, prose, shingles, words

EXTRA = "doc_id long, text string, kept string, key int, n_removed int, text_kept string"


# -- exact --------------------------------------------------------------------

def strip(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_rice_code():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        v = np.sort(rng.integers(0, 2 ** 40, n, dtype=np.uint64))
        v = np.unique(v)
        k, unary, rest = exact_dedup.rice_encode(v)
        assert np.array_equal(exact_dedup.rice_decode(len(v), k, unary, rest), v)


EXACT = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, "other"), (5, None), (6, ""), (7, " \t\n"), (8, "ab "), (9, "a b"),
         (10, "ü" * 30_000), (11, "ü " * 30_000), (None, "ab"), (None, "no id"), (4, "other"), (4, "other"), (12, "hot")]
EXACT += [(100 + i, "hot") for i in range(300)]


@pytest.mark.parametrize("sender_rows, spare", [(1 << 18, 10), (20, -6)])
def test_exact_groups(spark, monkeypatch, sender_rows, spare):
    """Few spare bits give false suspects, which the byte check clears."""
    monkeypatch.setattr(exact_dedup, "SENDER_ROWS", sender_rows)
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", spare)
    monkeypatch.setattr(exact_dedup, "OWNER_ROWS", 100)
    got = exact_dedup.exact_groups(docs(spark, EXACT).repartition(4)).collect()
    groups = defaultdict(list)
    for i, t in EXACT:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(EXACT)
    kept = Counter()
    for r in got:
        g = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(g)
        assert (r.keep_id, r.group_size) == (None if best[1] else best[2], len(g))
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_distinct_documents_keep_columns_and_one_of_each(spark):
    rows = [(i, t, "k", 1, 2, "x") for i, t in EXACT]
    d = docs(spark, rows, EXTRA)
    got = exact_dedup.distinct_documents(d)
    assert got.columns == d.columns
    assert Counter(strip(r.text) for r in got.collect()) == Counter({strip(t): 1 for _, t in EXACT})
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0
    assert exact_dedup.distinct_documents(d.limit(0)).count() == 0


# -- near ---------------------------------------------------------------------

def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.label for r in spark_components(d, Steps(spark, "test")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in want.items())
    assert spark_components(d.limit(0), Steps(spark, "test")).count() == 0


def test_signature_is_circulant():
    """Coordinate k is the smallest value of the second permutation, shifted by k."""
    sets = np.unique(np.random.default_rng(1).integers(0, 2 ** 63, 50, dtype=np.uint64))
    first = np.random.default_rng(11).permutation(minhash.PLACES)
    second = np.random.default_rng(23).permutation(minhash.PLACES)
    at = first[(sets >> np.uint64(44)).astype(int)]
    want = [second[(at + k) % minhash.PLACES].min() for k in range(40)]
    assert minhash.signature(sets, 40).tolist() == want


def near_rows(rng):
    base = [prose(rng, n) for n in (8, 40, 120, 400)]
    rows = [base[i % 4] if i % 5 == 0 else edited(rng, base[i % 4], rng.randrange(1, 12)) for i in range(160)]
    rows += [edited(rng, base[2], k) for k in (1, 2, 3) for _ in range(40)]
    rows += [prose(rng, 60) + " " + base[1] for _ in range(40)] + [prose(rng, 50) for _ in range(40)]
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size, percent, block", [(3, 85, 30_000), (5, 80, 5_000)])
def test_near_duplicates(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    rows = near_rows(rng) + [(2001, None), (2002, ""), (2003, " \n"), (2004, "one"), (2005, "ONE"), (2006, "two words"),
                             (2007, prose(rng, 30_000)), (2008, None), (7000, "Repeated row"), (7000, "Repeated row")]
    got = minhash.near_duplicates(docs(spark, rows), size, percent).collect()
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("block", [None, 40_000])
def test_bucket_of_many_unlinked_near_copies(spark, monkeypatch, block):
    """2000 sets that share 100 of 130 values pairwise, which is no link, and some that do link."""
    if block:
        monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(8)
    core = list(range(100))
    own = [[1000 + 15 * i + k for k in range(15)] for i in range(2000)]
    for i in range(0, 2000, 100):  # these share ten of their own values with the one before
        own[i + 1][:10] = own[i][:10]
    sets = [(i, sorted(core + v)) for i, v in enumerate(own)]
    sets += [(3000 + i, sorted(rng.sample(range(10 ** 6, 2 * 10 ** 6), 30))) for i in range(50)]
    # The largest component is that of the rows 1000 to 1009.
    members = spark.createDataFrame([(7, i, 1000 if 1000 <= i < 1010 else i) for i, _ in sets] + [(8, 1, 1), (8, 2, 2), (8, 100, 100)],
                                    "key long, id long, comp long")
    table = spark.createDataFrame([(i, len(v), v) for i, v in sets], "id long, n int, set array<long>")
    steps = minhash.Steps(spark, "rest")
    members = steps.save(members, "members")
    got = {tuple(sorted(r)) for r in minhash.rest_links(members, steps.save(table, "sets"), 80, steps).collect()}
    want = {(i, i + 1) for i in range(0, 2000, 100)} - {(1000, 1001)}
    assert got == want


def test_near_duplicates_without_ids_and_rows(spark):
    d = docs(spark, [(None, "same words here", "k", 1, 2, "x"), (None, "same words here", "k", 1, 2, "x"),
                     (1, "same words here", "k", 1, 2, "x"), (0, "same words HERE", "k", 1, 2, "x")], EXTRA)
    got = sorted(map(str, minhash.near_duplicates(d).select("doc_id", "component_id", "kept").collect()))
    assert len(got) == 4 and sum("component_id=None, kept=True" in g for g in got) == 2
    kept = minhash.distinct_documents(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "None", "None"]
    assert minhash.near_duplicates(d.limit(0)).count() == 0


def test_band_shape():
    for percent in (80, 85, 90, 100):
        bands, rows = minhash.band_shape(percent)
        assert bands <= minhash.MOST_BANDS and (1 - (percent / 100) ** rows) ** bands <= 1e-6


# -- paragraphs ---------------------------------------------------------------

def test_paragraphs(spark):
    rng = random.Random(12)
    passage, other = prose(rng, 60), prose(rng, 30)
    rows = [(i, "\n".join([prose(rng, 30), edited(rng, passage, i % 3), prose(rng, 5)])) for i in range(1, 40)]
    rows += [(50, other), (51, f"{prose(rng, 25)}\n{other}\n{other}"), (52, None), (53, ""), (54, "short line\nshort line"),
             (55, prose(rng, 20_000)), (60, f"{other}\nends"), (60, f"{other}\nends"), (None, other)]
    d = docs(spark, [(*r, "k", 1, 2, "x") for r in rows], EXTRA)
    lines = {(i, k): line for i, t in rows if i is not None and t is not None
             for k, line in enumerate(t.split("\n")) if len(words(line)) >= 20}
    sets = {k: shingles(v, 5) for k, v in lines.items()}
    comp = components(sets, [(a, b) for a, b in combinations(sets, 2)
                             if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = paragraphs.dedup_paragraphs(d)
    assert set(got.columns) == {*d.columns, "n_paragraphs"}
    for r in got.collect():
        if r.doc_id is None or r.text is None:
            assert (r.text_kept, r.n_removed) == (r.text, 0)
            continue
        all_ = r.text.split("\n")
        kept = [x for k, x in enumerate(all_) if comp.get((r.doc_id, k), (r.doc_id, k)) == (r.doc_id, k)]
        assert (r.text_kept, r.n_paragraphs, r.n_removed) == ("\n".join(kept), len(all_), len(all_) - len(kept))
    assert sum(passage in (r.text_kept or "") for r in got.collect()) <= 1
    assert paragraphs.dedup_paragraphs(d.limit(0)).count() == 0


# -- passages -----------------------------------------------------------------

def test_passages_inside_and_across_lines(spark):
    """A run of 50 words goes from inside a longer line, over two lines and over wrapped lines."""
    rng = random.Random(31)
    p = prose(rng, 50, 10 ** 6)
    w = p.split(" ")
    a = [prose(rng, 70, 10 ** 6) for _ in range(12)]
    wrapped = "\n".join(" ".join(w[k:k + 10]) for k in range(0, 50, 10))
    rows = [(1, f"{a[0]} {p} {a[1]}"), (2, f"{a[2]}  {p.upper()}\t{a[3]}\r\nend"), (3, f"{a[4]} {' '.join(w[:20])}\n{' '.join(w[20:])} {a[5]}"),
            (4, f"title\n{wrapped}\n{a[6]}"), (5, f"{a[7]} {' '.join(w[1:])} {a[8]}"), (6, f"{wrapped}\n\nlast words"),
            (7, f"{a[9]} {p}"), (8, p), (8, p), (None, f"{a[10]} {p} {a[11]}")]
    want = {1: rows[0][1], 2: f"{a[2]}  {a[3]}\r\nend", 3: f"{a[4]}\n{a[5]}", 4: f"title\n{a[6]}", 5: rows[4][1],
            6: "\nlast words", 7: a[9], 8: "", None: rows[-1][1]}
    n_gone = {4: 5, 6: 5, 8: 1}
    got = paragraphs.dedup_substrings(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.text_kept, r.n_removed) == (want[r.doc_id], n_gone.get(r.doc_id, 0)), r.doc_id


def test_passages_brute_force(spark):
    """Overlapping copies, copies of copies, repeats within a text and short periods."""
    rng = random.Random(32)
    pool = prose(rng, 600, 10 ** 6).split(" ")
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(1, 5)):
            lo, n = rng.randrange(500), rng.choice([30, 49, 50, 51, 90])
            w += prose(rng, rng.randrange(40), 10 ** 6).split(" ") + pool[lo:lo + n]
        rows.append((i, "\n".join(" ".join(w[k:k + 12]) for k in range(0, len(w), 12))))
    rows += [(100 + n, "\n".join(f"v{n} u{n}" for _ in range(n))) for n in (40, 49, 50, 51, 120)]
    seen, want = {}, {}
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - 49):
            first = seen.setdefault(tuple(w[k:k + 50]), (i, k))
            if first[0] != i or k >= first[1] + 50:
                gone.update(range(k, k + 50))
        want[i] = [x for k, x in enumerate(w) if k not in gone]
    got = paragraphs.dedup_substrings(docs(spark, rows).repartition(5)).collect()
    assert {r.doc_id: words(r.text_kept) for r in got} == want
    assert sum(len(words(t)) for _, t in rows) > sum(map(len, want.values())) + 2000


def test_passages_of_unspaced_text(spark):
    """2000 Han characters: twice as a whole text, inside a longer line, and on a line of their own."""
    rng = random.Random(33)
    han = (lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(n)))
    p, a, b = han(2000), han(1500), han(70)
    rows = [(1, p), (2, p), (3, a + p + b), (4, f"{b[::-1]}\n{p}\nend"), (5, a[::-1])]
    got = {r.doc_id: (r.text_kept, r.n_removed) for r in paragraphs.dedup_substrings(docs(spark, rows)).collect()}
    assert got == {1: (p, 0), 2: ("", 1), 3: (a + b, 0), 4: (f"{b[::-1]}\nend", 1), 5: (a[::-1], 0)}


# -- lines --------------------------------------------------------------------

def without_runs(rows, size, long_):
    """Brute force over (doc_id, text): lines left after removing later copies of runs, and of lines
    of at least long_ words."""
    seen, out = set(), {}
    for i, t in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - size + 1):
            run = tuple(lines[k:k + size])
            if run in seen:
                gone.update(range(k, k + size))
            seen.add(run)
        for k, x in enumerate(lines):
            if (0, x) in seen and x.count(" ") + 1 >= long_:
                gone.add(k)
            seen.add((0, x))
        out[i] = [x for k, x in enumerate(lines) if k not in gone]
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_line_runs(spark, size):
    rng = random.Random(size)
    rows = [(i, "\n".join(f"line {rng.randrange(9)}" for _ in range(rng.randrange(1, 14)))) for i in range(80)]
    long = "\n".join(f"unique {k}" for k in range(70))
    rows += [(200, long), (201, f"head\n{long}\ntail"), (202, None), (203, ""), (204, "x\nx\nx\nx"), (205, "\n\n\n"), (None, long)]
    d = docs(spark, rows + [rows[3]])
    passage = prose(rng, 25)
    rows += [(300, passage), (301, passage), (302, f"{passage}\n{prose(rng, 19)}"), (303, f"a\n{passage}\nb {size}"),
             (304, f"{passage}\n{passage}"), (305, "one two\nother"), (306, "one two\nmore")]
    d = docs(spark, rows + [rows[3]])
    want = without_runs(rows, size, 20)
    assert size == 1 or (want[301], want[304], want[306]) == ([], [], ["one two", "more"])
    got = line_runs.without_repeated_runs(d, size).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is None or r.text is None:
            assert r.text_kept == r.text
        else:
            assert r.text_kept == "\n".join(want[r.doc_id]) and r.n_kept == len(want[r.doc_id]), r
    assert line_runs.without_repeated_runs(d.limit(0), size).count() == 0


def test_suffix_array_depths(spark):
    """A start carries the longest power of two of lines that has an earlier copy."""
    long = [f"unique {k}" for k in range(20)]
    d = docs(spark, [(1, "\n".join(long)), (2, "\n".join(["head", *long[3:14], "tail"]))])
    steps = Steps(spark, "test")
    lines = steps.save(line_runs.line_keys(d), "lines")
    starts, depths = line_runs.repeated_starts(lines, 2, steps)
    assert sorted(r.i for r in starts.collect()) == list(range(1, 11))
    assert {r.i: r.lines for r in depths.collect()} == {
        k: max(p for p in (1, 2, 4, 8) if p <= 12 - k) for k in range(1, 12)}
