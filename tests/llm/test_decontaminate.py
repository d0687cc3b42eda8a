import hashlib
import random
import re

import pytest
from llm_helpers import LOWER, docs, prose

from domainsieve.llm import decontaminate as dc

ITEMS = "item_id long, text string, spans int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, items, size=10):
    out = []
    for id_, text in rows:
        w, hit, found = words(text), set(), set()
        for item, question, *_ in items:
            q = words(question)
            for i in range(max(1, len(q) - size + 1) if q else 0):
                window = q[i:i + size]
                for j in range(len(w) - len(window) + 1):
                    if w[j:j + len(window)] == window:
                        hit |= set(range(j, j + len(window)))
                        found.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((id_, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def run(spark, rows, items, **kw):
    d = docs(spark, [(*r, "x") for r in rows], "doc_id long, text string, n_hit string")
    got = dc.contaminated(d, spark.createDataFrame(items, ITEMS), **kw).collect()
    return got, sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
                        for r in got), key=repr)


def planted(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 40]), 30), 0) for i in range(40)]
    items += [(3, items[5][1], 0), (None, prose(rng, 14, 30), 0), (90, None, 0), (91, "", 0), (92, " .,! ", 0)]
    rows = []
    for i in range(60):
        w = words(prose(rng, rng.randrange(60), 30))
        for _ in range(rng.randrange(3)):
            q = words(rng.choice(items)[1])
            s = rng.randrange(len(q) + 1)
            at = rng.randrange(len(w) + 1)
            w[at:at] = q[s:s + rng.randint(1, 30)]
        rows.append((i, rng.choice([" ", ", ", ".\n"]).join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return [*rows, (70, None), (71, ""), (None, rows[0][1]), (72, rows[1][1]), (72, rows[1][1])], items


@pytest.mark.parametrize("seed, size", [(1, 10), (2, 10), (3, 4)])
def test_equals_brute_force(spark, seed, size):
    rows, items = planted(seed)
    want = brute(rows, items, size)
    assert sum(r[5] for r in want) > 10
    assert run(spark, rows, items, size=size)[1] == want


def test_blocks_give_the_same(spark):
    rows, items = planted(4)
    assert run(spark, rows, items, block_words=400)[1] == brute(rows, items)


def test_small_pieces_give_the_same(monkeypatch):
    rows, items = planted(5)
    scanner = dc.Scanner(dc.windows_of([(str(i), q) for i, q, _ in items], 10))
    whole = [scanner.scan(t) for _, t in rows]
    spans = [dc.character_spans(t, s) for (_, t), (_, s, _) in zip(rows, whole)]
    monkeypatch.setattr(dc, "PIECE", 3)
    assert [scanner.scan(t) for _, t in rows] == whole
    assert [dc.character_spans(t, s) for (_, t), (_, s, _) in zip(rows, whole)] == spans


def test_spans_of_the_original_text(spark):
    text = "Voilà — ÉTÉ 1, the  Quick\nbrown-fox; jumps over the lazy dog today. Rest."
    items = [(1, "The quick brown fox jumps over the lazy dog today", 0), (2, "Été 1", 0), (3, "voilà — été", 0)]
    got, _ = run(spark, [(1, text)], items)
    # Only A-Z are lowered, so the accented capitals differ from the small ones.
    assert [text[a:b] for a, b in got[0]["spans"]] == ["the  Quick\nbrown-fox; jumps over the lazy dog today"]
    assert got[0]["n_hit"] == 10 and got[0]["n_items"] == 1


def test_empty_tables_and_very_long_text(spark):
    rows, items = planted(6)
    assert run(spark, [], items)[1] == []
    assert all(not r[5] and r[3] == 0 for r in run(spark, rows, [])[1])
    long = " ".join(["w1 w2"] * 300_000) + " " + " ".join(f"q{i}" for i in range(12)) + "x" * 2_000_000
    got = run(spark, [(1, long)], [(1, " ".join(f"q{i}" for i in range(11)), 0)])[1]
    assert [(r[1], r[2], r[3]) for r in got] == [(600_012, 11, 1)]
