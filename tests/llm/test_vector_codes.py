import hashlib
import math
import random

import numpy as np
import pytest

from domainsieve.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label string, code int"


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = [c for _, _, c in sorted((i, n, c) for n, ((i, _, _), c) in enumerate(zip(kept, cut)))][:entries]
    books = [[list(c[p]) for c in first] for p in range(parts)]

    def nearest(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            used = {}
            for c in cut:
                used.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, members in used.items():
                books[p][k] = [sum(m[j] for m in members) // len(members) for j in range(width)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(c[p], books[p]) for p in range(parts)]
        err = sum(d for d, _ in best)
        out.append((i, "".join(f"{k:02x}" for _, k in best), err, lab))
        sums[lab] = sums.get(lab, 0) + err
    return sorted((i, c, e, sums[lab], sha) for i, c, e, lab in out)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    rows = [(rng.choice([i, -i]), [float(np.float32(rng.gauss(0, 0.05))) for _ in range(dim)], rng.choice(["a", "b", None]), i)
            for i in range(n)]
    rows += [(n + i, rows[0][1], "a", 0) for i in range(30)]
    return rows + [(-9999, None, "a", 0), (-9998, [1.0] * (dim - 1) + [None], "b", 0),
                   (-9997, [float("nan")] * dim, None, 0), (-9996, [float("inf")] + [0.0] * (dim - 1), "a", 0)]


def run(spark, rows, **kw):
    df = vc.compress(spark.createDataFrame(rows, SCHEMA), **kw)
    assert df.columns == ["vec_id", "embedding", "label", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.mark.parametrize("seed, n, dim, parts, entries, rounds", [
    (1, 300, 64, 16, 64, 2), (2, 200, 12, 3, 16, 3), (3, 40, 16, 16, 64, 2), (4, 120, 8, 2, 5, 0)])
def test_equals_brute_force(spark, seed, n, dim, parts, entries, rounds):
    rows = vectors(seed, n, dim)
    assert run(spark, rows, parts=parts, entries=entries, rounds=rounds) == brute(rows, parts, entries, rounds)


def test_orchard_finds_the_nearest_entry_with_ties():
    rng = np.random.default_rng(5)
    for width, spread in ((1, 3), (2, 4), (4, 6), (8, 2000)):
        entries = rng.integers(-spread, spread, (3, 40, width))
        q = rng.integers(-2 * spread, 2 * spread, (500, 3, width))
        code, near = vc.orchard(q, vc.Codebooks.of(entries))
        d = ((q[:, :, None, :] - entries[None]) ** 2).sum(-1)
        assert (code == d.argmin(2)).all() and (near == d.min(2)).all()


def test_orchard_leaves_entries_out(monkeypatch):
    rng = np.random.default_rng(6)
    entries = rng.integers(-1000, 1000, (1, 64, 2))
    books, looked = vc.Codebooks.of(entries), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and len(key) == 2 and np.ndim(key[1]):
                looked.append(np.size(key[1]))
            return np.asarray(super().__getitem__(key))

    books.entries = entries.view(Counted)
    vc.orchard(rng.integers(-1000, 1000, (1000, 1, 2)), books)
    assert sum(looked) < 0.6 * 64 * 1000


def test_other_lengths_extremes_and_repeats(spark):
    rows = [(i, [0.1 * i] * 16, "a", 0) for i in range(5)]
    odd = [(50, [1.0] * 15, "a", 0), (51, [], None, 0), (52, [3e38] * 16, "z", 0), (None, [0.1] * 16, "a", 0), (4, [0.4] * 16, "a", 0)]
    got = run(spark, rows + odd[:3])
    assert [r[:2] for r in got if r[1] is None] == [(50, None), (51, None), (52, None)]
    coded = [r for r in got if r[1]]
    assert [r[:3] for r in coded] == [r[:3] for r in brute(rows, 16, 64, 2)]
    both = vc.compress(spark.createDataFrame(rows + odd, SCHEMA)).collect()
    assert len(both) == 10 and len({r["code"] for r in both if r["vec_id"] == 4}) == 1
    assert [r["code"] for r in both if r["vec_id"] is None] == [r[1] for r in coded if r[0] == 1]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, "a", 0)]) == []
    assert [r[1:] for r in run(spark, [(1, [1.0], "a", 0)])] == [(None, None, None, None)]
