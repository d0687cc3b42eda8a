import numpy as np
import pytest

from domainsieve.llm import rp_forest


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v
            and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids = [i for i, _ in good]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = x @ x.T >= 0.9
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(near)):
        p, q = root(ids[a]), root(ids[b])
        up[max(p, q)] = min(p, q)
    return {i: (int(n) - 1, root(i)) for i, n in zip(ids, near.sum(1))}


@pytest.mark.parametrize("leaf", [1024, 64])
def test_all_links(spark, monkeypatch, leaf):
    """A small leaf makes several rounds of splits, and leaves that cannot be split."""
    monkeypatch.setattr(rp_forest, "LEAF", leaf)
    monkeypatch.setattr(rp_forest, "SAMPLE", 256)
    monkeypatch.setattr(rp_forest, "LEVELS", 3)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = [base[i % 60] + rng.normal(size=24) * rng.choice([0.05, 0.3, 1.5]) for i in range(600)]
    rows += [base[0]] * 150 + [base[1] + rng.normal(size=24) * 0.001 for _ in range(100)]
    rows = [(i, r.astype(np.float32).tolist()) for i, r in enumerate(rows)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [float("inf")] + [1.0] * 23),
             (5004, [None] + [1.0] * 23), (5005, []), (None, base[0].tolist())]
    got = rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.vec_id in want:
            assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id == r.component_id)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


def test_empty_and_mixed_lengths(spark):
    schema = "vec_id long, embedding array<double>, links string"
    assert rp_forest.near_vectors(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "b"), (3, [1.0, 0.0, 0.0], "c"), (2, [2.0, 0.0], "b")]
    got = sorted(map(tuple, rp_forest.near_vectors(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True)]


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [1.7e308, 1.7e308]),
            (6, [3.0, 3.1]), (7, [0.0, 5e-324])]
    got = rp_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {
        1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}
