import random
import zlib
from collections import Counter, defaultdict

import pytest

from domainsieve.llm import sharding
from llm_helpers import docs


def check(spark, rows):
    got = sharding.shard(docs(spark, rows)).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    counts = [len(slots[s]) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return {(r.doc_id, r.text_crc32): r.shard for r in got}


def test_groups_stay_together(spark):
    rng = random.Random(8)
    rows = [(i, f"text {i // 3}" if i < 600 else f"alone {i}") for i in range(2000)]
    rng.shuffle(rows)
    shard = check(spark, rows)
    groups = defaultdict(set)
    for i, t in rows:
        groups[t].add(shard[i, zlib.crc32(t.encode())])
    assert sum(len(s) > 1 for s in groups.values()) <= 4


def cut_links(rows, shard):
    """Share of the links between equal texts whose ends are in different shards."""
    groups = defaultdict(Counter)
    for i, t in rows:
        groups[t][shard[i, zlib.crc32(t.encode())]] += 1
    pairs = (lambda n: n * (n - 1) // 2)
    links = sum(pairs(sum(g.values())) for g in groups.values())
    return 1 - sum(pairs(n) for g in groups.values() for n in g.values()) / links


@pytest.mark.parametrize("copies, rows", [(2, 24_000), (5, 24_000), (3, 2_000)])
def test_few_links_are_cut_where_every_text_has_copies(spark, copies, rows):
    """No shard has room to spare; a random deal cuts 96 per cent of the links."""
    table = [(i, f"text {i // copies}") for i in range(rows)]
    assert cut_links(table, check(spark, table)) < (0.05 if rows > 10_000 else 0.15)


def test_exchanges_are_balanced():
    rng = random.Random(3)
    wanted = {(a, b): rng.randrange(50) for a in range(6) for b in range(6) if a != b}
    room = [0, 0, 7, 100, 0, 1]
    got = sharding.accepted(wanted, list(room))
    assert all(n <= wanted[p] for p, n in got.items())
    for s in range(6):
        gain = sum(n for (_, b), n in got.items() if b == s) - sum(n for (a, _), n in got.items() if a == s)
        assert gain <= room[s]


def test_hot_group_nulls_and_repeats(spark):
    """A group of a third of all rows, larger than a shard, fills whole shards."""
    rows = [(i, "hot") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(900)]
    rows += [(5000, None), (5001, ""), (None, "no id"), (1000, "t0"), (1000, "t0"), (5002, "ü" * 50_000)]
    shard = check(spark, rows)
    assert len({s for (i, _), s in shard.items() if i is not None and i < 500}) <= 14


def test_every_text_equal_and_few_rows(spark):
    check(spark, [(i, "same") for i in range(100)])
    check(spark, [(i, f"{i}") for i in range(5)])
    assert check(spark, []) == {}


def test_a_round_stores_one_table(spark):
    """Rounds over few rows cost their jobs; each had three tables and a count of loads."""
    rows = [(f"k{k}", s, 1 + (7 * k + 3 * s) % 5) for k in range(60) for s in range(4) if (k + s) % 3]
    cells = spark.createDataFrame(rows, "key string, shard int, n long")
    total = sum(n for _, _, n in rows)
    steps = sharding.Steps(spark, "rounds")
    moved = sharding.propagated(cells, [total // 4 + 1] * 4, 16, steps, rounds=4)
    assert steps.n <= 4 + 1
    assert moved.agg({"n": "sum"}).first()[0] == total
