"""Admission of very common names by list ranking, against the fold."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from domainsieve.operators import admission as adm
from domainsieve.operators.chain import admitted_chain

NOW = datetime(2024, 1, 1)
EVENTS, START = "domain string, t long", "domain string, last long"


def replay(events, ttl, last):
    taken, last = set(), dict(last)
    for domain, t in sorted(set(events), key=lambda e: e[1]):
        if last.get(domain) is None or t > last[domain] + ttl:
            last[domain] = t
            taken.add((domain, t))
    return taken


def times(rng, shape, n):
    if shape == "even":
        return [10 * i for i in range(n)]
    if shape == "bursts":
        return [1000 * rng.randint(0, 8) + rng.randint(0, 30) for _ in range(n)]
    if shape == "growing":
        return [i * i for i in range(n)]
    return [rng.randint(-500, 5000) for _ in range(n)]


@pytest.mark.parametrize("shape", ["even", "bursts", "growing", "random"])
def test_chain_equals_the_fold(spark, tmp_path, shape):
    rng = random.Random(shape)
    events = [(name, t) for name, n in (("a", 300), ("b", 41), ("c", 1), ("d", 90)) for t in times(rng, shape, n)]
    starts = {"a": None, "b": 55, "c": 10 ** 9, "d": -400}
    d, s = spark.createDataFrame(events + events[:50], EVENTS), spark.createDataFrame(list(starts.items()), START)
    for i, (ttl, block) in enumerate([(0, 30), (25, 9), (900, 20), (10 ** 6, 50)]):
        got = [tuple(r) for r in admitted_chain(d, s, ttl, block, f"{tmp_path}/{i}").collect()]
        assert len(got) == len(set(got)) and set(got) == replay(events, ttl, starts), (ttl, block)


def test_seconds_over_a_month_in_few_rounds(spark, tmp_path):
    """One event a second for 30 days, ttl 9 seconds: 259,200 admissions from 52 blocks."""
    n = 30 * 86_400
    d = spark.range(n).select(F.lit("busy.example").alias("domain"), (F.col("id") * 1_000_000).alias("t"))
    start = spark.createDataFrame([("busy.example", None)], START)
    got = admitted_chain(d, start, 9_000_000, 100_000, str(tmp_path))
    assert got.agg(F.count("*"), F.countDistinct("t"), F.max(F.col("t") % 10_000_000)).first()[:] == (n // 10, n // 10, 0)
    assert len([f for f in os.listdir(f"{tmp_path}/marks") if f.startswith("round=")]) - 1 <= 6


def test_rounds_do_not_depend_on_the_ttl(spark, tmp_path):
    d = spark.range(4000).select(F.lit("x").alias("domain"), F.col("id").alias("t"))
    start, rounds = spark.createDataFrame([("x", None)], START), {}
    for ttl in (0, 1, 30, 1000):
        assert admitted_chain(d, start, ttl, 500, f"{tmp_path}/{ttl}").count() == -(-4000 // (ttl + 1))
        rounds[ttl] = len(os.listdir(f"{tmp_path}/{ttl}/marks"))
    # 16 blocks: a chain enters each once.
    assert max(rounds.values()) <= 1 + 5


def test_many_small_names_share_blocks(spark, tmp_path):
    """2000 names of 6 events with blocks of 6 were 4000 blocks, each a task and a file."""
    rng = random.Random(8)
    events = [(f"n{k}", t) for k in range(2000) for t in rng.sample(range(1000), 6)]
    starts = {f"n{k}": rng.choice([None, -50, 400]) for k in range(2000)}
    # An event without a time is never admitted.
    d = spark.createDataFrame([*events, ("n3", None), ("n4", None)], EVENTS)
    starts["n3"] = starts["n4"] = None
    s = spark.createDataFrame(list(starts.items()), START)
    got = [tuple(r) for r in admitted_chain(d, s, 100, 6, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == replay(events, 100, starts)
    assert spark.read.parquet(f"{tmp_path}/blocks").select("block").distinct().count() <= 64


def test_history_with_names_of_both_kinds(spark):
    rng = random.Random(5)
    events = [("hot" if i % 3 == 0 else f"n{rng.randint(0, 40)}", NOW + timedelta(seconds=rng.randint(0, 40 * 86400)))
              for i in range(1500)]
    seen = [("hot", NOW + timedelta(days=2)), ("n1", NOW - timedelta(days=1))]
    d, s = spark.createDataFrame(events, "domain string, ts timestamp"), spark.createDataFrame(seen, "domain string, last_seen timestamp")
    for ttl in (0.01, 1.5, 7):
        ranked = {tuple(r) for r in adm.admit_history(d, ttl, s, fold_events=100).collect()}
        assert ranked == {tuple(r) for r in adm.admit_history(d, ttl, s).collect()}
