"""Stores of state tables: clustered joins, one commit for many tables, retention, schemas, upkeep."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from domainsieve.operators import admission as adm, feeds as fd, state as st
from domainsieve.params import Params
from domainsieve.plans import state_cycle as cycle
from domainsieve.sources import manifest
from domainsieve.sources.tables import Store

NOW = datetime(2024, 3, 1, 12)
BUCKETS = 8


def now():
    return F.lit(str(NOW)).cast("timestamp")


def ago(days):
    return NOW - timedelta(days=days)


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def put(store, name, df, key=None):
    change = store.change()
    change.replace(name, df, key, BUCKETS if key else 0)
    return change.commit()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_above(text, table):
    """Exchanges on the way from the scan of `table` to the root of a plan printed as a tree."""
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if f"state_{table}_" in line)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            depth = d
            found += ["Exchange" in line]
    return sum(found)


# -- clustered tables -----------------------------------------------------------

def test_joins_read_clustered_state_in_place(spark, store, names, no_broadcast):
    state = spark.range(400).select(F.concat(F.lit("n"), F.col("id"), F.lit(".com")).alias("domain"),
                                    F.lit("Feed").alias("feed_name"), now().alias("added_at"),
                                    (now() - F.make_dt_interval(F.col("id") % 20)).alias("last_seen"))
    put(store, "threats", state, "domain")
    put(store, "seen", state.select("domain", "last_seen"), "domain")
    asked = names(*[f"n{i}.com" for i in range(0, 600, 7)])
    unseen = adm.unseen(asked, store.read("seen"), now(), 7)
    assert rows(unseen) == rows(adm.unseen(asked, state, now(), 7))
    assert exchanges_above(plan(unseen), "seen") == 0
    listed = asked.withColumn("feed", F.lit("Feed"))
    fresh = fd.new_feed_domains(listed, store.read("threats"))
    assert rows(fresh) == rows(fd.new_feed_domains(listed, state))
    assert exchanges_above(plan(fresh), "threats") == 0
    touched = st.touch(store.read("threats"), asked, now())
    assert exchanges_above(plan(touched), "threats") == 0
    # The result lies as the table did and is written without a shuffle, one file per bucket.
    assert exchanges_above(plan(touched.repartition(BUCKETS, "domain")), "threats") == 0
    put(store, "threats", touched, "domain")
    assert rows(store.read("threats")) == rows(st.touch(state, asked, now()))
    folder = f"{store.path}/{store.tables()['threats']['parts'][0]['path']}"
    assert len([f for f in os.listdir(folder) if f.endswith(".parquet")]) <= BUCKETS


def test_another_session_finds_the_buckets(spark, store):
    put(store, "seen", spark.range(50).select(F.col("id").cast("string").alias("domain"), now().alias("last_seen")), "domain")
    part = store.tables()["seen"]["parts"][0]["path"]
    spark.sql(f"DROP TABLE state_{part.replace('/', '_')}")
    assert Store(spark, store.path).read("seen").count() == 50
    assert "Bucketed: true" in plan(store.read("seen").groupBy("domain").count())


# -- one commit -------------------------------------------------------------------

def small_state(spark, store):
    change = store.change()
    change.replace("threats", spark.createDataFrame(
        [("old.com", "F", ago(40), ago(30)), ("new.com", "F", ago(40), ago(1))], st.THREAT_SCHEMA), "domain", BUCKETS)
    change.replace("denylist", spark.createDataFrame(
        [(1, "old.com", 1, "TI:MALWARE:F"), (2, "new.com", 1, "TI:MALWARE:F"), (3, "old.com", 1, "AI:C2")],
        "id long, domain string, type long, comment string"))
    change.replace("mapping", spark.createDataFrame([(1, 5), (2, 5), (3, 0)], "domainlist_id long, group_id long"))
    cycle.append_verdicts(change, spark.createDataFrame([("old.com", "MALWARE", 0.9, "r", True)],
                                                        "domain string, category string, confidence double, reason string, blocked boolean"), now() - F.make_dt_interval(F.lit(40)))
    return change.commit()


def snapshot(store, version=None):
    return {name: rows(store.read(name, version)) for name in ("threats", "denylist", "mapping", "classifications")}


def test_expiry_changes_all_tables_or_none(spark, store, monkeypatch):
    version = small_state(spark, store)
    before, params = snapshot(store), Params(block_expiry_days=10)
    from domainsieve.sources.tables import Change
    replace, seen = Change.replace, []

    def failing(self, name, *a, **kw):
        if len(seen) == 2:
            raise OSError("executor and driver lost")
        seen.append(name)
        return replace(self, name, *a, **kw)

    monkeypatch.setattr(Change, "replace", failing)
    with pytest.raises(OSError):
        cycle.expire_cycle(store, now(), params)
    monkeypatch.undo()
    assert seen == ["denylist", "mapping"]
    assert store.version() == version and snapshot(store) == before
    assert cycle.expire_cycle(store, now(), params) == version + 1
    after = snapshot(store)
    assert [r[0] for r in after["threats"]] == ["new.com"]
    assert [r[0] for r in after["denylist"]] == [2, 3] and [r[0] for r in after["mapping"]] == [2, 3]
    added = store.read("classifications").filter("category = 'EXPIRED'").collect()
    assert [(r["domain"], r["id"], r["blocked"], r["classified_at"]) for r in added] == [("old.com", 2, False, NOW)]
    assert snapshot(store, version) == before


def test_two_writers(spark, store):
    a = spark.range(3)
    put(store, "x", a)
    put(store, "y", a)
    one, two, three = store.change(), store.change(), store.change()
    one.replace("x", spark.range(1))
    two.replace("y", spark.range(2))
    three.replace("x", spark.range(9))
    one.commit()
    assert two.commit() == 4
    with pytest.raises(manifest.Conflict):
        three.commit()
    assert (store.read("x").count(), store.read("y").count()) == (1, 2)
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, store.log, 3, {})
    assert not [n for n in os.listdir(store.log) if n.startswith("draft")]


def test_vacuum_keeps_what_recent_versions_name(spark, store):
    for n in range(1, 5):
        put(store, "x", spark.range(n), None)
    folders = lambda: len(os.listdir(f"{store.path}/x"))
    assert folders() == 4
    assert len(store.vacuum(keep=2)) == 2 and folders() == 2
    assert store.read("x").count() == 4 and store.vacuum(keep=9) == []


# -- logs ---------------------------------------------------------------------------

VERDICTS = "id long, domain string, category string, confidence double, blocked boolean, classified_at timestamp"


def verdicts(spark, rng, ids, low, high):
    return spark.createDataFrame([(i, f"n{rng.randrange(25)}", rng.choice("ABC"), rng.random(), rng.random() < 0.5,
                                   ago(rng.choice([low, high, rng.uniform(low, high)]))) for i in ids], VERDICTS)


def append(store, df):
    change = store.change()
    change.append("classifications", df, "classified_at")
    return change.commit()


def refresh(store):
    change = store.change()
    cycle.refresh_latest(change, BUCKETS)
    return change.commit()


def test_latest_verdicts_are_kept_up_to_date(spark, store):
    rng = random.Random(3)
    read = []
    frame = store._frame

    def noted(table, *a, **kw):
        df = frame(table, *a, **kw)
        read.append(df.inputFiles())
        return df

    store._frame = noted
    for n, (low, high) in enumerate([(5, 9), (2, 4), (6, 30), (0, 1)]):  # the third is late
        version = append(store, verdicts(spark, rng, range(100 * n, 100 * n + 60), low, high))
        before = len(read)
        refresh(store)
        new = {p["path"] for p in store.tables()["classifications"]["parts"] if p["since"] == version}
        opened = {os.path.relpath(os.path.dirname(f.removeprefix("file:")), store.path) for f in read[before]}
        assert opened == new
        want = st.latest_verdict(store.read("classifications"))
        assert rows(store.read("latest_verdicts").select(want.columns)) == rows(want)
    before = store.tables()
    refresh(store)
    assert rows(store.read("latest_verdicts").select(want.columns)) == rows(want)
    assert before["classifications"] == store.tables()["classifications"]


def test_append_and_refresh_in_one_version(spark, store):
    small_state(spark, store)
    change = store.change()
    cycle.append_verdicts(change, spark.createDataFrame([("z.com", "C2", 0.8, "r", True)],
                                                        "domain string, category string, confidence double, reason string, blocked boolean"), now())
    cycle.refresh_latest(change, BUCKETS)
    version = change.commit()
    assert rows(store.read("latest_verdicts").select("domain", "id")) == [("old.com", 1), ("z.com", 2)]
    change = store.change()
    assert change.notes("latest_verdicts") == {"folded": version}
    assert change.read("classifications", after=version).count() == 0


def test_retention_drops_folders(spark, store):
    rng = random.Random(4)
    for n in range(3):
        append(store, verdicts(spark, rng, range(100 * n, 100 * n + 80), 0, 20))
    refresh(store)
    put(store, "seen_domains", spark.createDataFrame([("a", ago(30)), ("b", ago(1))], "domain string, last_seen timestamp"), "domain")
    params, whole = Params(retention_days=10.3), store.read("classifications")
    want = rows(whole.filter(F.col("classified_at") >= st.days_before(now(), 10.3)))
    old, limit = store.tables()["classifications"]["parts"], str(ago(10.3).date())
    version = cycle.retention_cycle(store, now(), params)
    parts = store.tables()["classifications"]["parts"]
    assert rows(store.read("classifications")) == want
    later = [p for p in old if p["day"] > limit]
    assert [p for p in parts if p["day"] > limit] == later and min(p["day"] for p in parts) >= limit
    assert rows(store.read("seen_domains").select("domain")) == [("b",)]
    got = store.read("latest_verdicts").select("domain", "category", "confidence", "blocked")
    assert rows(got) == rows(st.latest_verdict(store.read("classifications")))
    assert rows(store.read("classifications", version - 1)) == rows(whole)
    before = store.tables()
    assert cycle.retention_cycle(store, now(), params) == version and store.tables() == before


def test_days_outside_the_question_are_not_opened(spark, store):
    append(store, verdicts(spark, random.Random(5), range(60), 0, 20))
    some = store.read("classifications", first_day=str(ago(3).date()), last_day=str(ago(2).date()))
    assert {f.split("_day=")[1][:10] for f in some.inputFiles()} <= {str(ago(d).date()) for d in (2, 3)}


# -- schemas --------------------------------------------------------------------------

def test_three_schemas_read_as_one(spark, store):
    put(store, "threats", spark.createDataFrame([("a", ago(9))], "domain string, added_at timestamp"), "domain")
    change = store.change()
    change.append("log", spark.createDataFrame([(1, ago(9), 5)], "id int, at timestamp, n int"), "at")
    change.commit()
    change = store.change()
    change.evolve("log", "id long, at timestamp, n int, first timestamp, note string", {"first": "at"})
    change.append("log", spark.createDataFrame([(2 ** 40, ago(8), 6, ago(1), "x")],
                                               "id long, at timestamp, n int, first timestamp, note string"), "at")
    change.evolve("threats", "domain string, added_at timestamp, last_seen timestamp, feed_name string", {"last_seen": "added_at"})
    change.commit()
    folders = [p["path"] for p in store.tables()["log"]["parts"]]
    change = store.change()
    change.evolve("log", "id long, at timestamp, n double, first timestamp, note string, extra boolean")
    change.append("log", spark.createDataFrame([(3, ago(7), 0.5, None, None, True)],
                                               "id long, at timestamp, n double, first timestamp, note string, extra boolean"), "at")
    change.commit()
    assert rows(store.read("log")) == sorted([
        (1, ago(9), 5.0, ago(9), None, None), (2 ** 40, ago(8), 6.0, ago(1), "x", None), (3, ago(7), 0.5, None, None, True)], key=repr)
    assert [p["path"] for p in store.tables()["log"]["parts"]][:2] == folders
    assert rows(store.read("threats")) == [("a", ago(9), ago(9), None)]
    change = store.change()
    for schema in ("id int, at timestamp", "id string, at timestamp, n double, first timestamp, note string, extra boolean"):
        with pytest.raises(ValueError):
            change.evolve("log", schema)
    with pytest.raises(ValueError):
        change.evolve("log", "id long, at timestamp, n double, first timestamp, note string, extra boolean, x int", {"x": "nothing"})
