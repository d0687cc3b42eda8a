from datetime import datetime, timedelta

from pyspark.sql import functions as F

from domainsieve.operators import admission as adm
from domainsieve.sources.text import read_query_log
from domainsieve.streaming.admission import admit_stream, use_rocksdb
from domainsieve.sources import manifest
from domainsieve.streaming import seen
from domainsieve.streaming.query_path import disposition_stream, process_batch
from domainsieve.streaming.seen import compact_seen, seen_names
from test_decisions import tables  # noqa: F401  (fixture)

START = datetime(2024, 1, 1)


def test_stream_equals_history(spark, tmp_path):
    use_rocksdb(spark)
    events = [(f"n{i % 5}" if i % 3 else "hot", START + timedelta(hours=i)) for i in range(600)]
    d = spark.createDataFrame(events, "domain string, ts timestamp")
    for low, high in ((0, 200), (200, 350), (350, 600)):
        spark.createDataFrame(events[low:high], d.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = (admit_stream(stream, 7).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in adm.admit_history(d, 7).collect()}


def test_state_ends_after_the_ttl(spark, tmp_path):
    """Names asked for once go with the watermark; the result is that of the whole history."""
    use_rocksdb(spark)
    schema, events, rows = "domain string, ts timestamp", [], []
    for day in range(0, 40, 8):
        part = [(f"d{day}-{i}", START + timedelta(days=day, minutes=i)) for i in range(20)]
        part += [("always", START + timedelta(days=day, hours=h)) for h in range(0, 120, 7)]
        part += [("d0-3", START + timedelta(days=day, hours=1))] if day == 32 else []
        events += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        query = (admit_stream(stream, 7).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        assert query.awaitTermination(120)
        state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/state")
        rows.append(state.count())
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {tuple(r) for r in adm.admit_history(spark.createDataFrame(events, schema), 7).collect()}
    assert ("d0-3", START + timedelta(days=32, hours=1)) in got
    # 101 names in all. Of the last seven days, and one that an event may be late, two parts are left.
    assert rows[0] == 21 and max(rows) <= 61 and rows[-1] <= 42


def test_names_share_processor_calls(spark, tmp_path):
    """3000 names and a null one: one row of state each, in no more keys than there are buckets."""
    use_rocksdb(spark)
    schema = "domain string, ts timestamp"
    events = [(f"n{i}" if i else None, START + timedelta(hours=h)) for i in range(3000) for h in (i % 7, 100, 171)]
    spark.createDataFrame([*events, ("timeless", None)], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = (admit_stream(stream, 7).writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(got) == len(set(got))
    want = {tuple(r) for r in adm.admit_history(spark.createDataFrame(events, schema), 7).collect()}
    assert set(got) == want | {("timeless", None)}
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/state")
    assert state.count() == 3000
    assert state.select("key").distinct().count() <= 1024


def line(name):
    return f"Jan 01 00:00:00 dnsmasq[1]: query[A] {name} from 10.0.0.1"


def test_disposition_stream(spark, tmp_path, tables):  # noqa: F811
    log, out = tmp_path / "log", str(tmp_path / "out")
    log.mkdir()
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp")
    allow = spark.createDataFrame([("skip.org", False)], "entry string, is_suffix boolean")
    policy = adm.query_policy(allow)

    def run():
        lines = read_query_log(spark, str(log), streaming=True).select("domain")
        disposition_stream(lines, out, str(tmp_path / "cp"), policy, lambda s: tables, as_of,
                           availableNow=True).awaitTermination()

    (log / "1.log").write_text("\n".join(map(line, ["quiet.org", "quiet.org", "g00gle.ru", "skip.org", "www.blocked.com"])))
    run()
    (log / "2.log").write_text("\n".join(map(line, ["quiet.org", "g00gle.ru", "www.pop.com"])))
    run()
    decided = {(r["domain"], r["route"]) for r in spark.read.parquet(f"{out}/decided").collect()}
    assert decided == {("quiet.org", "PREFILTER"), ("g00gle.ru", "SCORE"), ("www.blocked.com", "SUBDOMAIN_BLOCK"),
                       ("www.pop.com", "POPULAR")}
    assert [r["domain"] for r in spark.read.parquet(f"{out}/requests").collect()] == ["g00gle.ru"]
    assert spark.read.parquet(f"{out}/blocks").count() == 1

    # A batch that runs again leaves the same rows.
    again = spark.createDataFrame([("quiet.org",), ("www.pop.com",), ("g00gle.ru",)], "domain string")
    before = sorted(map(str, spark.read.parquet(f"{out}/decided").collect()))
    process_batch(again, 1, out, policy, lambda s: tables, as_of)
    assert sorted(map(str, spark.read.parquet(f"{out}/decided").collect())) == before

    # After compaction the same names count as seen.
    before = {r["domain"] for r in seen_names(spark, out).collect()}
    assert compact_seen(spark, out, as_of) == len(before) == 4
    assert {r["domain"] for r in seen_names(spark, out).collect()} == before
    (log / "3.log").write_text("\n".join(map(line, ["quiet.org", "later.org"])))
    run()
    assert spark.read.parquet(f"{out}/decided").filter("domain = 'later.org'").count() == 1
    assert spark.read.parquet(f"{out}/decided").count() == 5


def test_events_that_come_too_late_are_dropped(spark, tmp_path):
    use_rocksdb(spark)
    schema = "domain string, ts timestamp"
    parts = [[("a", START + timedelta(days=20))], [("b", START + timedelta(days=20, hours=1))],
             [("late", START + timedelta(days=2)), ("lately", START + timedelta(days=19, hours=12))]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        (admit_stream(stream, 7, late="1 day").writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()).awaitTermination()
    assert {r["domain"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"a", "b", "lately"}


def test_folding_between_and_during_batches(spark, tmp_path, tables, monkeypatch):  # noqa: F811
    """Two fold steps, one of them in the middle of each third batch, change no decision."""
    monkeypatch.setattr(seen, "FAN", 2)
    as_of = F.lit("2024-03-01 12:00:00").cast("timestamp")
    policy = adm.query_policy(spark.createDataFrame([], "entry string, is_suffix boolean"))
    parts = [[f"n{(7 * b + 3 * i) % 40}.org" for i in range(6)] for b in range(8)]
    plain, folded = str(tmp_path / "plain"), str(tmp_path / "folded")
    most = []

    def during(batch):
        def find(s):
            # The batch has planned what it reads; now that is folded and vacuumed beside it.
            if batch % 3 == 2:
                seen.fold_seen(s, folded, as_of, whole=batch % 2 == 0)
            return tables
        return find

    for b, names in enumerate(parts):
        rows = spark.createDataFrame([(n,) for n in names], "domain string")
        most.append(len(seen.seen_folders(spark, folded, b)))
        process_batch(rows, b, folded, policy, during(b), as_of)
        if b == 6:  # it fails after its writes and runs again
            process_batch(rows, b, folded, policy, during(0), as_of)
    seen_before, decided = set(), []
    for b, names in enumerate(parts):
        decided += [(b, n) for n in sorted(set(names) - seen_before)]
        seen_before |= set(names)
    got = spark.read.parquet(f"{folded}/decided").select("batch", "domain").collect()
    assert sorted(map(tuple, got)) == sorted(decided)
    assert {r["domain"] for r in seen_names(spark, folded).collect()} == seen_before
    # At most two folders of a level, two finished batches and the one that may run again.
    assert max(most) <= 2 * 3 + 3 and manifest.latest(spark, f"{folded}/seen_log")[0] >= 3
    # Replaced folders go when two newer batches are there.
    for b in range(len(parts), len(parts) + 4):
        spark.createDataFrame([], seen.SEEN).write.parquet(f"{folded}/seen/batch={b}")
        seen.fold_seen(spark, folded, as_of, whole=True)
    assert len(manifest.children(spark, f"{folded}/seen")) <= 4
    assert len(manifest.children(spark, f"{folded}/seen_levels")) <= 4
    assert {r["domain"] for r in seen_names(spark, folded).collect()} == seen_before


def test_two_that_fold_at_once(spark, tmp_path, monkeypatch):
    out, as_of = str(tmp_path), F.lit("2024-03-01 12:00:00").cast("timestamp")
    for b in range(4):
        spark.createDataFrame([(f"n{b}", START + timedelta(days=59 - 200 * (b == 1)))], seen.SEEN).write.parquet(f"{out}/seen/batch={b}")
    commit, tried = manifest.commit, []

    def slower(spark_, path, base, state):
        if not tried:
            tried.append(base)
            assert seen.fold_seen(spark, out, as_of, whole=True) == 1
        return commit(spark_, path, base, state)

    monkeypatch.setattr(manifest, "commit", slower)
    assert seen.fold_seen(spark, out, as_of, whole=True) == 0
    # The newest batch stays by itself, and what is past retention is gone.
    assert len(seen.seen_folders(spark, out)) == 2
    assert sorted(r["domain"] for r in seen_names(spark, out).collect()) == ["n0", "n2", "n3"]
    assert len(manifest.children(spark, f"{out}/seen_levels")) == 1
