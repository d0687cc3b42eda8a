import hashlib
import random

import pytest
from pyspark.sql import functions as F

from domainsieve.llm import warc

SCHEMA = "page_id long, url string, html string, records string"


def run(spark, rows, path, **kw):
    warc.write(spark.createDataFrame(rows, SCHEMA), path, **kw)
    return warc.read(spark, path).collect()


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    long = "".join(rng.choice("añ\r\n<p>") for _ in range(40_000))
    rows = [(5, "http://a.example/ü x", long, "x"), (3, "http://b.example", long, None), (9, None, long, None),
            (1, "http://c.example", None, None), (2, "u", "", None), (4, "u", "short", None), (6, "u", "short", None),
            (7, "u", "y" * 100, None), (7, "u", "y" * 100, None), (8, "WARC/1.1\r\n\r\nx", "WARC/1.1\r\n\r\n" * 30, None),
            (None, "u", "z" * 200, None), (11, "u", "z" * 200, None), (None, None, "alone" * 50, None)]
    got = run(spark, rows, str(tmp_path / "a"), segment_bytes=1000)
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        assert any(r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
                   and (r.record_type == "revisit" or bytes(r.payload) == raw) for r in by[i])
    assert [(r.record_type, r.refers_to) for i in (3, 5, 9) for r in by[i]] == [
        ("response", None), ("revisit", 3), ("revisit", 3)]
    assert [by[4][0].record_type, by[6][0].record_type] == ["response"] * 2
    assert sorted((r.record_type, r.refers_to) for r in by[7]) == [("response", None), ("revisit", 7)]
    assert by[11][0].record_type == "response" and by[None][0].refers_to in (11, None)
    assert len({r.record_id for r in got}) == len(rows)


@pytest.mark.parametrize("deal", ["repartition", "shuffle", "distinct"])
def test_one_response_per_payload_however_rows_are_dealt(spark, tmp_path, monkeypatch, deal):
    """2000 rows of 20 payloads, some of one page; the frame deals them out anew whenever it is read."""
    rows = [(i // 2 if i < 200 else i, f"u{i}", f"{i % 20}" * 200, None) for i in range(2000)]
    d = spark.createDataFrame(rows, SCHEMA)
    d = {"repartition": d.repartition(7), "shuffle": d.orderBy(F.rand()), "distinct": d.distinct()}[deal]
    want = {}
    for i, _, html, _ in rows:
        want[html] = min(want.get(html, i), i)
    for n, small in enumerate((True, False)):
        if not small:
            monkeypatch.setattr(warc, "fits", lambda df: False)
        warc.write(d, f"{tmp_path}/{n}")
        got = warc.read(spark, f"{tmp_path}/{n}").collect()
        assert len(got) == 2000 and all(r.problem is None for r in got)
        responses = [r for r in got if r.record_type == "response"]
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in responses) == sorted((i, h) for h, i in want.items())
        own = {r.payload_digest: r.page_id for r in responses}
        assert all(r.refers_to == own[r.payload_digest] for r in got if r.record_type == "revisit")


def test_small_and_large_group_tables_agree(spark, tmp_path, monkeypatch):
    rows = [(i, "u", "same" * 50 if i % 3 else f"{i}" * 200, None) for i in range(60)]
    pick = (lambda got: sorted((r.page_id, r.record_type, r.refers_to) for r in got))
    first = pick(run(spark, rows, str(tmp_path / "a")))
    monkeypatch.setattr(warc, "fits", lambda df: False)
    assert pick(run(spark, rows, str(tmp_path / "b"))) == first


def test_empty_table(spark, tmp_path):
    assert run(spark, [], str(tmp_path / "a")) == []


def test_damage_is_found(spark, tmp_path):
    digest = hashlib.sha256(b"payload" * 400).hexdigest()
    records = warc.page_records(1, "u", b"payload" * 400, digest, None, "<urn:page:1:x>", "2020-01-01T00:00:00Z", 900)
    assert len(records) > 3
    cases = {"a": (records[::-1], None), "b": (records[:2] + records[3:], "segment missing or repeated"),
             "c": (records[:-1], "last segment missing"), "d": (records + records[1:2], "segment missing or repeated")}
    for name, (some, problem) in cases.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in some))
        assert [r.problem for r in warc.read(spark, str(tmp_path / name)).collect()] == [problem]
    with pytest.raises(ValueError):
        list(warc.parsed(records[0][:-5]))
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc")
    assert warc.dechunked(warc.chunked(b"x" * 20_000)) == b"x" * 20_000
