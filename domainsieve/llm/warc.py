"""WARC archives: writing with revisits and segments, and reading back.

A record's block is an HTTP response with a chunked body. A block longer than `segment_bytes`
is cut: the first record carries the first part, continuation records the others, and the last
one the total length. Reading groups continuation records by the identifier of their origin,
orders them by segment number, checks that none is missing and that the lengths add up, undoes
the chunked framing and checks the payload's digest.

Archives are plain WARC files written and read by Spark (text sink with the record separator as
line end, binary file source), so they may lie in any store that Spark reaches. A file is at
most FILE_BLOBS * BLOB_BYTES plus one page long, which bounds the memory of a reading task.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.llm.common import HOT_SHARE, Steps
from domainsieve.operators.lookup import fits
from domainsieve.sources.workdir import new_folder

SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
BLOB_BYTES = 4 << 20
FILE_BLOBS = 4
# Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
_END = b"\r\n\r\n"
_HTTP = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
         b"Transfer-Encoding: chunked\r\n\r\n")
_PAGE = re.compile(r"<urn:page:(-?\d*):")

_RECORD = ("record_id string, record_type string, page_id long, url string, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary, problem string")


# -- one record ---------------------------------------------------------------

def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in
             (payload[i:i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body. Raises ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk cut short")
        out.append(body[at:at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the separator after it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id, url, payload: bytes, digest: str, refers_to: str | None, record_id: str,
                 date: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one page; a revisit has the HTTP header alone as its block."""
    block = _HTTP if refers_to else _HTTP + chunked(payload)
    if url is not None:
        url = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    cut = len(parts) > 1
    out = [record([
        ("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id),
        ("WARC-Date", date), ("WARC-Target-URI", url), ("X-Page-ID", page_id),
        ("X-Payload-Length", len(payload)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", refers_to), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Segment-Number", 1 if cut else None)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{record_id[:-1]}:segment-{n}>"),
            ("WARC-Date", date), ("WARC-Segment-Origin-ID", record_id), ("WARC-Segment-Number", n),
            ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None)], part))
    return out


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of a file."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(_END, at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no record at byte {at}")
        head = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        start = end + 4
        at = start + int(head["content-length"])
        if at > len(data):
            raise ValueError("record cut short")
        yield head, data[start:at]


def row_of(head: dict[str, str], block: bytes, keep: bool, problem: str | None = None) -> tuple:
    """The row of a whole record: identity, payload and its digest, checked."""
    kind, payload = head["warc-type"], b""
    said = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
    page = head.get("x-page-id")
    refers = _PAGE.match(head.get("warc-refers-to", ""))
    n, digest = int(head.get("x-payload-length", 0)), said
    if kind != "revisit" and problem is None:
        try:
            http, _, body = block.partition(_END)
            payload = dechunked(body) if b"chunked" in http.lower() else body
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if said and said != digest:
                problem = "payload digest differs"
        except ValueError as e:
            problem = str(e)
    return (head.get("warc-record-id"), kind, int(page) if page else None, head.get("warc-target-uri"),
            int(refers[1]) if refers and refers[1] else None, n, digest,
            payload if keep and kind != "revisit" else None, problem)


# -- Spark --------------------------------------------------------------------

def with_revisits(pages: DataFrame, steps: Steps) -> DataFrame:
    """page_id, url, payload, digest, again (boolean: a revisit), first (page_id of its response),
    own (boolean: this row is its digest's response). Of repeated rows exactly one is the
    response; a null page_id comes last.

    pages is read more than once and may deal its rows out differently each time: what a row is
    follows from its page_id and payload alone. Rows that are alike in both and first of their
    group are stored and numbered, and the smallest number is the response.
    """
    p = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn(
        "digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= REVISIT_BYTES)
    ids = p.filter("long").groupBy("digest", "page_id").count()
    groups = steps.save(
        ids.groupBy("digest").agg(
            F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "count")).alias("f"),
            F.sum("count").alias("n")).filter("n > 1").select(
            F.col("digest").alias("_d"), F.col("f.page_id").alias("first"), (F.col("f.count") > 1).alias("tied"), "n"),
        "groups")
    if fits(groups):
        joined = p.join(F.broadcast(groups), F.col("digest") == F.col("_d"), "left")
    else:
        bound = pages.count() // HOT_SHARE
        hot = groups.filter(F.col("n") > bound).select(
            F.col("_d").alias("_hd"), F.col("first").alias("_hf"), F.col("tied").alias("_ht"))
        marked = p.join(F.broadcast(hot), F.col("digest") == F.col("_hd"), "left")
        key = F.when(F.col("_hd").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
        joined = marked.withColumn("_k", key).join(groups, F.col("_k") == F.col("_d"), "left").withColumns({
            "first": F.when(F.col("_hd").isNotNull(), F.col("_hf")).otherwise(F.col("first")),
            "tied": F.coalesce("_ht", "tied"), "_d": F.coalesce("_hd", "_d")})
    grouped = F.col("_d").isNotNull()
    leads = grouped & F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.select("page_id", "url", "html", "digest", "long", "first", grouped.alias("grouped"),
                           leads.alias("leads"), (leads & F.col("tied")).alias("open"))
    clear = joined.filter(~F.col("open")).withColumn("again", F.col("grouped") & ~F.col("leads"))
    alike = steps.save(joined.filter("open").withColumn("row", F.monotonically_increasing_id()), "alike")
    chosen = alike.groupBy("digest").agg(F.min("row").alias("_row")).select("_row")
    settled = alike.join(chosen, F.col("row") == F.col("_row"), "left").withColumn("again", F.col("_row").isNull())
    rows = clear.unionByName(settled.select(*clear.columns))
    return rows.select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), "digest", "again",
                       F.when(F.col("again"), F.col("first")).alias("first"), (F.col("long") & ~F.col("again")).alias("own"))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record per page row. Columns page_id, url, html; others are left out.

    A null html is an empty payload, a null url no target header. Of rows with equal payloads
    of at least REVISIT_BYTES, the one with the smallest page_id is a response, the others
    revisit it; shorter ones are all responses. An empty table gives an empty archive.
    """
    date = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def blobs(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            held, size, out = [], 0, []
            for page, url, payload, digest, again, first, own in zip(*[c.to_pylist() for c in batch.columns]):
                n += 1
                name = "" if page is None else page
                rid = f"<urn:page:{name}:{digest}>" if own else f"<urn:page:{name}:{digest}:{part}-{n}>"
                refers = f"<urn:page:{'' if first is None else first}:{digest}>" if again else None
                for r in page_records(page, url, payload, digest, refers, rid, date, segment_bytes):
                    held.append(r)
                    size += len(r)
                if size >= BLOB_BYTES:
                    out.append(_END.join(held))
                    held, size = [], 0
            if held:
                out.append(_END.join(held))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    steps = Steps(pages.sparkSession, "warc")
    rows = with_revisits(pages, steps).mapInArrow(blobs, "value binary")
    (rows.select(F.col("value").cast("string")).write.option("lineSep", _END.decode())
     .option("maxRecordsPerFile", FILE_BLOBS).text(path))


def read(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """A row per response or revisit of the archives in `path`.

    record_id, record_type, page_id, url, refers_to (page_id of the response of a revisit),
    payload_bytes, payload_digest, payload (null for a revisit), problem (null when all is well:
    all segments present, total length right, framing and digest right).
    """
    files = spark.read.format("binaryFile").load(path).select("content")

    def whole(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for head, block in parsed(data.as_py()):
                    if "warc-segment-number" in head or head["warc-type"] not in ("response", "revisit"):
                        continue
                    rows.append(row_of(head, block, keep_payload))
                    size += len(block)
                    if keep_payload and size > BLOB_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                yield _batch(rows)

    def segments(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, block in parsed(data.as_py()):
                    if "warc-segment-number" in head:
                        origin = head.get("warc-segment-origin-id") or head["warc-record-id"]
                        rows.append((origin, int(head["warc-segment-number"]), block, list(head.items())))
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                     pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.map_(pa.string(), pa.string()))],
                    names=["origin", "number", "block", "head"])

    def joined(batches):
        for batch in batches:
            yield _batch([_reassembled(r.as_py(), keep_payload) for r in batch.column(0)])

    cut = files.mapInArrow(segments, "origin string, number int, block binary, head map<string,string>")
    # One group is one page, which was one row when it was written.
    together = cut.groupBy("origin").agg(F.collect_list(F.struct("number", "block", "head")).alias("parts"))
    return files.mapInArrow(whole, _RECORD).unionByName(
        together.select("parts").mapInArrow(joined, _RECORD))


def _reassembled(parts: list[dict], keep: bool) -> tuple:
    parts = sorted(parts, key=lambda p: p["number"])
    numbers = [p["number"] for p in parts]
    heads = [dict(p["head"]) for p in parts]
    block = b"".join(p["block"] for p in parts)
    said = next((h["warc-segment-total-length"] for h in heads if "warc-segment-total-length" in h), None)
    problem = None
    if numbers != list(range(1, len(parts) + 1)):
        problem = "segment missing or repeated"
    elif said is None:
        problem = "last segment missing"
    elif int(said) != len(block):
        problem = "total length differs"
    head = heads[0]
    if "warc-segment-origin-id" in head:
        head = head | {"warc-record-id": head["warc-segment-origin-id"], "warc-type": "response"}
    return row_of(head, block, keep, problem)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 9
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(),
             pa.binary(), pa.string()]
    names = [f.split()[0] for f in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def op6_warc(spark, sf_dir):
    path = new_folder(spark, "archive")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
 min(page_id) OVER (PARTITION BY html) AS first FROM p)
 SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
 CAST(NULL AS varchar) AS problem FROM q"""
