"""Vector code compression: product codes whose nearest entries are found by Orchard's search.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Each part
position has a codebook of integer entries: the parts of the smallest ids first, then means of
the parts assigned to them, for some rounds. All arithmetic is on integers, so results do not
depend on how rows are dealt.

Orchard's search keeps, for every entry, a list of all entries by distance from it. A part starts
at entry 0 and walks that entry's list; when it meets a nearer entry it goes on in that one's
list. Entries seen are marked and not compared again. It ends where the list's distance is beyond
twice the distance to the current entry: by the triangle inequality nothing later is nearer. An
entry at just twice the distance may tie and is still looked at, so ties go to the lower index.

A round is one pass of Arrow batches over the stored integers. A task sends one row: its sums and
counts per entry. What comes to the driver is a codebook, entries x dimension numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from domainsieve.llm.common import Steps, hot_join, with_fields

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
# Numbers of a slice of rows that is searched at once.
SLICE = 1 << 19


@dataclass
class Codebooks:
    """entries[p, e]: entry e of part position p. lists and stops: see orchard()."""
    entries: np.ndarray
    lists: np.ndarray
    stops: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebooks:
        gaps = ((entries[:, :, None, :] - entries[:, None, :, :]) ** 2).sum(-1)
        lists = np.argsort(gaps, axis=2, kind="stable")
        # gap > 4 * distance, without the product: a quarter of the gap, rounded up, is larger.
        return cls(entries, lists, (np.take_along_axis(gaps, lists, 2) + 3) >> 2)

    def sha256(self) -> str:
        """Of all numbers by part, entry and position, in decimals with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def orchard(q: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and the squared distance to it, for q[row, part, position].

    All parts walk their lists in step; a step looks at one list place of every part still open.
    """
    rows, parts, width = q.shape
    k = books.entries.shape[1]
    flat, part = q.reshape(rows * parts, width), np.tile(np.arange(parts), rows)
    at_entry = np.zeros(len(flat), np.int64)
    near = ((flat - books.entries[part, 0]) ** 2).sum(1)
    seen = np.zeros((len(flat), k), bool)
    seen[:, 0] = True
    place = np.zeros(len(flat), np.int64)
    live = np.arange(len(flat))
    while len(live):
        p, c, i = part[live], at_entry[live], place[live]
        go = books.stops[p, c, i] <= near[live]
        e = books.lists[p, c, i][go]
        live = live[go]
        place[live] += 1
        new = ~seen[live, e]
        own, e = live[new], e[new]
        seen[own, e] = True
        d = ((flat[own] - books.entries[part[own], e]) ** 2).sum(1)
        better = (d < near[own]) | ((d == near[own]) & (e < at_entry[own]))
        own = own[better]
        at_entry[own], near[own], place[own] = e[better], d[better], 0
        live = live[place[live] < k]
    return at_entry.reshape(rows, parts), near.reshape(rows, parts)


def _matrices(column: pa.Array, dim: int, parts: int) -> Iterator[np.ndarray]:
    """Integers of a column without nulls, some rows at a time, as [row, part, position]."""
    step = max(1, SLICE // dim)
    for s in range(0, len(column), step):
        some = column.slice(s, step)
        yield some.flatten().to_numpy().astype(np.int64).reshape(len(some), parts, dim // parts)


def _finite(vector: Column) -> Column:
    """Vectors without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def largest(dim: int) -> int:
    """Bound of an integer component, so that no distance of two vectors leaves 64 bits."""
    return int((2 ** 62 / dim) ** 0.5 / 2)


def _integers(d: DataFrame, id_: str, vector: str, steps: Steps, parts: int,
              scale: int) -> tuple[DataFrame, int]:
    """Kept rows with their integers in `_ints` (null where a vector cannot be coded), stored."""
    v = F.col(vector).cast("array<double>")
    kept = d.filter(_finite(v))
    lens = (kept.groupBy(F.size(vector).alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0))
            .orderBy(F.desc("count"), "n").limit(1).collect())
    dim = lens[0]["n"] if lens else 0
    scaled = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))))
    bound = F.lit(float(largest(dim or 1)) / scale)
    fits = (F.size(vector) == dim) & F.forall(v, lambda x: F.abs(x) < bound)
    return steps.save(kept.withColumn("_ints", F.when(fits & F.lit(dim > 0), scaled)), "integers"), dim


def _first_entries(ints: DataFrame, id_: str, parts: int, entries: int, dim: int) -> np.ndarray:
    """Parts of the vectors with the smallest distinct ids; of one id, the smallest vector."""
    coded = ints.filter(F.col("_ints").isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).alias("id"), "_ints")
    ids = coded.select("id").distinct().orderBy("id").limit(entries)
    seeds = coded.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("_ints").alias("v")).orderBy("id").collect()
    rows = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, dim // parts)
    return rows.transpose(1, 0, 2).copy()


def _means(ints: DataFrame, books: Codebooks, dim: int) -> Codebooks:
    """Entries replaced by the floored mean of their parts; unused entries stay."""
    parts, k, width = books.entries.shape

    def run(batches):
        total = np.zeros((parts * k, width + 1), np.int64)
        for batch in batches:
            for q in _matrices(batch.column(0), dim, parts):
                code, _ = orchard(q, books)
                cell = (code + np.arange(parts) * k).ravel()
                flat = q.reshape(len(cell), width)
                for j in range(width):
                    np.add.at(total[:, j], cell, flat[:, j])
                np.add.at(total[:, width], cell, 1)
        if total[:, width].any():
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()])], names=["total"])

    sums = (ints.filter("_ints IS NOT NULL").select("_ints").mapInArrow(run, "total array<long>")
            .select(F.posexplode("total").alias("at", "x"))
            .groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")))
    total = [0] * (parts * k * (width + 1))
    for r in sums.collect():
        total[r["at"]] = int(r["x"])
    entries = books.entries.copy().reshape(parts * k, width)
    for cell in range(parts * k):
        *s, n = total[cell * (width + 1):(cell + 1) * (width + 1)]
        if n:
            entries[cell] = [x // n for x in s]
    return Codebooks.of(entries.reshape(parts, k, width))


def _coded(ints: DataFrame, books: Codebooks | None, dim: int) -> DataFrame:
    """ints with `_code` and `_error`, without `_ints`."""
    schema = with_fields(ints.drop("_ints"), {"_code": "string", "_error": "long"})
    if books is None:
        return ints.select(*[F.col(f"`{c}`") for c in ints.columns if c != "_ints"],
                           F.lit(None).cast("string").alias("_code"), F.lit(None).cast("long").alias("_error"))
    parts = books.entries.shape[0]
    at = ints.columns.index("_ints")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            valid = column.is_valid().to_numpy(zero_copy_only=False)
            codes, errors = np.full(len(column), None, object), np.zeros(len(column), np.int64)
            rows, done = np.flatnonzero(valid), 0
            for q in _matrices(column.drop_null(), dim, parts):
                code, near = orchard(q, books)
                own = rows[done:done + len(q)]
                codes[own] = [c.tobytes().hex() for c in code.astype(np.uint8)]
                errors[own] = near.sum(1)
                done += len(q)
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(codes.tolist(), pa.string()), pa.array(errors, mask=~valid)], names=schema.names)

    return ints.mapInArrow(run, schema)


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             names: Sequence[str] = ("code", "error", "label_error", "codebooks_sha256")) -> DataFrame:
    """df without its bad vectors, and `names`: code, error, error summed over equal labels, digest.

    Vectors that are null or hold null or non-finite components are dropped. The dimension is the
    most frequent length that `parts` divides (the shortest of equals); vectors of other lengths,
    or with a component beyond largest() / scale, stay with a null code and error and take no part
    in codebooks. Null labels are one group, whose sum may be null if all its errors are. Codebooks
    start with the smallest distinct ids (null ids give none; of one id's vectors the smallest);
    with fewer ids than `entries` they are shorter, with none all codes are null. Repeated rows
    each count and are each returned. Columns of df that bear one of `names` are replaced; an
    empty table gives an empty one. At most 256 entries, as a code has two hex digits per part.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries: 1 to 256")
    columns = df.columns
    own = {c: f"c{i}" for i, c in enumerate(columns)}
    id_, vector, label = own[id_col], own[vector_col], own[label_col]
    steps = Steps(df.sparkSession, "vector-codes")
    ints, dim = _integers(df.toDF(*own.values()), id_, vector, steps, parts, scale)
    books = None
    if dim:
        first = _first_entries(ints, id_, parts, entries, dim)
        if first.shape[1]:
            books = Codebooks.of(first)
            for _ in range(rounds):
                books = _means(ints, books, dim)
    coded = steps.save(_coded(ints, books, dim).withColumn(
        "_label", F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit(""))), "codes")
    sums = steps.save(coded.groupBy("_label").agg(F.sum("_error").alias("_sum"), F.count("*").alias("_n")), "labels")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    joined = hot_join(coded, sums, "_label", "_n", total)
    code, error, label_error, digest = names
    sha = F.lit(books.sha256() if books else None).cast("string")
    kept = [F.col(own[c]).alias(c) for c in columns if c not in names]
    return joined.select(*kept, F.col("_code").alias(code), F.col("_error").alias(error),
                         F.col("_sum").alias(label_error), sha.alias(digest))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`: its code, error, its label's error and the codebooks' digest."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return compress(table).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle(parts: int = PARTS, width: int = 4, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry, for vectors of parts * width components."""
    places = range(width)
    cut = ", ".join(f"CAST(floor(256 * CAST(embedding[p * {width} + {j + 1}] AS DOUBLE)) AS BIGINT) AS q{j}"
                    for j in places)
    distance = " + ".join(f"(q{j} - b{j}) * (q{j} - b{j})" for j in places)
    steps = ["""bad AS (
  SELECT DISTINCT vec_id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) AS u
  WHERE x IS NULL OR NOT isfinite(x)),
kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM bad))""",
             f"""cuts AS (
  SELECT vec_id, label, p, {cut} FROM kept CROSS JOIN (SELECT unnest(range(0, {parts})) AS p))""",
             f"""seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
book0 AS (SELECT p, e, {", ".join(f"q{j} AS b{j}" for j in places)}
  FROM cuts JOIN seeds USING (vec_id) WHERE e < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS (
  SELECT vec_id, cuts.p AS p, min(({distance}) * {entries} + e) AS m
  FROM cuts JOIN book{r} ON cuts.p = book{r}.p GROUP BY vec_id, cuts.p)""")
        if r < rounds:
            mean = ", ".join(f"CAST(sum(q{j}) AS BIGINT) AS s{j}" for j in places)
            # Floored division, whichever way the engine rounds a quotient of integers.
            new = ", ".join(f"CASE WHEN n IS NULL THEN b{j} ELSE (s{j} - ((s{j} % n) + n) % n) // n END AS b{j}"
                            for j in places)
            steps.append(f"""sum{r} AS (
  SELECT cuts.p AS p, m % {entries} AS e, count(*) AS n, {mean}
  FROM cuts JOIN near{r} ON cuts.vec_id = near{r}.vec_id AND cuts.p = near{r}.p GROUP BY cuts.p, m % {entries}),
book{r + 1} AS (SELECT book{r}.p AS p, book{r}.e AS e, {new}
  FROM book{r} LEFT JOIN sum{r} ON book{r}.p = sum{r}.p AND book{r}.e = sum{r}.e)""")
    hexed = "substr('0123456789abcdef', CAST({0} AS INT) + 1, 1)"
    index = f"(m % {entries})"
    digits = f"{hexed.format(index + ' // 16')} || {hexed.format(index + ' % 16')}"
    numbers = " || ',' || ".join(f"CAST(b{j} AS VARCHAR)" for j in places)
    steps.append(f"""coded AS (
  SELECT vec_id, string_agg({digits}, '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id),
labelled AS (SELECT kept.vec_id AS vec_id, label, code, error FROM kept JOIN coded ON kept.vec_id = coded.vec_id),
digest AS (SELECT sha256(string_agg({numbers}, ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM labelled CROSS JOIN digest"""


ORACLE = _oracle()
