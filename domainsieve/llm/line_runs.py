"""Line deduplication by a suffix array over line identifiers, with DataFrame operations only.

Prefix doubling: the rank of a line position at length 2L is the rank of the pair (rank at
length L here, rank at length L further on). Ranks are numbered in order, so they are the order
of the suffixes by their first 2L lines; positions with equal rank form an interval of suffixes
with at least that common prefix. A position whose rank is unique leaves the array: what starts
there is not repeated. Doubling ends when no position is left.

Each place that has an earlier copy keeps the longest length at which it has one. A line goes when
such a stretch of at least `min_lines` lines reaches over it, or when it alone has an earlier copy
and at least `min_words` words; the first copy of a line always stays. Order is by doc_id, then
line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from domainsieve.llm.common import Steps, hot_join

MIN_LINES = 2
# A repeated line of so many words goes by itself; words are what spaces part.
MIN_WORDS = 20
# Ranges of ranks in the numbering of classes; pairs of ranges are at most RANGES ** 2 rows.
RANGES = 256
_AT = ["doc_id", "h", "i"]


def _numbered(classes: DataFrame, high: Column, low: Column, order: list[Column]) -> DataFrame:
    """classes with `rank`: how many positions lie in classes before. high, low: range numbers
    that follow the order, so that no window holds more than one pair of ranges."""
    c = classes.withColumn("_x", high.cast("long")).withColumn("_y", low.cast("long"))
    # At most RANGES ** 2 rows.
    past = Window.orderBy("_x", "_y").rowsBetween(Window.unboundedPreceding, -1)
    offsets = c.groupBy("_x", "_y").agg(F.sum("n").alias("n")).select(
        "_x", "_y", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_x", "_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (c.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(offsets), ["_x", "_y"])
            .withColumn("rank", (F.col("_in") + F.col("_off")).cast("long")).drop("_x", "_y", "_in", "_off"))


def _classes(pairs: DataFrame) -> DataFrame:
    """Classes of `key` with several positions: n, and the first position in order."""
    return pairs.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct(*_AT)).alias("first")).filter("n > 1")


def repeated_starts(lines: DataFrame, min_lines: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of lines (doc_id, h, i, key): the starts of runs of min_lines lines that have an earlier
    copy, and (doc_id, h, i, lines) with the longest power of two at which a start is repeated."""
    total = lines.count()
    width = max(1, -(-total // RANGES))
    top = F.shiftright(F.col("key.a"), 56) + 128
    classes = steps.save(_numbered(_classes(lines), top, F.lit(0), [F.col("key")]), "classes")
    now, path = steps.replace(_ranked(lines, classes, total), "ranks", None)
    length, starts, depths = 1, None, None
    while now.limit(1).count():
        if starts is None and min_lines < 2 * length:
            # The interval of min_lines lines: two overlapping stretches of `length` lines.
            if min_lines == length:
                starts = steps.save(now.filter("later").select(*_AT), "starts")
            else:
                over = _pairs(now, min_lines - length)
                found = steps.save(_classes(over), "intervals")
                starts = steps.save(hot_join(over, found, "key", "n", total).filter(
                    F.struct(*_AT) > F.col("first")).select(*_AT), "starts")
        deep = now.filter("later").select(*_AT, F.lit(length).alias("lines"))
        pairs = steps.save(_pairs(now, length), "pairs")
        count = pairs.count()
        rank = F.col("key.r")
        classes = steps.save(_numbered(
            _classes(pairs), F.floor(rank / width), F.floor(F.col("key.r2") / width), [F.col("key")]), "classes")
        depths = steps.save(deep, "depth") if depths is None else depths.unionByName(steps.save(deep, "depth"))
        now, path = steps.replace(_ranked(pairs, classes, count), "ranks", path)
        length *= 2
    if starts is None:
        starts = lines.select(*_AT).limit(0)
    if depths is None:
        depths = lines.select(*_AT, F.lit(1).alias("lines")).limit(0)
    return starts, depths.groupBy(*_AT).agg(F.max("lines").alias("lines"))


def _ranked(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    return hot_join(rows, classes, "key", "n", total).select(
        *_AT, F.col("rank").alias("r"), (F.struct(*_AT) > F.col("first")).alias("later"))


def _pairs(ranks: DataFrame, ahead: int) -> DataFrame:
    """Positions with the pair of ranks here and `ahead` lines on; none where that is unique."""
    there = ranks.select("doc_id", "h", (F.col("i") - ahead).alias("i"), F.col("r").alias("r2"))
    return ranks.join(there, _AT).select(*_AT, F.struct("r", "r2").alias("key"))


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, h, i, key) per line; h tells texts of one doc_id apart. A key is 128 bits."""
    text = F.col("text").cast("string")
    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("h"), F.posexplode(F.split(text, "\n")).alias("i", "line"))
    key = F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.select(*_AT, key.alias("key"), (spaces + 1).alias("words")).dropDuplicates(_AT)


def repeated_lines(lines: DataFrame, min_lines: int, min_words: int, steps: Steps) -> DataFrame:
    """(doc_id, h, i) of the lines to delete, of stored line_keys()."""
    starts, depths = repeated_starts(lines, min_lines, steps)
    runs = depths.unionByName(starts.withColumn("lines", F.lit(min_lines))).groupBy(*_AT).agg(F.max("lines").alias("lines"))
    # Every line of a repeated run is itself a place with an earlier copy, so each is among these rows.
    reach = F.max(F.when(F.col("lines") >= min_lines, F.col("i") + F.col("lines"))).over(
        Window.partitionBy("doc_id", "h").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    covered = steps.save(runs.withColumn("reach", F.coalesce(reach, F.lit(0))), "runs")
    alone = covered.filter("reach <= i").join(lines.filter(F.col("words") >= min_words).select(*_AT), _AT)
    return covered.filter("reach > i").select(*_AT).unionByName(alone.select(*_AT))


def without_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text_kept, n_lines and n_kept; columns of these names are replaced, others stay.

    A line is deleted when it lies in a run of at least min_lines lines that an earlier place of
    the corpus has too, or has itself an earlier copy and at least min_words words. Rows with the
    same doc_id and text are one document; a row without a doc_id stays whole. A null text has no
    lines and stays null.
    """
    steps = Steps(docs.sparkSession, "line-runs")
    lines = steps.save(line_keys(docs), "lines")
    cut = repeated_lines(lines, min_lines, min_words, steps).groupBy(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(F.collect_set("i").alias("__gone"))
    text = F.col("text").cast("string")
    d = docs.drop("text_kept", "n_lines", "n_kept").withColumns({"__text": text, "__hash": F.xxhash64(text)})
    joined = d.join(cut, (d["doc_id"].cast("long") == cut["__id"]) & (d["__hash"] == cut["__h"]), "left")
    all_lines = F.split("__text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), "__gone")
    n = F.when(F.col("__text").isNull(), F.lit(0)).otherwise(F.size(all_lines))
    some = F.col("__gone").isNotNull()
    return joined.withColumns({
        "text_kept": F.when(some, F.array_join(F.transform(stay, lambda k: F.get(all_lines, k)), "\n"))
        .otherwise(F.col("__text")),
        "n_lines": n.cast("long"), "n_kept": F.when(some, F.size(stay)).otherwise(n).cast("long"),
    }).drop("__text", "__hash", "__id", "__h", "__gone")


def op10_line_runs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_runs(docs).select(
        "doc_id", "n_lines", "n_kept", F.sha2("text_kept", 256).alias("kept_sha256"))


ORACLE = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM l),
 r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS n
 FROM w WHERE next IS NOT NULL),
 s AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM l),
 gone AS (SELECT doc_id, i FROM r WHERE n > 1 UNION SELECT doc_id, i + 1 FROM r WHERE n > 1
 UNION SELECT doc_id, i FROM s WHERE n > 1 AND length(line) - length(replace(line, ' ', '')) + 1 >= {MIN_WORDS}),
 k AS (SELECT l.doc_id, l.i, l.line, g.i IS NULL AS stays FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE stays) AS n_kept,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
 FROM k GROUP BY doc_id"""
