"""Writers: versioned snapshots of reference tables, and append-only logs.

A snapshot lies in <path>/data/v=<n>; <path>/commits holds one small row per
finished version. A version counts once its commit row is there, so a failed or
repeated job leaves the last good data in force.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from domainsieve.functions.literals import literal_table
from domainsieve.sources.workdir import new_folder, written

COMMIT_SCHEMA = "version long, rows long"


def current_version(spark: SparkSession, path: str) -> int | None:
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")
        return commits.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_snapshot(df: DataFrame, path: str) -> int:
    """Replace the table at path in one step and return its row count.

    An empty df leaves the old data in force.
    """
    spark = df.sparkSession
    version = (current_version(spark, path) or 0) + 1
    target = f"{path}/data/v={version}"
    df.write.mode("overwrite").parquet(target)
    rows = spark.read.schema(df.schema).parquet(target).count()
    if rows:
        commit = literal_table(spark, [(version, rows)], COMMIT_SCHEMA)
        commit.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return rows


def read_snapshot(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Current data of a snapshot; an empty table of `schema` when there is none yet."""
    version = current_version(spark, path)
    if version is None:
        if schema is None:
            raise ValueError(f"no snapshot at {path} and no schema given")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/data/v={version}")


def dense_ids(df: DataFrame, key: str, start: int = 0, name: str = "id") -> DataFrame:
    """Add ids start+1, start+2, … in the order of (hash of key, key); key is unique in df.

    Rows are numbered inside 4096 hash buckets, then shifted by the sizes of the
    buckets before. No task sees more than one bucket. The rows are written to the
    shared folder first, so sizes and numbers come from the same rows.
    """
    d = df.withColumn("_bucket", F.substring(F.md5(F.col(key).cast("string")), 1, 3))
    d = written(d, new_folder(df.sparkSession, "ids"))
    sizes = d.groupBy("_bucket").count()
    # At most 4096 rows in this unpartitioned window.
    before = F.sum("count").over(Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (d.join(F.broadcast(offsets), "_bucket")
            .withColumn(name, (rank + F.col("_before") + start).cast("long"))
            .drop("_bucket", "_before"))


def utc_day(at: Column) -> Column:
    """The day of a time in UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(86_400_000_000)).cast("int"))


def log_rows(df: DataFrame, key: str, at: Column, time_name: str, start: int = 0) -> DataFrame:
    """Rows ready for a log: generated id and time."""
    return dense_ids(df, key, start).withColumn(time_name, at)


def append_log(df: DataFrame, path: str, key: str, at: Column, time_name: str = "classified_at") -> None:
    """Append rows with ids above those in the log, partitioned by day of their time.

    The largest id is a maximum over one column that parquet footers answer.
    """
    spark = df.sparkSession
    try:
        start = spark.read.parquet(path).agg(F.max("id")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        start = 0
    (log_rows(df, key, at, time_name, start).withColumn("day", utc_day(F.col(time_name)))
     .write.mode("append").partitionBy("day").parquet(path))
