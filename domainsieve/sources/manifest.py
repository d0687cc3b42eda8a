"""Version logs: one small JSON file per version, written whole and never replaced.

The highest version is in force. A writer names the version that it has read; if another
writer was faster, its commit fails and leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _at(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _filesystem(spark: SparkSession, path: str):
    return _at(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none when it does not exist."""
    fs, at = _filesystem(spark, path), _at(spark, path)
    if not fs.exists(at):
        return []
    return [s.getPath().getName() for s in fs.listStatus(at)]


def latest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, state); (0, {}) before the first commit."""
    versions = [int(n.removesuffix(".json")) for n in children(spark, path) if n[0].isdigit()]
    return read(spark, path, max(versions)) if versions else (0, {})


def read(spark: SparkSession, path: str, version: int) -> tuple[int, dict]:
    file = f"{path}/{version:020d}.json"
    stream = _filesystem(spark, file).open(_at(spark, file))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, json.loads(text)


def commit(spark: SparkSession, path: str, base: int, state: dict) -> int:
    """Put `state` in force as the version after `base`. Raises Conflict if that one exists.

    The file is written under another name and renamed without overwriting, as Spark's streams
    do with their own logs.
    """
    jvm = spark.sparkContext._jvm
    fs = _filesystem(spark, path)
    target, draft = _at(spark, f"{path}/{base + 1:020d}.json"), _at(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(json.dumps(state, sort_keys=True).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if draft.toUri().getScheme() else (
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration()))
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, target, no_options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            raise Conflict(f"version {base + 1} of {path} is taken") from None
        raise
    return base + 1
