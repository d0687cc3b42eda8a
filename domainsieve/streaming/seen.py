"""The names that a running stream has seen: batch folders, folded into levels while it runs.

Each batch leaves one folder, seen/batch=<n>. As soon as FAN finished ones have come together they
are folded into one folder of the first level, FAN of those into one of the second, and so on. A
version log (sources/manifest.py) says which level folders are in force and which batch is the last
that they hold; readers take them and the batch folders after that one. So a batch reads at most
about 2 * FAN folders and FAN for each level, whose number is the logarithm of the batches, and a
name is rewritten once per level.

Folding may run in the stream's own batches or in another process, also while a batch is running.
Only batches before the newest folder are folded: the newest may still run again. Of two that fold
at once, one commits and the other gives up. A folder that was replaced is deleted once two newer
batches have written theirs: the batch that ran when it was replaced has then read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from domainsieve.operators.state import days_before
from domainsieve.params import DEFAULTS, Params
from domainsieve.sources import manifest
from domainsieve.sources.workdir import removed

SEEN = "domain string, last_seen timestamp"
FAN = 8


def _log(out: str) -> str:
    return f"{out}/seen_log"


def _state(spark: SparkSession, out: str) -> tuple[int, dict]:
    version, state = manifest.latest(spark, _log(out))
    return version, state or {"covers": -1, "levels": [], "retired": []}


def _batches(spark: SparkSession, out: str) -> list[int]:
    found = manifest.children(spark, f"{out}/seen")
    return sorted(int(n.removeprefix("batch=")) for n in found if n.startswith("batch="))


def seen_folders(spark: SparkSession, out: str, before: int | None = None) -> list[str]:
    """Folders that hold the names seen by the batches before `before`, or by all."""
    state = _state(spark, out)[1]
    levels = [p for level in state["levels"] for p in level]
    return levels + [f"seen/batch={b}" for b in _batches(spark, out)
                     if b > state["covers"] and (before is None or b < before)]


def _read(spark: SparkSession, out: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], SEEN)
    return spark.read.schema(SEEN).parquet(*[f"{out}/{f}" for f in folders])


def seen_names(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(domain, last_seen), perhaps several rows a name, of the batches before `before`, or of all."""
    return _read(spark, out, seen_folders(spark, out, before))


def _choice(state: dict, finished: list[int], whole: bool) -> tuple[list[str], int] | None:
    """(folders, level): what to fold next, and the level of the new folder."""
    batches = [f"seen/batch={b}" for b in finished if b > state["covers"]]
    levels = state["levels"]
    if whole:
        folders = [p for level in levels for p in level] + batches
        return (folders, max(len(levels), 1)) if len(folders) > 1 else None
    if len(batches) >= FAN:
        return batches, 1
    for k, level in enumerate(levels):
        if len(level) >= FAN:
            return level, k + 2
    return None


def _delete_old(spark: SparkSession, out: str, state: dict, newest: int) -> None:
    """Delete replaced folders that no running batch can be reading, and note when others may go.

    A folder's replacement is in force when this is called, so a batch that still reads it is at
    most the one after the newest folder of now.
    """
    for r in state["retired"]:
        if r["after"] is not None and newest >= r["after"] + 2:
            removed(spark, f"{out}/{r['path']}")
    state["retired"] = [r if r["after"] is not None else {**r, "after": newest}
                        for r in state["retired"] if r["after"] is None or newest < r["after"] + 2]


def fold_seen(spark: SparkSession, out: str, as_of, params: Params = DEFAULTS, whole: bool = False) -> int:
    """Fold what is due, or with `whole` everything that is finished into one folder.

    Rows past retention are left out. Returns the number of new folders in force.
    """
    done = 0
    while True:
        version, state = _state(spark, out)
        batches = _batches(spark, out)
        choice = _choice(state, batches[:-1], whole)
        if choice is None:
            return done
        folders, level = choice
        path = f"seen_levels/{uuid.uuid4().hex}"
        (_read(spark, out, folders).groupBy("domain").agg(F.max("last_seen").alias("last_seen"))
         .filter(F.col("last_seen") >= days_before(as_of, params.retention_days))
         .write.parquet(f"{out}/{path}"))
        _delete_old(spark, out, state, batches[-1])
        levels = [[p for p in own if p not in folders] for own in state["levels"]]
        levels += [[] for _ in range(level - len(levels))]
        levels[level - 1].append(path)
        folded = [int(f.removeprefix("seen/batch=")) for f in folders if f.startswith("seen/")]
        try:
            manifest.commit(spark, _log(out), version, {
                "covers": max([state["covers"], *folded]), "levels": levels,
                "retired": state["retired"] + [{"path": f, "after": None} for f in folders]})
        except manifest.Conflict:
            removed(spark, f"{out}/{path}")
            return done
        done += 1


def compact_seen(spark: SparkSession, out: str, as_of, params: Params = DEFAULTS) -> int:
    """Fold all finished batches into one folder, also while the stream runs. Returns how many
    names count as seen."""
    fold_seen(spark, out, as_of, params, whole=True)
    return seen_names(spark, out).agg(F.countDistinct("domain")).first()[0]
