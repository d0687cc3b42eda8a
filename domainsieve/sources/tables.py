"""State tables of one store, changed together and read at one version.

A store is a folder with data folders and a version log (manifest.py). A version says, for each
table, which folders make it up. A change writes new folders for as many tables as it likes; nothing
of it is seen before its one commit, and a failed change leaves the old version of every table.

* Clustered tables are hash-distributed by a key, one sorted file per bucket, so joins, upserts and
  anti joins on that key read them in place; only the other side is shuffled.
* Logs get one folder per day and append. Retention drops whole folders from the version, rewrites
  the day of the limit, and touches nothing later.
* Schemas may gain and widen columns. Each folder remembers the schema it was written with and is
  brought to the newest on reading; nothing is rewritten.

Folders that no version in force names are deleted by vacuum(), so readers of a little while ago are safe.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from domainsieve.sources import manifest
from domainsieve.sources.sinks import utc_day
from domainsieve.sources.workdir import removed

# Types that another may be widened to.
WIDER = {"tinyint": ("smallint", "int", "bigint"), "smallint": ("int", "bigint"), "int": ("bigint", "double"),
         "float": ("double",), "date": ("timestamp",)}
# Attempts of a commit against others that change other tables.
TRIES = 10


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, f"{path}/versions"

    # -- reading ----------------------------------------------------------------

    def version(self) -> int:
        return manifest.latest(self.spark, self.log)[0]

    def tables(self, version: int | None = None) -> dict:
        if version is None:
            state = manifest.latest(self.spark, self.log)[1]
        else:
            state = manifest.read(self.spark, self.log, version)[1] if version else {}
        return state.get("tables", {})

    def read(self, name: str, version: int | None = None, first_day: str | None = None,
             last_day: str | None = None, after: int = 0) -> DataFrame:
        """Rows of a table in its newest schema.

        Of a log, only folders of the days from first_day to last_day, and of versions later
        than `after`, are opened.
        """
        return self._frame(self.tables(version)[name], first_day, last_day, after)

    def _frame(self, table: dict, first_day=None, last_day=None, after=0) -> DataFrame:
        schemas = [StructType.fromJson(s) for s in table["schemas"]]
        parts = [p for p in table["parts"] if p["since"] > after
                 and (first_day is None or p["day"] >= first_day) and (last_day is None or p["day"] <= last_day)]
        out = None
        for k in sorted({p["schema"] for p in parts}):
            own = [p for p in parts if p["schema"] == k]
            if table["key"] and len(own) == 1 and k == len(schemas) - 1:
                one = self._attached(own[0], schemas[k], table)
            else:
                one = self.spark.read.schema(schemas[k]).parquet(*[f"{self.path}/{p['path']}" for p in own])
            one = _brought_to(one, schemas[-1], table["fill"])
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], schemas[-1]) if out is None else out

    def _attached(self, part: dict, schema: StructType, table: dict) -> DataFrame:
        """A clustered folder as a catalog table, which is where Spark looks for buckets."""
        name = _table_name(part["path"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            by = f"CLUSTERED BY (`{table['key']}`) SORTED BY (`{table['key']}`) INTO {table['buckets']} BUCKETS"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {by} "
                           f"LOCATION '{self.path}/{part['path']}'")
        return self.spark.table(name)

    # -- changing ---------------------------------------------------------------

    def change(self) -> Change:
        return Change(self)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete folders that the last `keep` versions do not name. Returns them."""
        version, state = manifest.latest(self.spark, self.log)
        gone = [r for r in state.get("retired", ()) if r["since"] <= version - keep + 1]
        for r in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {_table_name(r['path'])}")
            removed(self.spark, f"{self.path}/{r['path']}")
        if gone:
            state["retired"] = [r for r in state["retired"] if r not in gone]
            manifest.commit(self.spark, self.log, version, state)
        return [r["path"] for r in gone]


def _table_name(folder: str) -> str:
    return "state_" + folder.replace("/", "_").replace("=", "_").replace("-", "_")


def _nullable(schema: StructType) -> StructType:
    """Stored columns may all be null."""
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def _brought_to(df: DataFrame, schema: StructType, fill: Mapping[str, str]) -> DataFrame:
    """df with the columns of a later schema: missing ones null or filled, others widened."""
    if _nullable(df.schema) == schema:
        return df
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.col(fill[f.name]) if f.name in fill else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in schema.fields])


class Change:
    """What one commit will put in force. Tables that it reads come from the version it began at."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        self.base, state = manifest.latest(self.spark, store.log)
        self.old, self.new, self.pinned = state.get("tables", {}), {}, False

    def _table(self, name: str) -> dict:
        now = self.new.get(name) or self.old.get(name) or {
            "schemas": [], "parts": [], "fill": {}, "key": None, "buckets": 0, "notes": {}}
        return {**now, "parts": list(now["parts"]), "schemas": list(now["schemas"]), "notes": dict(now["notes"])}

    def read(self, name: str, **which) -> DataFrame:
        """The table as this change has it so far."""
        return self.store._frame(self.new.get(name) or self.old[name], **which)

    def notes(self, name: str) -> dict:
        return self._table(name)["notes"]

    def note(self, name: str, **values) -> None:
        """Small facts about a table, kept with its version."""
        table = self._table(name)
        table["notes"].update(values)
        self.new[name] = table

    def replace(self, name: str, df: DataFrame, key: str | None = None, buckets: int = 0,
                placed: bool = False) -> None:
        """All rows of a table. With `key`, clustered in `buckets` sorted files.

        Give at least as many buckets as the session has shuffle partitions; with fewer, Spark
        would rather shuffle both sides of a join. `placed` says that df comes from a join on the
        key with a table clustered alike, so that its rows lie in their buckets already and are
        written without a shuffle; were it wrong, buckets would only have more files.
        """
        table, folder = self._table(name), f"{name}/{uuid.uuid4().hex}"
        if key:
            rows = df if placed else df.repartition(buckets, key)
            (rows.write.bucketBy(buckets, key).sortBy(key)
             .option("path", f"{self.store.path}/{folder}").saveAsTable(_table_name(folder)))
        else:
            df.write.parquet(f"{self.store.path}/{folder}")
        schema = _nullable(df.schema).jsonValue()
        table.update(schemas=[schema], fill={}, key=key, buckets=buckets,
                     parts=[{"path": folder, "schema": 0, "day": None, "since": self.base + 1}])
        self.new[name] = table

    def append(self, name: str, df: DataFrame, time_name: str) -> None:
        """Rows for a log, in one folder for each UTC day of their time (null times: day 0001-01-01)."""
        table, folder = self._table(name), f"{name}/{uuid.uuid4().hex}"
        if table["schemas"]:
            newest = StructType.fromJson(table["schemas"][-1])
            df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in newest.fields])
        else:
            table["schemas"] = [_nullable(df.schema).jsonValue()]
        day = F.coalesce(utc_day(F.col(time_name)).cast("string"), F.lit("0001-01-01"))
        # Adaptive execution gathers small days and splits large ones.
        (df.withColumn("_day", day).hint("rebalance", "_day")
         .write.partitionBy("_day").parquet(f"{self.store.path}/{folder}"))
        table["parts"] += [{"path": f"{folder}/{n}", "schema": len(table["schemas"]) - 1,
                            "day": n.removeprefix("_day="), "since": self.base + 1}
                           for n in sorted(manifest.children(self.spark, f"{self.store.path}/{folder}"))
                           if n.startswith("_day=")]
        self.new[name] = table

    def evolve(self, name: str, schema: StructType | str, fill: Mapping[str, str] | None = None) -> None:
        """A newer schema: more columns, wider types. `fill` names for a new column the one whose
        value older rows take; others are null there. No file is touched."""
        table = self._table(name)
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        old = StructType.fromJson(table["schemas"][-1])
        types = {f.name: f.dataType.simpleString() for f in schema.fields}
        for f in old.fields:
            before, now = f.dataType.simpleString(), types.get(f.name)
            if now != before and now not in WIDER.get(before, ()):
                raise ValueError(f"column {f.name} cannot go from {before} to {now}")
        unknown = [c for c in (fill or {}).values() if c not in old.names]
        if unknown:
            raise ValueError(f"no column {unknown[0]} to fill from")
        table["schemas"].append(_nullable(schema).jsonValue())
        table["fill"] = {**table["fill"], **(fill or {})}
        self.new[name] = table

    def retain(self, name: str, time_name: str, cutoff: Column) -> None:
        """Drop a log's rows before `cutoff`: earlier days' folders leave the version unread, the
        folders of its day are rewritten where they hold such rows, later ones stay as they are.
        Rows without a time go."""
        limit = self.spark.range(1).select(utc_day(cutoff).cast("string").alias("day"),
                                           cutoff.cast("timestamp").alias("at")).first()
        table, kept = self._table(name), []
        for p in table["parts"]:
            if p["day"] > limit["day"]:
                kept.append(p)
            elif p["day"] == limit["day"]:
                rows = self.store._frame({**table, "parts": [p]})
                stay = F.col(time_name) >= F.lit(limit["at"])
                if rows.filter(~stay).isEmpty():
                    kept.append(p)
                elif not rows.filter(stay).isEmpty():
                    folder = f"{name}/{uuid.uuid4().hex}/_day={p['day']}"
                    rows.filter(stay).write.parquet(f"{self.store.path}/{folder}")
                    kept.append({**p, "path": folder, "schema": len(table["schemas"]) - 1})
        table["parts"] = kept
        if kept != self._table(name)["parts"]:
            self.new[name] = table

    def commit(self) -> int:
        """Put all tables of the change in force at once and return the version.

        If others have committed meanwhile, the change is put on top of theirs, unless they
        touched one of its tables or it is pinned: then Conflict is raised and nothing changes.
        """
        if not self.new:
            return self.base
        for _ in range(TRIES):
            version, state = manifest.latest(self.spark, self.store.log)
            tables, retired = state.get("tables", {}), list(state.get("retired", ()))
            if self.pinned and version != self.base or any(tables.get(n) != self.old.get(n) for n in self.new):
                raise manifest.Conflict("a table of this change was changed by another")
            for name, table in self.new.items():
                for p in table["parts"]:
                    if p["since"] == self.base + 1:
                        p["since"] = version + 1
                paths = {p["path"] for p in table["parts"]}
                retired += [{"path": p["path"], "since": version + 1}
                            for p in tables.get(name, {}).get("parts", ()) if p["path"] not in paths]
            try:
                return manifest.commit(self.spark, self.store.log, version,
                                       {"tables": {**tables, **self.new}, "retired": retired})
            except manifest.Conflict:
                self.base = version
        raise manifest.Conflict("others were faster, every time")
