"""Time-to-live admission on an unbounded stream, with one timestamp of state per name seen lately."""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "domain string, ts timestamp"
# How long after newer events an event may arrive.
LATE = "1 day"
# Groups of names that share a call of the processor and a timer. Part of a stream's state: to change
# it takes a new checkpoint.
BUCKETS = 1024
# A bucket is searched for ended names at most so many times within a ttl.
SEARCHES = 8
# An event without a time stands before all others, and is given out without one.
_NO_TIME = -(2 ** 63)

# Python workers get this code with the job, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def use_rocksdb(spark: SparkSession) -> None:
    """State lives on disk, so it may outgrow executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class _Admission(StatefulProcessor):
    """Admits an event when the last admitted one of its name is more than ttl ago.

    Inside a batch events count in order of time, across batches in order of arrival. A key is a
    bucket of names, whose state is a map from name to its last admission; only the names at hand
    are read and written. Once the watermark has passed a last admission by ttl, whatever is not
    late by then would be admitted with the state or without it; so a timer of the bucket ends it.
    """

    def __init__(self, ttl_micros: int):
        self.ttl = ttl_micros
        self.grid = max(1, ttl_micros // 1000 // SEARCHES)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", "domain string", "micros long")
        self.timer = handle.getValueState("timer", "millis long")

    def _end(self, last: int) -> int:
        """Milliseconds of the first whole one that is more than ttl after `last`."""
        return (last + self.ttl) // 1000 + 1

    def _wake(self, end: int, before: int | None) -> None:
        """Have the bucket searched at the first step of the grid from `end` on, or at `before` if earlier."""
        at = -(-end // self.grid) * self.grid
        if before is not None:
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.DataFrame({"domain": [], "t": []})
        for k, chunk in enumerate(rows):
            chunk = chunk[["domain"]].assign(t=chunk["t"].fillna(_NO_TIME).astype("int64"))
            events = (pd.concat([events, chunk]) if k else chunk).drop_duplicates()
        domains, admitted, first = [], [], None
        for name, own in events.groupby("domain", sort=False, dropna=False)["t"]:
            name = None if pd.isna(name) else name
            times = sorted(own.tolist())
            before = self.last.getValue((name,))
            at = 0 if before is None else bisect.bisect_right(times, before[0] + self.ttl)
            taken = []
            while at < len(times):
                taken.append(times[at])
                at = bisect.bisect_right(times, times[at] + self.ttl, at + 1)
            if taken:
                self.last.updateValue((name,), (taken[-1],))
                first = taken[-1] if first is None else min(first, taken[-1])
                domains += [name] * len(taken)
                admitted += taken
        if admitted:
            before = self.timer.get()
            self._wake(self._end(first), before[0] if before else None)
            yield pd.DataFrame({"domain": domains, "ts": pd.to_datetime(admitted, unit="us", utc=True)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ends = [(name, self._end(last[0])) for name, last in self.last.iterator()]
        self.timer.clear()
        left = [end for _, end in ends if end > now]
        if left:
            for name, end in ends:
                if end <= now:
                    self.last.removeKey(name)
            self._wake(min(left), None)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _drop_repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop_duplicates()


def admit_stream(events: DataFrame, ttl_days: float, late: str = LATE) -> DataFrame:
    """Admitted (domain, ts) of a streaming (domain, ts).

    Events may arrive up to `late` after newer ones; later still, they are dropped. State lasts
    until that watermark passes the last admission by the ttl, so it holds the names of about the
    last ttl and not all there ever were. Repeats of a name at the same time are dropped before
    the shuffle. Log times are whole seconds, so a name asked for constantly sends on at most
    one row per second and input batch. Names are grouped by BUCKETS hashes, as each call of the
    processor costs more than the events of most names.
    """
    ttl = int(ttl_days * 86_400_000_000)
    slim = events.select("domain", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    slim = slim.mapInPandas(_drop_repeats, "domain string, t long")
    timed = slim.withColumn("at", F.timestamp_micros("t")).withWatermark("at", late)
    return timed.withColumn("bucket", F.pmod(F.xxhash64("domain"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Admission(ttl), outputStructType=OUTPUT,
        outputMode="Append", timeMode="EventTime")
