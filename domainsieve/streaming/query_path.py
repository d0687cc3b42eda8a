"""The query path on a stream of log lines: decided rows and scoring requests per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from domainsieve.operators.admission import distinct_first, skip_policy, unseen
from domainsieve.operators.names import TailIndex
from domainsieve.params import DEFAULTS, Params
from domainsieve.plans.query_path import (
    QueryTables, decided_verdicts, dispositions, model_requests, subdomain_blocks)
from domainsieve.streaming.seen import fold_seen, seen_names

def process_batch(lines: DataFrame, batch: int, out: str, policy: TailIndex,
                  tables: Callable[[SparkSession], QueryTables], as_of=None,
                  params: Params = DEFAULTS) -> None:
    """Decide the names of one batch and write what follows under folders batch=<n>.

    Every folder is replaced as a whole, so a batch that runs again after a
    failure leaves the same rows. Seen names of earlier batches are folded when enough
    have come together (seen.py). `tables` is called per batch, so changed
    reference tables count from the next batch on.
    """
    spark = lines.sparkSession
    as_of = F.current_timestamp() if as_of is None else as_of
    names = distinct_first(skip_policy(lines.select("domain"), policy))
    fold_seen(spark, out, as_of, params)
    # A batch that runs again does not see its own first try.
    fresh = unseen(names, seen_names(spark, out, before=batch), as_of, params.seen_ttl_days)
    decided_path = f"{out}/decided/batch={batch}"
    dispositions(fresh, tables(spark), as_of, params).write.mode("overwrite").parquet(decided_path)
    decided = spark.read.parquet(decided_path)
    for name, rows in (("verdicts", decided_verdicts(decided, params)
                        .withColumn("classified_at", as_of)),
                       ("requests", model_requests(decided)),
                       ("blocks", subdomain_blocks(decided)),
                       ("seen", decided.select("domain", as_of.alias("last_seen")))):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")


def disposition_stream(lines: DataFrame, out: str, checkpoint: str, policy: TailIndex,
                       tables: Callable[[SparkSession], QueryTables], as_of=None,
                       params: Params = DEFAULTS, **trigger) -> StreamingQuery:
    """Start the query path on a stream of parsed log lines (see read_query_log)."""
    def step(df: DataFrame, batch: int) -> None:
        process_batch(df, batch, out, policy, tables, as_of, params)

    return (lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start())
