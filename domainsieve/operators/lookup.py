"""Key lookups that hold when the table is large or one key is very common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.sources.workdir import new_folder, written

# Rows up to which a lookup table of a few narrow columns is broadcast (tens of MB).
BROADCAST_ROWS = 200_000
# A key with more than one in HOT_SHARE of all rows is hot; so there are at most HOT_SHARE.
HOT_SHARE = 1000


def fits(df: DataFrame, rows: int | None = None) -> bool:
    """True when df has at most `rows` rows. Reads no more than that many plus one."""
    rows = BROADCAST_ROWS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def small_or_shuffled(df: DataFrame, size_of: DataFrame | None = None,
                      rows: int | None = None) -> DataFrame:
    """df with a broadcast hint when its checked size allows it, else as it is.

    `size_of` is a frame with at least as many rows that is cheaper to count.
    """
    return F.broadcast(df) if fits(df if size_of is None else size_of, rows) else df


def lookup_join(d: DataFrame, table: DataFrame, key: str, table_key: str, values: list[Column],
                spread: str = "domain", only: Column | None = None,
                size_of: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Left join of d with a table that is unique in `table_key`, adding `values`.

    A small table is broadcast. Otherwise d is stored once, so that what made d runs once
    however many lookups follow each other; the few keys that hold a large share of
    d are answered from a broadcast of just their table rows, and all other rows
    are joined by shuffle. Rows that need no lookup (hot, null key, or outside
    `only`) are spread by `spread`, so none of them pile up in one task.
    """
    active = F.col(key).isNotNull()
    if only is not None:
        active = active & F.coalesce(only, F.lit(False))
    t = table.select(F.col(table_key).alias("_k"), *values)
    names = [c for c in t.columns if c != "_k"]

    if fits(t if size_of is None else size_of, rows):
        return d.join(F.broadcast(t), active & (F.col(key) == F.col("_k")), "left").drop("_k")

    d = written(d, new_folder(d.sparkSession, "lookup"))
    bound = d.count() // HOT_SHARE
    hot = (d.filter(active).groupBy(F.col(key).alias("_hot")).count()
           .filter(F.col("count") > bound).select("_hot"))
    found = (t.join(F.broadcast(hot), F.col("_k") == F.col("_hot"), "left_semi")
             .select(F.col("_k").alias("_hk"), *[F.col(n).alias(f"_h_{n}") for n in names]))
    hot_rows = hot.join(F.broadcast(found), F.col("_hot") == F.col("_hk"), "left").drop("_hk")

    marked = d.join(F.broadcast(hot_rows), active & (F.col(key) == F.col("_hot")), "left")
    # As text, so that a key of any type can give way to one that spreads the row.
    cold_key = F.when(active & F.col("_hot").isNull(), F.col(key).cast("string")).otherwise(
        F.concat(F.lit("\x00"), F.col(spread).cast("string")))
    joined = marked.withColumn("_ck", cold_key).join(t, F.col("_ck") == F.col("_k").cast("string"), "left")
    picked = [F.when(F.col("_hot").isNotNull(), F.col(f"_h_{n}")).otherwise(F.col(n)).alias(n)
              for n in names]
    return joined.select(*d.columns, *picked)
