"""The denylist, its groups, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.fixed import BLOCK_GROUP
from domainsieve.operators.admission import skip_policy
from domainsieve.operators.lookup import small_or_shuffled
from domainsieve.operators.names import TailIndex
from domainsieve.sources.sinks import dense_ids

DEFAULT_GROUP = 0


def _starts(comment: Column, *prefixes: str) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.lower(comment).startswith(p.lower())
    return F.coalesce(out, F.lit(False))


def max_id(df: DataFrame) -> int:
    return df.agg(F.max("id")).first()[0] or 0


def denylist_add(denylist: DataFrame, d: DataFrame, policy: TailIndex, as_of: Column) -> DataFrame:
    """New denylist rows for (domain, comment): not on a policy, not on the list yet.

    A name given twice is added once, with its smallest comment.
    """
    d = d.select(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain"), "comment")
    wanted = skip_policy(d, policy).groupBy("domain").agg(F.min("comment").alias("comment"))
    new = wanted.join(denylist.select("domain"), "domain", "left_anti")
    at = F.unix_timestamp(as_of.cast("timestamp"))
    return dense_ids(new, "domain", max_id(denylist)).select(
        "id", "domain", F.lit(1).alias("type"), F.lit(1).alias("enabled"),
        at.alias("date_added"), at.alias("date_modified"), "comment")


def listed_ids(denylist: DataFrame, d: DataFrame) -> DataFrame:
    """Ids of the denylist rows of the given names."""
    names = d.select(F.lower("domain").alias("domain")).distinct()
    return (denylist.filter("type = 1").join(names, "domain", "left_semi")
            .select(F.col("id").alias("domainlist_id")))


def ensure_group(groups: DataFrame, as_of: Column, name: str = BLOCK_GROUP,
                 description: str = "Names blocked by threat analytics") -> DataFrame:
    """groups with the block group added if it is missing. The table has a row per group."""
    at = F.unix_timestamp(as_of.cast("timestamp"))
    top = groups.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id"),
                     F.coalesce(F.max((F.col("name") == name).cast("int")), F.lit(0)).alias("has"))
    new = top.filter("has = 0").select(
        "id", F.lit(1).alias("enabled"), F.lit(name).alias("name"), at.alias("date_added"),
        at.alias("date_modified"), F.lit(description).alias("description"))
    return groups.unionByName(new.select(*groups.columns))


def group_id(groups: DataFrame, name: str = BLOCK_GROUP) -> int:
    """Id of a group, by a lookup of one row."""
    return groups.filter(F.col("name") == name).select("id").first()[0]


def group_assign(mapping: DataFrame, ids: DataFrame, group: int) -> DataFrame:
    """mapping with the given denylist rows moved from the default group to `group`."""
    ids = ids.select("domainlist_id").distinct()
    moved = mapping.filter(F.col("group_id") == DEFAULT_GROUP).join(ids, "domainlist_id", "left_anti")
    others = mapping.filter(F.col("group_id") != DEFAULT_GROUP)
    added = ids.withColumn("group_id", F.lit(group).cast("long"))
    return moved.unionByName(others).unionByName(added).distinct()


def denylist_remove(denylist: DataFrame, mapping: DataFrame, d: DataFrame,
                    prefix: str) -> tuple[DataFrame, DataFrame]:
    """Denylist and mapping without the given names' rows whose comment has the prefix."""
    names = d.select(F.lower("domain").alias("domain")).distinct()
    gone = (denylist.filter((F.col("type") == 1) & _starts(F.col("comment"), prefix))
            .join(names, "domain", "left_semi").select(F.col("id").alias("_gone")))
    return (denylist.join(gone, F.col("id") == F.col("_gone"), "left_anti"),
            mapping.join(gone, F.col("domainlist_id") == F.col("_gone"), "left_anti"))


def migrate_groups(denylist: DataFrame, mapping: DataFrame, group: int) -> DataFrame:
    """Move every generated denylist row to the block group. Repeatable."""
    made = denylist.filter((F.col("type") == 1) & _starts(F.col("comment"), "AI:", "TI:"))
    return group_assign(mapping, made.select(F.col("id").alias("domainlist_id")), group)


# -- reports ------------------------------------------------------------------

def group_members(denylist: DataFrame, mapping: DataFrame, groups: DataFrame,
                  name: str = BLOCK_GROUP) -> DataFrame:
    """(id, domain, comment) of the rows in a group."""
    wanted = groups.filter(F.col("name") == name).select(F.col("id").alias("group_id"))
    ids = (mapping.join(small_or_shuffled(wanted), "group_id", "left_semi")
           .select(F.col("domainlist_id").alias("id")))
    return denylist.join(ids, "id", "left_semi").select("id", "domain", "comment")


def blocks_by_origin(denylist: DataFrame) -> DataFrame:
    """(origin, kind, blocks): generated rows by the first two parts of their comment."""
    parts = F.split("comment", ":")
    return (denylist.filter(_starts(F.col("comment"), "AI:", "TI:"))
            .groupBy(F.get(parts, 0).alias("origin"), F.get(parts, 1).alias("kind"))
            .agg(F.count("*").alias("blocks")))
