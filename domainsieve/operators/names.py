"""Registrable names, hosting providers and host labels from public suffix rules.

Every name is matched against the rules with one broadcast hash join per label
depth. No shuffle is needed and the input columns stay in place. A table too large
for that is met by one join of distinct tails.
"""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import Column, DataFrame, functions as F

from domainsieve.fixed import SEED_HOSTING
from domainsieve.functions.literals import literal_table
from domainsieve.functions.names import IPV4, label_count
from domainsieve.operators.lookup import BROADCAST_ROWS, HOT_SHARE
from domainsieve.sources.workdir import new_folder, written

# Bits of a rule entry.
ICANN, ICANN_WILD, ICANN_EXCEPT = 1, 2, 4
PRIVATE, PRIVATE_WILD, PRIVATE_EXCEPT = 8, 16, 32
HOSTING = 64


@dataclass(frozen=True)
class TailIndex:
    """Label-aligned name tails with the bits that apply to each."""

    table: DataFrame  # base string, mask int; unique in base
    depth: int        # labels in the longest base
    large: bool = False  # too large to be broadcast


def tail_index(entries: DataFrame, depth: int | None = None) -> TailIndex:
    """Index of (base, mask) entries. Its size and depth are measured unless depth is given,
    which states that the entries are a short literal list."""
    mask = F.bit_or("mask").alias("mask")
    if depth is None:
        rows, depth = entries.agg(F.count("*"), F.max(label_count(F.col("base")))).first()
        if rows > BROADCAST_ROWS:
            return TailIndex(entries.groupBy("base").agg(mask), depth, large=True)
    # Few rows: one partition spares a shuffle.
    return TailIndex(F.broadcast(entries.coalesce(1).groupBy("base").agg(mask)), depth or 0)


LABELS = "(length(domain) - length(replace(domain, '.', '')) + 1)"


def match_tails(d: DataFrame, index: TailIndex, prefix: str = "_m") -> DataFrame:
    """Add the mask of each tail of `domain` as columns prefix1, prefix2, …"""
    if index.large and index.depth:
        return _match_by_tail(d, index, prefix)
    for k in range(1, index.depth + 1):
        t = index.table.selectExpr("base AS _base", f"mask AS {prefix}{k}")
        tail = f"if({LABELS} >= {k}, substring_index(domain, '.', -{k}), null) = _base"
        d = d.join(t, F.expr(tail), "left").drop("_base")
    return d


def _match_by_tail(d: DataFrame, index: TailIndex, prefix: str) -> DataFrame:
    """match_tails against a large table: one join whatever the depth.

    Distinct tails are looked up, so that a tail of very many names is one row there. On the
    way back the tails of more than one in HOT_SHARE rows are broadcast, the others shuffled.
    """
    folder = new_folder(d.sparkSession, "tails")
    ks = F.expr(f"sequence(1, least({LABELS}, {index.depth}))")
    names = d.filter("domain IS NOT NULL").select("domain").distinct()
    tails = written(names.select("domain", F.explode(ks).alias("k")).withColumn(
        "tail", F.expr("substring_index(domain, '.', -k)")), f"{folder}/tails")
    found = written(tails.groupBy("tail").count().join(index.table.withColumnRenamed("base", "tail"), "tail"),
                    f"{folder}/found")
    bound = tails.count() // HOT_SHARE
    hot = F.broadcast(found.filter(F.col("count") > bound))
    cold = found.filter(F.col("count") <= bound)
    hits = tails.join(hot, "tail").unionByName(
        tails.join(hot.select("tail"), "tail", "left_anti").join(cold, "tail"))
    masks = hits.groupBy(F.col("domain").alias("_name")).agg(*[
        F.max(F.when(F.col("k") == k, F.col("mask"))).alias(f"{prefix}{k}") for k in range(1, index.depth + 1)])
    return d.join(masks, F.col("domain") == F.col("_name"), "left").drop("_name")


def suffix_index(rules: DataFrame, hosting: DataFrame | None = None,
                 depth: int | None = None) -> TailIndex:
    """Index of suffix rules (see read_suffix_rules) and hosting suffixes."""
    private = F.col("section") == "private"
    bits = (F.when(F.col("is_exception"), F.when(private, PRIVATE_EXCEPT).otherwise(ICANN_EXCEPT))
            .when(F.col("is_wildcard"), F.when(private, PRIVATE_WILD).otherwise(ICANN_WILD))
            .otherwise(F.when(private, PRIVATE).otherwise(ICANN)))
    entries = rules.select(F.col("suffix").alias("base"), bits.alias("mask"))
    if hosting is not None:
        entries = entries.unionByName(
            hosting.select(F.col("suffix").alias("base"), F.lit(HOSTING).alias("mask")))
    return tail_index(entries, depth)


def _suffix_labels(depth: int, plain: int, wild: int, exception: int) -> str:
    """Number of labels in the longest matching suffix, 0 for none."""
    ks = range(1, depth + 1)
    exceptions = [f"if(_m{k} & {exception} <> 0, {k - 1}, null)" for k in ks]
    matches = [f"if(_m{k} & {plain} <> 0, {k}, 0), if(_m{k} & {wild} <> 0 AND _n > {k}, {k + 1}, 0)"
               for k in ks]
    return f"coalesce({', '.join([*exceptions, 'greatest(' + ', '.join(['0', '0', *matches]) + ')'])})"


def _host_label(suffix: str) -> str:
    # No suffix: the last label, or the whole of a dotted address. The name is itself a
    # suffix: the first label of its apex.
    return f"""CASE WHEN {suffix} = 0 AND domain RLIKE '{IPV4}' THEN domain
        WHEN {suffix} = 0 THEN substring_index(domain, '.', -1)
        WHEN {suffix} >= _n THEN substring_index(apex, '.', 1)
        ELSE substring_index(substring_index(domain, '.', -({suffix} + 1)), '.', 1) END"""


def with_name_keys(d: DataFrame, index: TailIndex) -> DataFrame:
    """Add apex, private_apex, host_label, icann_label and provider in one pass."""
    m = match_tails(d, index).selectExpr("*", f"{LABELS} AS _n")
    m = m.selectExpr(
        "*", f"{_suffix_labels(index.depth, ICANN, ICANN_WILD, ICANN_EXCEPT)} AS _si",
        _suffix_labels(index.depth, ICANN | PRIVATE, ICANN_WILD | PRIVATE_WILD,
                       ICANN_EXCEPT | PRIVATE_EXCEPT) + " AS _sp")
    # One label more than the suffix; two labels when there is no suffix or nothing left of it.
    m = m.selectExpr("*", """substring_index(domain, '.',
        -if(_si > 0 AND _si < _n, _si + 1, least(_n, 2))) AS apex""")
    providers = [f"if(_m{k} & {HOSTING} <> 0, substring_index(domain, '.', -{k}), null)"
                 for k in range(index.depth, 0, -1)]
    keep = [f"`{c}`" for c in d.columns]
    return m.selectExpr(
        *keep, "apex",
        "if(_sp > 0 AND _sp < _n, substring_index(domain, '.', -(_sp + 1)), apex) AS private_apex",
        f"{_host_label('_sp')} AS host_label", f"{_host_label('_si')} AS icann_label",
        f"coalesce({', '.join([*providers, 'cast(null AS string)'])}) AS provider")


def with_apex(d: DataFrame, index: TailIndex) -> DataFrame:
    """Registrable name under ICANN rules."""
    return with_name_keys(d, index).select(*d.columns, "apex")


def with_private_apex(d: DataFrame, index: TailIndex) -> DataFrame:
    """Registrable name under ICANN and private rules."""
    return with_name_keys(d, index).select(*d.columns, "private_apex")


def with_host_labels(d: DataFrame, index: TailIndex) -> DataFrame:
    """The label left of the suffix, by private and by ICANN rules."""
    return with_name_keys(d, index).select(*d.columns, "host_label", "icann_label")


def with_hosting_provider(d: DataFrame, index: TailIndex) -> DataFrame:
    """Longest hosting suffix that is the name or a label-aligned tail of it."""
    return with_name_keys(d, index).select(*d.columns, "provider")


def hosting_suffixes(snapshot: DataFrame, fallback: DataFrame,
                     extra: tuple[str, ...] = SEED_HOSTING) -> DataFrame:
    """The snapshot, or the fallback when it is empty, with the extra seed."""
    base = fallback if snapshot.isEmpty() else snapshot
    spark = snapshot.sparkSession
    seed = literal_table(spark, [(s.lower().lstrip("."),) for s in extra], "suffix string")
    return base.select("suffix").unionByName(seed).distinct()


def private_suffixes(rules: DataFrame) -> DataFrame:
    """Hosting suffixes of a rule table: private, wildcards cut to their base, no exceptions."""
    return (rules.filter((F.col("section") == "private") & ~F.col("is_exception"))
            .select("suffix").distinct())
