"""Text sources: resolver logs, threat feeds, ranked lists, suffix rules, allowlists.

Each reader is a file read plus a parser from a `value` column, so the same parser
serves batch, streams and tests.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from domainsieve.fixed import LOG_QUERY_PATTERN, LOG_SKIP_NAMES, Feed
from domainsieve.functions.names import (
    clean_name, explode_if, is_internal, is_ip, let, strip, url_host, url_path)
from domainsieve.params import DEFAULTS

# Python workers get this code with the job, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# -- resolver log -------------------------------------------------------------

def parse_query_log(lines: DataFrame) -> DataFrame:
    """(domain, time_text, client) of the query lines; internal names dropped."""
    value = F.col("value")
    name = explode_if(
        clean_name(F.regexp_extract(value, LOG_QUERY_PATTERN, 1)),
        lambda n: F.contains(n, F.lit(".")) & ~is_internal(n) & ~n.isin(*LOG_SKIP_NAMES))
    return lines.select(
        name.alias("domain"),
        F.regexp_extract(value, r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})", 1).alias("time_text"),
        F.regexp_extract(value, LOG_QUERY_PATTERN + r"\s+(\S+)", 2).alias("client"))


def read_query_log(spark: SparkSession, path: str, streaming: bool = False,
                   max_files_per_trigger: int = 1000) -> DataFrame:
    if streaming:
        return parse_query_log(spark.readStream.option(
            "maxFilesPerTrigger", max_files_per_trigger).text(path))
    return parse_query_log(spark.read.text(path))


# -- threat feeds -------------------------------------------------------------

def parse_feed_lines(lines: DataFrame, feed: Feed) -> DataFrame:
    """Distinct (feed, domain) of a feed's lines."""
    hosts_form = r"^(?:0\.0\.0\.0|127\.0\.0\.1)\s+(\S+)"

    def is_entry(line):
        return (line != "") & ~line.startswith(feed.comment_prefix) if feed.comment_prefix else line != ""

    def bare(line):
        return F.when(line.rlike(hosts_form), F.regexp_extract(line, hosts_form, 1)).otherwise(line)

    def host(entry):
        has_scheme = F.contains(entry, F.lit("://"))
        url = F.when(has_scheme, entry).otherwise(F.concat(F.lit("http://"), entry))
        found = let(url, lambda u: F.coalesce(url_host(u), url_path(u)))
        return F.when(has_scheme | entry.startswith("http"), found).otherwise(entry)

    def is_name(name):
        return (F.contains(name, F.lit(".")) & (F.length(name) >= 4) & ~is_ip(name)
                & ~is_internal(name))

    d = lines.select(explode_if(strip(F.col("value")), is_entry).alias("_line"))
    entry = let(bare(F.col("_line")), host) if feed.is_url_list else bare(F.col("_line"))
    return d.select(F.lit(feed.name).alias("feed"),
                    explode_if(clean_name(entry), is_name).alias("domain")).distinct()


def read_domain_feed(spark: SparkSession, feeds, path: str) -> DataFrame:
    """Distinct (feed, domain) of all landed feeds; the files of a feed lie in path/<feed name>."""
    from domainsieve.sources.json_files import read_json_feed
    out = None
    for feed in feeds:
        where = f"{path}/{feed.name}"
        if feed.is_json:
            one = read_json_feed(spark, where, feed.json_field).select(
                F.lit(feed.name).alias("feed"), "domain")
        else:
            one = parse_feed_lines(spark.read.text(where), feed)
        out = one if out is None else out.unionByName(one)
    return out


# -- ranked list --------------------------------------------------------------

def parse_ranked_list(lines: DataFrame, max_rank: int = DEFAULTS.popular_max_rank) -> DataFrame:
    """(domain, rank) of `rank,domain` lines given with an ordering column `line_no`."""
    line = strip(F.col("value"))
    rest = F.when(F.contains(line, F.lit(",")), F.expr("substring(value, instr(value, ',') + 1)")
                  ).otherwise(F.lit(""))
    d = lines.select(
        F.substring_index(line, ",", 1).try_cast("int").alias("rank"),
        F.rtrim(F.lower(strip(rest)), F.lit(".")).alias("domain"), "line_no")
    return (d.filter((F.col("rank") <= max_rank) & F.contains("domain", F.lit(".")))
            .groupBy("domain").agg(F.max_by("rank", "line_no").alias("rank")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no): line_no rises within a file, and with the file name."""
    return spark.read.text(path).select("value", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("line_no"))


def read_ranked_list(spark: SparkSession, path: str,
                     max_rank: int = DEFAULTS.popular_max_rank) -> DataFrame:
    return parse_ranked_list(numbered_lines(spark, path), max_rank)


# -- public suffix rules ------------------------------------------------------

def suffix_rule_rows(rule: str, section: str) -> tuple[str, str, bool, bool]:
    """A rule as (suffix, section, is_wildcard, is_exception)."""
    return rule.lstrip("*!.").lower(), section, rule.startswith("*."), rule.startswith("!")


@F.pandas_udf(StringType())
def _ascii_form(suffix):
    """Names are looked up in their ASCII form, so rules need it as well."""
    def convert(text):
        try:
            return text.encode("idna").decode("ascii")
        except UnicodeError:
            return text
    return suffix.map(convert)


def parse_suffix_rules(lines: DataFrame) -> DataFrame:
    """Rules of a suffix list given as lines with a `line_no`.

    The section of a line follows from its place relative to the marker lines.
    """
    line = strip(F.col("value"))
    marks = lines.groupBy().agg(
        F.min(F.when(F.contains(line, F.lit("===BEGIN PRIVATE DOMAINS===")), F.col("line_no"))).alias("p0"),
        F.min(F.when(F.contains(line, F.lit("===END PRIVATE DOMAINS===")), F.col("line_no"))).alias("p1"))
    first = marks.first()
    d = lines.filter((line != "") & ~line.startswith("//"))
    section = F.lit("icann")
    if first["p0"] is not None:
        begin, end = _literal(first["p0"]), _literal(first["p1"])
        section = F.when(F.col("line_no") < begin, "icann")
        section = section.otherwise("private") if end is None else (
            section.when(F.col("line_no") < end, "private"))
    rule = F.regexp_extract(line, r"^(\S+)", 1)
    d = d.select(F.lower(rule).alias("_rule"), section.alias("section")).filter("section IS NOT NULL")
    d = d.select(
        F.regexp_replace("_rule", r"^(?:\*\.|!)", "").alias("suffix"), "section",
        F.col("_rule").startswith("*.").alias("is_wildcard"),
        F.col("_rule").startswith("!").alias("is_exception"))
    plain = F.col("suffix").rlike(r"^[\x00-\x7F]*$")
    ascii_rows = d.filter(~plain).withColumn("suffix", _ascii_form("suffix"))
    return d.unionByName(ascii_rows).distinct()


def _literal(row):
    if row is None:
        return None
    if isinstance(row, int):
        return F.lit(row)
    return F.struct(*[F.lit(v).alias(k) for k, v in row.asDict().items()])


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, section, is_wildcard, is_exception) of a public suffix file."""
    return parse_suffix_rules(numbered_lines(spark, path))


# -- allowlist ----------------------------------------------------------------

def parse_allowlist(lines: DataFrame) -> DataFrame:
    """(entry, is_suffix): a leading dot makes a suffix entry."""
    entry = F.lower(strip(F.col("value")))
    return (lines.select(entry.alias("entry"))
            .filter((F.col("entry") != "") & ~F.col("entry").startswith("#"))
            .select("entry", F.col("entry").startswith(".").alias("is_suffix")).distinct())


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return parse_allowlist(spark.read.text(path))
