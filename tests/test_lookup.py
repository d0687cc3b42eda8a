"""Lookups against a large table: same rows, and a plan that does not grow from lookup to lookup."""

import pytest
from pyspark.sql import functions as F

import check
from domainsieve.operators import lookup

SF = "/root/testdata/sf0.001"


def test_plan_grows_by_a_constant(spark):
    d = spark.range(2000).select(F.concat(F.lit("n"), "id").alias("domain"),
                                 F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("apex"))
    table = spark.range(500).select(F.col("id").cast("string").alias("key"), F.col("id").alias("value")).unionByName(
        spark.sql("SELECT 'hot' AS key, -1L AS value"))
    sizes = []
    for i in range(5):
        d = lookup.lookup_join(d, table, "apex", "key", [F.col("value").alias(f"v{i}")], rows=0)
        sizes.append(str(d._jdf.queryExecution().optimizedPlan()).count("Relation"))
    assert sizes[4] <= sizes[0] + 4
    got = d.select("apex", *[f"v{i}" for i in range(5)]).distinct().collect()
    assert all(set(r[1:]) == {-1 if r[0] == "hot" else int(r[0]) if int(r[0]) < 500 else None} for r in got)
    assert d.count() == 2000


@pytest.mark.parametrize("name", ["Q6_blocked_apex", "Q7_popularity_allow", "Q9_enrich_age", "Q17_dispositions"])
def test_large_tables_give_the_same_rows(spark, monkeypatch, name):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    ok, text = check.compare(spark, check.connect(SF), SF, name)
    assert ok, text
