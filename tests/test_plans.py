"""What plans must not have, at any size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from aeolith.operators import cdf, contracts, trends
from aeolith.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def series(spark):
    return spark.range(300).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("t"), F.sin("id").alias("x"))


def test_moving_windows_and_trends_join_nothing(series):
    for d in (cdf.moving_cdf(series, ["k"], "t", "x", 30), trends.mann_kendall(series, ["k"], "t", "x"), trends.theil_sen(series, ["k"], "t", "x")):
        text = plan(d)
        assert "Join" not in text and "Generate" not in text and text.count("hashpartitioning") == 1


def test_ranks_hold_one_order(spark, sf):
    """Windows of ranks share one sort; ranks of tied values sort no rows, only distinct values."""
    d = spark.createDataFrame([("a", 1, 2.0)], "k string, i int, x double")
    both = d.withColumn("rank", cdf.average_rank(["k"], "x")).withColumn("p", cdf.self_cdf(["k"], "x"))
    assert len(re.findall(r"\bSort \[", plan(both))) == 1
    p = plan(registry.QUERIES["ranks_with_ties"](spark, sf))
    assert "ShuffledHashJoin" in p and len(re.findall(r"\bSort \[", p)) == 1
    # what is sorted has been counted
    assert "HashAggregate" in p[p.index("Sort [") :]


def test_a_moving_correction_makes_no_rows_of_windows(spark, sf):
    assert "Generate explode(sequence" not in plan(registry.QUERIES["qdm_thirty_months"](spark, sf))


def test_audits_join_nothing(series):
    d = series.select("k", F.lit("tas").alias("variable"), F.col("t").cast("int").alias("ym"), F.col("t").alias("place"), (F.col("x") + 280).alias("value"), F.lit("K").alias("unit"), F.lit(1.0).alias("lat"))
    text = plan(contracts.group_audit(d, ["k", "variable"], "place", "value", "unit"))
    assert "Join" not in text and "Window" not in text
