"""Means over areas and periods."""

from pyspark.sql import functions as F

from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, SQL_PERIOD, long_form, monthly, out, period, r
from aeolith.plans.registry import query

VARS = ("tas", "rsds", "wind")
_WM = lambda v: f"CASE WHEN sum(CASE WHEN {v} IS NOT NULL THEN weight END) > 0 THEN sum({v} * weight) / sum(CASE WHEN {v} IS NOT NULL THEN weight END) END"


def national_months(cube, by=("model", "source", "year", "month")):
    return cube.groupBy(*by).agg(*[weighted_mean(F.col(v), F.col("weight")).alias(v) for v in VARS])


_NATIONAL = f", n AS (SELECT model, source, year, month, {', '.join(f'{_WM(v)} AS {v}' for v in VARS)} FROM a GROUP BY ALL)"


@query(f"{A}{_NATIONAL} SELECT model, source, year, month, {', '.join(f'{r(v)} AS {v}' for v in VARS)} FROM n")
def national_weighted_mean(spark, sf_dir):
    return out(national_months(monthly(spark, sf_dir)), ["model", "source", "year", "month"], VARS)


def annual(cube):
    """Weighted mean of each month, then the plain mean of the months of a year."""
    return national_months(cube).groupBy("model", "source", "year").agg(*[F.avg(v).alias(v) for v in VARS], F.count("*").alias("n_months"))


SQL_ANNUAL = f", y AS (SELECT model, source, year, {', '.join(f'avg({v}) AS {v}' for v in VARS)}, count(*) AS n_months FROM n GROUP BY ALL)"


@query(f"{A}{_NATIONAL}{SQL_ANNUAL} SELECT model, source, year, {', '.join(f'{r(v)} AS {v}' for v in VARS)}, n_months FROM y")
def annual_series(spark, sf_dir):
    return out(annual(monthly(spark, sf_dir)), ["model", "source", "year"], VARS, ["n_months"])


@query(f"""{A}, p AS (SELECT model, source, {SQL_PERIOD} AS period, cell, weight, variable, avg(value) AS value, count(value) AS n FROM al GROUP BY ALL)
SELECT model, source, period, variable, {r(_WM('value'))} AS value, min(n) AS least_months, bool_and(n = 36) AS complete FROM p WHERE period IS NOT NULL GROUP BY ALL""")
def period_means(spark, sf_dir):
    """The time mean of each cell, then the weighted mean; with the contract on months."""
    d = long_form(monthly(spark, sf_dir)).withColumn("period", period(F.col("year"))).where("period is not null")
    p = d.groupBy("model", "source", "period", "cell", "weight", "variable").agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    g = p.groupBy("model", "source", "period", "variable").agg(weighted_mean(F.col("value"), F.col("weight")).alias("value"), F.min("n").alias("least_months"), F.bool_and(F.col("n") == 36).alias("complete"))
    return out(g, ["model", "source", "period", "variable", "complete"], ["value"], ["least_months"])


@query(f"""{A}, m AS (SELECT model, source, {SQL_PERIOD} AS period, ym, variable, {_WM('value')} AS value FROM al GROUP BY ALL)
SELECT model, source, period, variable, {r('avg(value)')} AS value, count(value) AS n_months FROM m WHERE period IS NOT NULL GROUP BY ALL""")
def native_period_mean(spark, sf_dir):
    """The other order: weighted mean of each month, then the mean over months."""
    d = long_form(monthly(spark, sf_dir)).withColumn("period", period(F.col("year"))).where("period is not null")
    m = d.groupBy("model", "source", "period", "ym", "variable").agg(weighted_mean(F.col("value"), F.col("weight")).alias("value"))
    return out(m.groupBy("model", "source", "period", "variable").agg(F.avg("value").alias("value"), F.count("value").alias("n_months")), ["model", "source", "period", "variable"], ["value"], ["n_months"])
