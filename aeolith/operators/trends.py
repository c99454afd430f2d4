"""Trend tests and slopes of yearly series.

A series is gathered into one row, and its pairs are formed inside that row: one shuffle of the points themselves,
whatever the number of series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _series(df: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    """(by, points): each series as an array of (t, x) in the order of t, without missing values."""
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(x).alias("x")))).alias("points"))


def _later(p: Column, i: Column) -> Column:
    """The points after the i-th that have a later time."""
    return F.filter(F.slice("points", i + 2, F.size("points")), lambda q: q["t"] > p["t"])


def mann_kendall(df: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    """(by, n, s, var_s, z): with the correction for ties, and for continuity."""
    n = F.size("points").cast("long")
    # of each point: later ones, how many more of them are above than below, and how many points equal it
    signs = lambda p, i: F.aggregate(_later(p, i), F.lit(0.0), lambda a, q: a + F.signum(q["x"] - p["x"]))
    equal = lambda p: F.size(F.filter("points", lambda q: q["x"] == p["x"])).cast("long")
    each = F.transform("points", lambda p, i: F.struct(F.size(_later(p, i)).cast("long").alias("pairs"), signs(p, i).alias("s"), equal(p).alias("k")))
    d = _series(df, by, t, x).select(*by, n.alias("n"), each.alias("each"))
    c = F.col("n")
    tied = F.aggregate("each", F.lit(0).cast("long"), lambda a, e: a + (e["k"] - 1) * (2 * e["k"] + 5))
    pairs = F.aggregate("each", F.lit(0).cast("long"), lambda a, e: a + e["pairs"])
    d = d.where(pairs > 0).select(*by, "n", F.aggregate("each", F.lit(0.0), lambda a, e: a + e["s"]).alias("s"), ((c * (c - 1) * (2 * c + 5) - tied) / 18).alias("var_s"))
    v = F.when(F.col("var_s") > 0, F.sqrt(F.when(F.col("var_s") > 0, F.col("var_s"))))
    return d.select(*by, "n", "s", "var_s", F.when(F.col("s") > 0, (F.col("s") - 1) / v).when(F.col("s") < 0, (F.col("s") + 1) / v).otherwise(0.0).alias("z"))


def least_squares(df: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(x, t).alias("slope"), F.regr_intercept(x, t).alias("intercept"))


def theil_sen(df: DataFrame, by: Sequence[str], t: str, x: str) -> DataFrame:
    """(by, slope): the median of the slopes of all pairs."""
    slopes = F.flatten(F.transform("points", lambda p, i: F.transform(_later(p, i), lambda q: (q["x"] - p["x"]) / (q["t"] - p["t"]))))
    d = _series(df, by, t, x).select(*by, F.sort_array(slopes).alias("slopes")).where(F.size("slopes") > 0)
    n = F.size("slopes")
    return d.select(*by, ((F.get("slopes", F.floor((n - 1) / 2).cast("int")) + F.get("slopes", F.floor(n / 2).cast("int"))) / 2).alias("slope"))


def endpoints(df: DataFrame, by: Sequence[str], t: str, x: str, first: int, last: int, late: int, span: int) -> DataFrame:
    """(by, first_value, last_value, late_mean, start_mean, end_mean, decline, smoothed_decline)."""
    c, v = F.col(t), F.col(x)
    at = lambda cond: F.avg(F.when(cond, v))
    g = df.groupBy(*by).agg(
        at(c == first).alias("first_value"), at(c == last).alias("last_value"), at(c >= late).alias("late_mean"),
        at(c.between(first, first + span - 1)).alias("start_mean"), at(c.between(last - span + 1, last)).alias("end_mean"),
    )
    return g.withColumn("decline", F.col("first_value") - F.col("last_value")).withColumn("smoothed_decline", F.col("start_mean") - F.col("end_mean"))
