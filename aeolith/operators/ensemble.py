"""Statistics over models, changes, and events that several runs share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.config import DEFAULT


def least_models(n: int, share: float = DEFAULT.least_share) -> int:
    return math.ceil(share * n)


def statistics(df: DataFrame, by: Sequence[str], x: str, least: int) -> DataFrame:
    """(by, model_count, mean, median, std, p10, p90); NULL with fewer than ``least`` models."""
    n = F.count(x)
    some = lambda c: F.when(n >= least, c)
    return df.groupBy(*by).agg(
        n.alias("model_count"), some(F.avg(x)).alias("mean"), some(F.percentile(x, 0.5)).alias("median"), some(F.stddev_pop(x)).alias("std"),
        some(F.percentile(x, 0.1)).alias("p10"), some(F.percentile(x, 0.9)).alias("p90"),
    )


def sign_agreement(df: DataFrame, by: Sequence[str], x: str, least: int) -> DataFrame:
    """(by, model_count, agreement): per cent of models with the sign of the mean; NULL if that is 0."""
    d = df.where(F.col(x).isNotNull()).withColumn("__mean", F.avg(x).over(Window.partitionBy(*by)))
    g = d.groupBy(*by).agg(F.count("*").alias("model_count"), F.max("__mean").alias("__mean"), F.avg((F.signum(x) == F.signum("__mean")).cast("double")).alias("__a"))
    return g.select(*by, "model_count", F.when((F.col("model_count") >= least) & (F.col("__mean") != 0), 100 * F.col("__a")).alias("agreement"))


def summary(x: str) -> list[Column]:
    """Without a least number of models."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.percentile(x, 0.5).alias("median"), F.stddev_pop(x).alias("std"), F.percentile(x, 0.1).alias("p10"), F.percentile(x, 0.9).alias("p90"), F.min(x).alias("min"), F.max(x).alias("max")]


def difference(df: DataFrame, by: Sequence[str], side: str, minuend: str, subtrahend: str, x: str) -> DataFrame:
    """(by, a, b, difference) of the groups that both sides have."""
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col(x)))
    g = df.groupBy(*by).agg(pick(minuend).alias("a"), pick(subtrahend).alias("b"))
    return g.where("a is not null and b is not null").withColumn("difference", F.col("a") - F.col("b"))


def z_scores(df: DataFrame, base: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``df`` with z: distance from the base period's mean in its sample deviations; NULL if that is 0."""
    m = base.groupBy(*by).agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
    return df.join(m, list(by)).withColumn("z", F.when(F.col("__std") > 0, (F.col(x) - F.col("__mean")) / F.when(F.col("__std") > 0, F.col("__std")))).drop("__mean", "__std")


# Families of variables.
FAMILIES = {"temperature": ("tas_c", "tcell"), "solar_pv": ("rsds", "pvpot", "performance_ratio"), "wind": ("wind", "wind_hub", "sfcWind_10m", "wind_speed_hub", "wpd")}


def warning_family(variable: Column) -> Column:
    """A variable of no family is its own."""
    out = variable
    for name, members in FAMILIES.items():
        out = F.when(variable.isin(*members), name).otherwise(out)
    return out


def roll_up(events: DataFrame, model: str = "model", ym: str = "ym", variable: str = "variable", family: str = "family", run: str = "source", z: str = "z") -> DataFrame:
    """Events by (model, month, variable) and by (model, month, family), in one pass with grouping sets."""
    names = [model, ym, variable, family, run, z]
    d = events.select(*[F.col(a).alias(b) for a, b in zip(names, ("model", "ym", "variable", "family", "run", "z"))])
    # the variable is aggregated as well as grouped by, so it goes in twice
    g = d.withColumn("v", F.col("variable")).groupingSets([[F.col("model"), F.col("ym"), F.col("variable")], [F.col("model"), F.col("ym"), F.col("family")]], "model", "ym", "variable", "family")
    return g.agg(F.count("*").alias("raw_rows"), F.array_join(F.array_sort(F.collect_set("v")), ";").alias("variables"), F.array_join(F.array_sort(F.collect_set("run")), ";").alias("runs"), F.max(F.abs("z")).alias("max_abs_z"))
