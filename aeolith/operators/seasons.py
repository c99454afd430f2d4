"""Seasonal and monthly climatologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeolith.functions.months import season, season_year


def seasonal_means(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(by, season_year, season, n_months, values): weighted by days; a month without a value adds
    nothing above the line but its days below it."""
    d = df.withColumn("season_year", season_year(F.col("year"), F.col("month"))).withColumn("season", season(F.col("month")))
    mean = lambda v: (F.sum(F.coalesce(F.col(v) * F.col("days"), F.lit(0.0))) / F.sum("days")).alias(v)
    return d.groupBy(*by, "season_year", "season").agg(F.count("*").alias("n_months"), *map(mean, values))


def whole_seasons(seasonal: DataFrame) -> DataFrame:
    return seasonal.where("n_months = 3")


def monthly_climatology(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "month").agg(*[F.avg(v).alias(v) for v in values])


def seasonal_climatology(seasonal: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return seasonal.groupBy(*by, "season").agg(*[F.avg(v).alias(v) for v in values])
