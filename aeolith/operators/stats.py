"""Means, quantiles and moments with and without weights.

Aggregates that partial sums can express are Columns for ``agg``; those that need an order
are functions of DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators.selection import narrowed


def weight_of(x: Column, w: Column) -> Column:
    return F.sum(F.when(x.isNotNull(), w))


def weighted_mean(x: Column, w: Column) -> Column:
    """sum(x w) / sum(w) over rows with x; NULL if these weigh nothing."""
    total = weight_of(x, w)
    return F.when(total > 0, F.sum(x * w) / F.when(total > 0, total))


def weighted_share(event: Column, x: Column, w: Column) -> Column:
    """Per cent of the weight of rows with x in which the event holds."""
    total = weight_of(x, w)
    return F.when(total > 0, 100 * F.sum(F.when(x.isNotNull() & event, w).otherwise(0.0)) / F.when(total > 0, total))


def weighted_moments(df: DataFrame, by: Sequence[str], x: str, w: str) -> DataFrame:
    """(by, n, mean, std): population moments in two passes; std is NULL with fewer than two rows."""
    d = df.where(F.col(x).isNotNull() & (F.col(w) > 0))
    mean = d.groupBy(*by).agg(F.count("*").alias("n"), weighted_mean(F.col(x), F.col(w)).alias("mean"))
    spread = d.join(mean, list(by)).groupBy(*by, "n", "mean").agg(F.sqrt(weighted_mean((F.col(x) - F.col("mean")) ** 2, F.col(w))).alias("s"))
    return spread.select(*by, "n", "mean", F.when(F.col("n") >= 2, F.col("s")).alias("std"))


def weighted_quantiles(df: DataFrame, by: Sequence[str], x: str, w: str, points: dict[str, float], pooled: bool = False) -> DataFrame:
    """The smallest value at which the weight summed in order reaches p of the total; no interpolation.

    Equal values are added up first.  Each group is ordered in one task, which suits groups of cells, unless
    it is ``pooled`` from whole cubes: then only narrow bins in which a point lies are ordered.
    """
    d = df.where(F.col(x).isNotNull() & (F.col(w) > 0)).groupBy(*by, x).agg(F.sum(w).alias("__w"))
    if pooled:
        # sums are made in different orders: a little more is looked at than is needed
        slack = lambda t, p, side: (p + side * 1e-9) * t
        d = narrowed(d, by, x, "__w", lambda t: [(slack(t, p, -1), slack(t, p, 1)) for p in points.values()])
        order = Window.partitionBy(*by, "__bin").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("__sum", F.col("__before") + F.sum("__w").over(order))
    else:
        order = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("__sum", F.sum("__w").over(order)).withColumn("__all", F.sum("__w").over(Window.partitionBy(*by)))
    return d.groupBy(*by).agg(*[F.min(F.when(F.col("__sum") >= p * F.col("__all"), F.col(x))).alias(name) for name, p in points.items()])


def pooled_quantiles(df: DataFrame, by: Sequence[str], x: str, points: dict[str, float]) -> DataFrame:
    """(by, points): exact quantiles with linear interpolation of groups that pool whole cubes: values are
    counted, and only narrow bins that hold a wanted rank are ordered."""
    d = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__w"))
    d = narrowed(d, by, x, "__w", lambda t: [(f(p * (t - 1)), f(p * (t - 1)) + 1) for p in points.values() for f in (F.floor, F.ceil)])
    last = F.col("__all") - 1
    order = Window.partitionBy(*by, "__bin").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__upto", F.col("__before") + F.sum("__w").over(order))
    at = lambda k: F.max(F.when((F.col("__upto") - F.col("__w") <= k) & (k < F.col("__upto")), F.col(x)))
    out = []
    for name, p in points.items():
        low, high = at(F.floor(p * last)), at(F.ceil(p * last))
        part = F.max(p * last - F.floor(p * last))
        out.append((low + (high - low) * part).alias(name))
    return d.groupBy(*by).agg(*out)


#: What ``area_statistics`` gives besides n.
AREA_STATISTICS = ("missing_percent", "negative_percent", "min", "p01", "median", "mean", "std", "p99", "max")


def area_statistics(df: DataFrame, by: Sequence[str], x: str, w: str, pooled: bool = False) -> DataFrame:
    """(by, n, and AREA_STATISTICS) of values pooled over months and cells, weighted by area; rows
    without x count as missing, those without weight not at all.

    A group is ordered in one task, and all statistics come from that one shuffle, unless it is
    ``pooled`` from whole cubes: then they are made from partial sums.
    """
    v, ww = F.col(x), F.col(w)
    missing = (100 * F.sum(F.when(v.isNull(), ww).otherwise(0.0)) / F.sum(ww)).alias("missing_percent")
    rest = [weighted_share(v < 0, v, ww).alias("negative_percent"), F.min(v).alias("min"), F.max(v).alias("max")]
    points = {"p01": 0.01, "median": 0.5, "p99": 0.99}
    if pooled:
        own = df.where(ww > 0).groupBy(*by).agg(missing, *rest)
        q = weighted_quantiles(df, by, x, w, points, pooled=True)
        return own.join(weighted_moments(df, by, x, w), list(by)).join(q, list(by)).select(*by, "n", *AREA_STATISTICS)
    part = Window.partitionBy(*by)
    upto = F.sum(F.when(v.isNotNull(), ww).otherwise(0.0)).over(part.orderBy(v.asc_nulls_first()).rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum(F.when(v.isNotNull(), ww)).over(part)
    d = df.where(ww > 0).select(*by, x, w).withColumn("__upto", upto).withColumn("__all", total).withColumn("__mean", F.sum(v * ww).over(part) / F.when(total > 0, total))
    n = F.count(v)
    std = F.when(n >= 2, F.sqrt(weighted_mean((v - F.col("__mean")) ** 2, ww)))
    at = [F.min(F.when(F.col("__upto") >= p * F.col("__all"), v)).alias(k) for k, p in points.items()]
    g = d.groupBy(*by).agg(n.alias("n"), missing, *rest, *at, F.max("__mean").alias("mean"), std.alias("std"))
    return g.where("n > 0").select(*by, "n", *AREA_STATISTICS)


def weighted_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, w: str, least: int = 3) -> DataFrame:
    """(by, n, r): centred in a second pass; NULL with fewer than ``least`` rows or no variance."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))
    means = d.groupBy(*by).agg(F.count("*").alias("n"), weighted_mean(F.col(x), F.col(w)).alias("mx"), weighted_mean(F.col(y), F.col(w)).alias("my"))
    dx, dy, ww = F.col(x) - F.col("mx"), F.col(y) - F.col("my"), F.col(w)
    sums = d.join(means, list(by)).groupBy(*by, "n").agg(F.sum(ww * dx * dy).alias("xy"), F.sum(ww * dx * dx).alias("xx"), F.sum(ww * dy * dy).alias("yy"))
    fit = (F.col("n") >= least) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return sums.select(*by, "n", F.when(fit, F.col("xy") / F.sqrt(F.when(fit, F.col("xx") * F.col("yy")))).alias("r"))


def linear_quantiles(x: str, points: Sequence[float]) -> Column:
    """An array of quantiles with linear interpolation, exact."""
    return F.percentile(x, [float(p) for p in points])


def plain_statistics(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Missing and negative per cent, extremes, quantiles, mean and population deviation, of groups of any size."""
    c = F.col(x)
    g = df.groupBy(*by).agg(
        F.count(c).alias("n"), (100 * F.avg(c.isNull().cast("double"))).alias("missing_percent"), (100 * F.avg(F.when(c.isNotNull(), (c < 0).cast("double")))).alias("negative_percent"),
        F.min(c).alias("min"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.max(c).alias("max"),
    )
    return g.join(pooled_quantiles(df, by, x, {"p01": 0.01, "median": 0.5, "p99": 0.99}), list(by), "left")


def skewness(x: str) -> Column:
    """Mean cube of values standardised with the sample deviation."""
    n = F.count(x)
    return F.when(n > 1, F.skewness(x) * F.pow((n - 1) / F.when(n > 0, n), F.lit(1.5)))


def place_of_max(df: DataFrame, by: Sequence[str], x: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(by, max, lat, lon) of the greatest value; of equal ones the first by latitude, then longitude."""
    key = F.struct(F.col(x), -F.col(lat), -F.col(lon))
    return df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.max(x).alias("max"), F.max_by(lat, key).alias("lat"), F.max_by(lon, key).alias("lon"))


def without_greatest(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Rows with x but one of the greatest in each group."""
    order = Window.partitionBy(*by).orderBy(F.col(x).desc())
    return df.where(F.col(x).isNotNull()).withColumn("__place", F.row_number().over(order)).where("__place > 1").drop("__place")
