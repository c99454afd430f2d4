"""Rank correlation of two series, and its classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.config import DEFAULT
from aeolith.operators.cdf import average_rank
from aeolith.operators.stats import weighted_mean


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, least: int | str) -> DataFrame:
    """(by, n, rho): over rows with both values; NULL with fewer than ``least`` (a number, or a column of
    ``by``), or if one is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("__rx", average_rank(by, x)).withColumn("__ry", average_rank(by, y))
    # not corr(), which divides by zero where a series is constant
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop("__rx", "__ry").alias("__c"), (F.stddev_pop("__rx") * F.stddev_pop("__ry")).alias("__s"))
    use = (F.col("n") >= (F.col(least) if isinstance(least, str) else least)) & (F.col("__s") > 0)
    return g.select(*by, "n", F.when(use, F.col("__c") / F.when(use, F.col("__s"))).alias("rho"))


def class_from_below(rho: Column, edges: Sequence[float] = DEFAULT.complementarity_edges) -> Column:
    """1 to 8; a value on an edge belongs to the class above it (0 to 5)."""
    out = F.when(rho < edges[0], 1)
    for k, e in enumerate(edges[1:], 2):
        out = out.when(rho < e, k)
    return F.when(rho.isNotNull(), out.otherwise(len(edges) + 1))


def class_for_maps(rho: Column, edges: Sequence[float] = DEFAULT.complementarity_edges) -> Column:
    """1 to 8; edges up to 0 belong to the class below (0 to 4), those above 0 to the class above; NULL outside [-1, 1]."""
    out = F.when(~rho.between(-1, 1), F.lit(None).cast("int"))
    for k, e in enumerate(edges, 1):
        out = out.when(rho <= e if e <= 0 else rho < e, k)
    return F.when(rho.isNotNull(), out.otherwise(len(edges) + 1))


def class_shares(df: DataFrame, by: Sequence[str], rho: str, w: str) -> DataFrame:
    """(by, n, missing, mean_rho, median_rho, share_1 .. share_8, cells_1 .. cells_8): cells with weight that
    have a value and that have none, weighted mean and median, and of each class the per cent of the
    weight of cells with a value, and their number."""
    d = df.where(F.col(w) > 0).withColumn("__c", class_from_below(F.col(rho)))
    v, part = F.col(rho), Window.partitionBy(*by)
    known = F.when(v.isNotNull(), F.col(w))
    d = d.withColumn("__upto", F.sum(known).over(part.orderBy(v.asc_nulls_last()).rangeBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum(known).over(part))
    total = F.sum(known)
    shares = [(100 * F.sum(F.when(F.col("__c") == k, F.col(w)).otherwise(0.0)) / total).alias(f"share_{k}") for k in range(1, 9)]
    cells = [F.count_if(F.col("__c") == k).alias(f"cells_{k}") for k in range(1, 9)]
    median = F.min(F.when(v.isNotNull() & (F.col("__upto") >= 0.5 * F.col("__all")), v)).alias("median_rho")
    return d.groupBy(*by).agg(F.count(rho).alias("n"), F.count_if(v.isNull()).alias("missing"), weighted_mean(v, F.col(w)).alias("mean_rho"), median, *shares, *cells)
