"""Empirical distribution functions and ranks, by windows instead of comparisons of all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cross_cdf(sample: DataFrame, target: DataFrame, by: Sequence[str], x: str, keep: Sequence[str]) -> DataFrame:
    """``by``, ``keep``, x and p of each target: (number of sample values below + half of the equal ones) / number.

    Both sides are tagged and put in one order; the sums over the tag count the sample.
    """
    s = sample.select(*by, F.col(x).alias("__x"), F.lit(1).alias("__s"), *[F.lit(None).cast(target.schema[k].dataType).alias(k) for k in keep])
    t = target.select(*by, F.col(x).alias("__x"), F.lit(0).alias("__s"), *keep)
    both = s.unionByName(t).where(F.col("__x").isNotNull())
    part = Window.partitionBy(*by)
    below = part.orderBy("__x").rangeBetween(Window.unboundedPreceding, 0)
    le, eq, n = F.sum("__s").over(below), F.sum("__s").over(Window.partitionBy(*by, "__x")), F.sum("__s").over(part)
    out = both.withColumn("__p", F.when(n > 0, (le - 0.5 * eq) / F.when(n > 0, n)))
    return out.where("__s = 0").select(*by, *keep, F.col("__x").alias(x), F.col("__p").alias("p"))


def self_cdf(by: Sequence[str], x: str) -> Column:
    """(rank - 1 + half of the peers) / number, of x in its own group; NULL for NULL.

    All its parts, and those of ``average_rank``, come from one order of the group, so a task holds one sort.
    """
    w = Window.partitionBy(*by).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, nulls, le = F.count(x).over(whole), F.count(F.when(F.col(x).isNull(), 1)).over(whole), F.count(x).over(w)
    return F.when(F.col(x).isNotNull(), (F.rank().over(w) - 1 - nulls + le) * 0.5 / F.when(n > 0, n))


def average_rank(by: Sequence[str], x: str) -> Column:
    """Rank in which ties share their mean: halfway between the first place and the last."""
    w = Window.partitionBy(*by).orderBy(x)
    return (F.rank().over(w) + F.count("*").over(w)) / 2


def tied_ranks(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``df`` with rank (``average_rank``) and p (``self_cdf``) where most values are tied.

    A group's distinct values are counted first, combined before the shuffle, and ordered; rows meet
    their value's rank in a hash join, so rows aren't sorted, and no group's rows gather in one task.
    """
    keys = [*by, x]
    w = Window.partitionBy(*by).orderBy(x)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, real = F.col("__n"), F.when(F.col(x).isNotNull(), F.col("__n")).otherwise(0)
    last, le, n = F.sum(own).over(w), F.sum(real).over(w), F.sum(real).over(whole)
    # NULL comes first: values up to this one, without the NULLs, less half of its own
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).select(
        *[F.col(k).alias(f"__{k}") for k in keys], (last - (own - 1) / 2).alias("rank"), F.when(F.col(x).isNotNull(), (le - own * 0.5) / F.when(n > 0, n)).alias("p")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(counts.hint("shuffle_hash"), same).drop(*[f"__{k}" for k in keys])


def clamped_window(target: DataFrame, by: Sequence[str], order: str, width: int) -> DataFrame:
    """``target`` with i (place in its group, from 0), n, and start: the window of ``width`` places
    around i, pushed inside the group at both ends."""
    w = Window.partitionBy(*by).orderBy(order)
    d = target.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    return d.withColumn("start", F.least(F.greatest(F.col("i") - width // 2, F.lit(0)), F.col("n") - width))


def moving_cdf(target: DataFrame, by: Sequence[str], order: str, x: str, width: int) -> DataFrame:
    """``target`` with i, n, and p in its clamped window; NULL unless all ``width`` values are there.

    One order of each group: a row sees the rows around it in a frame, of which its window is a slice.
    """
    d = clamped_window(target, by, order, width)
    around = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - width, width - 1)
    own = F.col(x)
    d = d.withColumn("__frame", F.collect_list(F.struct(own.alias("v"))).over(around)).withColumn("__first", F.greatest(F.col("i") - (width - 1), F.lit(0)))
    inside = F.slice("__frame", F.greatest(F.col("start") - F.col("__first"), F.lit(0)).cast("int") + 1, F.lit(width))
    one = lambda a, e: a + F.when(e["v"] < own, 1.0).when(e["v"] == own, 0.5).otherwise(0.0)
    d = d.withColumn("__frame", F.when(F.col("n") >= width, inside))
    whole = own.isNotNull() & (F.size(F.filter("__frame", lambda e: e["v"].isNotNull())) == width)
    return d.withColumn("p", F.when(whole, F.aggregate("__frame", F.lit(0.0), one) / width)).drop("__frame", "__first", "start")
