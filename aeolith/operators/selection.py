"""Selection: which rows hold wanted ranks of groups of any size, without a task that orders a group.

A group's values lie in one bin at first.  A round splits every bin that holds a wanted rank and more values than a task
is to order at edges that a mergeable sketch of its values gives, adds up what each part holds, and goes on with
those parts that hold a wanted rank.  Parts have about as many values each, however skewed these are, so a round divides
bins by ``PARTS``.  Bins are a small table, written each round; the values are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.scratch import written
from aeolith.sources.cubes import reused

#: Distinct values that one task orders at most, and parts that a round splits a bin into.
ROWS, PARTS = 100_000, 64
#: Bins that are broadcast at most; they are joined otherwise.
BROADCAST_BINS = 100_000


def narrowed(d: DataFrame, by: Sequence[str], x: str, amount: str, wanted: Callable[[Column], list[tuple[Column, Column]]], rows: int | None = None) -> DataFrame:
    """Those of ``d`` (distinct x in each group, with an amount) that lie in bins with a wanted place, with __bin, __before (what lower
    values outside the bin amount to) and __all (what the group amounts to).

    ``wanted`` gives, from a group's whole amount, places as (from, to) of amounts summed in order; a bin holds one if it has
    some of it.  No bin has more than ``rows`` values.
    """
    rows = ROWS if rows is None else rows
    d = reused(d)
    v = F.col(x)
    bins = d.groupBy(*by).agg(F.sum(amount).alias("__all"), F.count("*").alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
    most, n = bins.agg(F.max("__n"), F.count("*")).first()
    if not most or most <= rows:
        whole = Window.partitionBy(*by)
        return d.select("*", F.sum(amount).over(whole).alias("__all"), F.lit(0).cast(d.schema[amount].dataType).alias("__before"), F.lit(0.0).alias("__bin"))
    state = ["__all", "__n", "__low", "__high", "__before"]
    bins = bins.withColumn("__before", F.lit(0).cast(bins.schema["__all"].dataType)).select(*by, *state)
    while most > rows:
        large = bins.where(F.col("__n") > rows)
        large = large.withColumnRenamed("__low", "__from")
        inside = lambda bins: _join(d, bins, by, n).where(v.between(F.col("__from"), F.col("__high")))
        edges = inside(large).groupBy(*by, "__from").agg(F.percentile_approx(v, [k / PARTS for k in range(1, PARTS)], 10_000).alias("__edges"))
        part = F.size(F.filter("__edges", lambda e: e < v))
        parts = inside(large.join(edges, [*by, "__from"])).groupBy(*by, "__from", part.alias("__part")).agg(F.first("__all").alias("__all"), F.first("__before").alias("__base"), F.sum(amount).alias("__sum"), F.count("*").alias("__n"), F.min(v).alias("__low"), F.max(v).alias("__high"))
        order = Window.partitionBy(*by, "__from").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("__before", F.col("__base") + F.coalesce(F.sum("__sum").over(order), F.lit(0)))
        held = F.lit(False)
        for low, high in wanted(F.col("__all")):
            held = held | ((F.col("__before") <= high) & (F.col("__before") + F.col("__sum") >= low))
        small = bins.where(F.col("__n") <= rows)
        bins = written(small.unionByName(parts.where(held).select(*by, *state)).coalesce(1), "bins")
        most, n = bins.agg(F.max("__n"), F.count("*")).first()
    found = _join(d, bins.drop("__n"), by, n).where(v.between(F.col("__low"), F.col("__high")))
    return found.withColumn("__bin", F.col("__low")).drop("__low", "__high")


def _join(d: DataFrame, bins: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows with the bins of their groups, of which there are a few."""
    return d.join(F.broadcast(bins) if n <= BROADCAST_BINS else bins, list(by))
