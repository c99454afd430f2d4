"""What the distributions of model and reference say about a correction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.config import DEFAULT, EngineConfig
from aeolith.functions.numeric import by_variable
from aeolith.operators.stats import skewness

POINTS = (0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99)
PARTS = ("near_zero_percent", "negative_percent", "mean", "std", "skew", *[f"q{int(100 * p):02d}" for p in POINTS])


def _floor(variable: Column, config: EngineConfig) -> Column:
    return by_variable(variable, config.floors)


def cell_distributions(df: DataFrame, by: Sequence[str], x: str, prefix: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """Share near zero and below it, moments and quantiles of each cell; ``by`` has the column ``variable``."""
    c = F.col(x)
    share = lambda cond: 100 * F.avg(F.when(c.isNotNull(), cond.cast("double")))
    q = F.percentile(x, list(POINTS))
    g = df.groupBy(*by).agg(
        share(F.abs(c) <= _floor(F.col("variable"), config)).alias("near_zero_percent"), share(c < 0).alias("negative_percent"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), skewness(x).alias("skew"), q.alias("q"),
    )
    parts = [F.col(p) if not p.startswith("q") else F.element_at("q", 1 + [f"q{int(100 * t):02d}" for t in POINTS].index(p)) for p in PARTS]
    return g.select(*by, *[p.alias(f"{prefix}_{n}") for n, p in zip(PARTS, parts)])


def complete_pairs(model: DataFrame, reference: DataFrame, by: Sequence[str], sample: str, x: str) -> DataFrame:
    """(by, sample, x, y, complete): the samples of both sides, and whether the group has both on all of them."""
    pairs = model.select(*by, sample, F.col(x).alias("x")).join(reference.select(*by, sample, F.col(x).alias("y")), [*by, sample], "full_outer")
    whole = F.min((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int")).over(Window.partitionBy(*by)) == 1
    return pairs.withColumn("complete", whole)


def month_scalars(pairs: DataFrame, cells: DataFrame, by: Sequence[str], cell: str = "cell", config: EngineConfig = DEFAULT) -> DataFrame:
    """What a month says as a whole, from ``complete_pairs`` and the complete cells' distributions and
    adjustments: cells, complete ones, pairs with both values, shares near zero and below it, means over
    all values, and per cent of cells whose ratios can't be formed."""
    floor = _floor(F.col("variable"), config)
    share = lambda side, cond: (100 * F.avg(F.when(F.col("complete") & side.isNotNull(), cond.cast("double"))))
    x, y, ok = F.col("x"), F.col("y"), F.col("complete")
    g = pairs.groupBy(*by).agg(
        F.countDistinct(cell).alias("grid_cells"), F.countDistinct(F.when(ok, F.col(cell))).alias("complete_cells"), (100 * F.avg((x.isNotNull() & y.isNotNull()).cast("double"))).alias("paired_percent"),
        share(x, F.abs(x) <= floor).alias("model_near_zero_percent"), share(y, F.abs(y) <= floor).alias("reference_near_zero_percent"), share(x, x < 0).alias("model_negative_percent"), share(y, y < 0).alias("reference_negative_percent"),
        F.avg(F.when(ok, x)).alias("model_mean"), F.avg(F.when(ok, y)).alias("reference_mean"),
    )
    g = g.withColumn("complete_percent", 100 * F.col("complete_cells") / F.col("grid_cells"))
    invalid = [invalid_percent(F.col("model_mean"), floor).alias("mean_ratio_invalid_percent"), invalid_percent(F.col("model_std"), F.lit(1e-12)).alias("std_ratio_invalid_percent")]
    invalid += [invalid_percent(F.col(f"model_q{int(100 * p):02d}"), floor).alias(f"q{int(100 * p):02d}_invalid_percent") for p in POINTS]
    return g.join(cells.groupBy(*by).agg(*invalid), list(by), "left")


def adjustments(both: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Additive and multiplicative adjustments at each quantile."""
    floor = _floor(F.col("variable"), config)
    for p in POINTS:
        q = f"q{int(100 * p):02d}"
        m, o = F.col(f"model_{q}"), F.col(f"reference_{q}")
        both = both.withColumn(f"add_{q}", o - m).withColumn(f"multiply_{q}", ratio_above(o, m, floor))
    both = both.withColumn("mean_bias", F.col("model_mean") - F.col("reference_mean"))
    return both.withColumn("multiply_mean", ratio_above(F.col("reference_mean"), F.col("model_mean"), floor)).withColumn("multiply_std", ratio_above(F.col("reference_std"), F.col("model_std"), F.lit(1e-12)))


def ratio_above(n: Column, d: Column, floor: Column) -> Column:
    """n / d where abs(d) is over a floor that rows can have of their own."""
    return F.when(F.abs(d) > floor, n / F.when(F.abs(d) > floor, d))


def measures() -> list[str]:
    qs = [f"q{int(100 * p):02d}" for p in POINTS]
    return [f"{side}_{p}" for side in ("model", "reference") for p in PARTS] + [f"{kind}_{q}" for kind in ("add", "multiply") for q in qs] + ["mean_bias", "multiply_mean", "multiply_std"]


def spatial_summary(cells: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, measure, n, min, p10, median, mean, p90, max) over cells: long instead of some 260 columns."""
    long = cells.unpivot(list(by), list(columns), "measure", "value")
    return long.groupBy(*by, "measure").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.5).alias("median"),
        F.avg("value").alias("mean"), F.percentile("value", 0.9).alias("p90"), F.max("value").alias("max"),
    )


# Limits in per cent, flags, bounds and suggestions.
TAIL_LIMIT, LOWER_LIMIT = 10.0, 1.0
FLAGS = ("HIGH", "MODERATE_OR_LOW")
BOUNDS = ("0.05-0.95", "0.02-0.98")
ACTIONS = {
    "tas": "Multiplicative factors are numerically stable in kelvin; compare multiplicative and additive diagnostics",
    "near_zero": "Use a positive floor and bounded or hybrid lower-tail treatment before multiplicative QM",
    "other": "Bounded multiplicative QM is numerically feasible; retain a physical lower bound of zero",
}


def recommend(df: DataFrame, by: Sequence[str], sensitivity: str, near_zero: str, invalid: str, bias: str) -> DataFrame:
    """Worst and median months of a tail sensitivity, and what they suggest; ``by`` has the column ``variable``."""
    g = df.groupBy(*by).agg(F.percentile(F.abs(F.col(bias)), 0.5).alias("median_absolute_bias"), F.percentile(sensitivity, 0.5).alias("median_sensitivity"), F.max(sensitivity).alias("worst_sensitivity"), F.max(near_zero).alias("worst_near_zero"), F.max(invalid).alias("worst_invalid"))
    high = F.coalesce(F.col("worst_sensitivity") > TAIL_LIMIT, F.lit(False))
    low = (F.col("worst_near_zero") > LOWER_LIMIT) | (F.col("worst_invalid") > LOWER_LIMIT)
    return (
        g.withColumn("flag", F.when(high, FLAGS[0]).otherwise(FLAGS[1])).withColumn("bounds", F.when(high, BOUNDS[0]).otherwise(BOUNDS[1]))
        .withColumn("action", F.when(F.col("variable") == "tas", ACTIONS["tas"]).when(low, ACTIONS["near_zero"]).otherwise(ACTIONS["other"]))
    )


def invalid_percent(model: Column, floor: Column) -> Column:
    """Per cent of cells whose ratio can't be formed."""
    return 100 * F.avg(F.when(model.isNotNull(), (F.abs(model) <= floor).cast("double")))
