"""The data behind figures; drawing is left to others."""

from pyspark.sql import functions as F

from aeolith.operators import complementarity as comp
from aeolith.operators import stats
from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, long_form, monthly, out, r
from aeolith.plans.complementary import _CLASS_B, _RHO, _SETS, four_sets, monthly_rho
from aeolith.plans.energy import SQL_CHAIN, SQL_ENERGY_LONG, energy_long
from aeolith.plans.ensembles import LEAST, SQL_CHANGE, _NAT, _NC, change_table, grid_change, period_grid
from aeolith.plans.ensembles import _G
from aeolith.plans.registry import query

_YS = "nm AS (SELECT model, source, variable, year, month, sum(value * weight) / sum(weight) AS v FROM el WHERE weight > 0 GROUP BY ALL), ys AS (SELECT model, source, variable, year, avg(v) AS v, count(*) AS n FROM nm GROUP BY ALL)"


def yearly(cube):
    m = energy_long(cube).where("weight > 0").groupBy("model", "source", "variable", "year", "month").agg(weighted_mean(F.col("value"), F.col("weight")).alias("v"))
    return m.groupBy("model", "source", "variable", "year").agg(F.avg("v").alias("v"), F.count("*").alias("n"))


@query(f"{A}, {SQL_ENERGY_LONG}, {_YS} SELECT source, variable, year, model, {r('v')} AS value, {r('min(v) OVER w')} AS low, {r('avg(v) OVER w')} AS mean, {r('max(v) OVER w')} AS high FROM ys WHERE source = 'gcm' WINDOW w AS (PARTITION BY source, variable, year)")
def figure_member_band(spark, sf_dir):
    """Members, and the band around them."""
    from pyspark.sql import Window

    w = Window.partitionBy("source", "variable", "year")
    y = yearly(monthly(spark, sf_dir)).where("source = 'gcm'")
    y = y.select("source", "variable", "year", "model", F.col("v").alias("value"), F.min("v").over(w).alias("low"), F.avg("v").over(w).alias("mean"), F.max("v").over(w).alias("high"))
    return out(y, ["source", "variable", "year", "model"], ["value", "low", "mean", "high"])


@query(f"{A}, {SQL_ENERGY_LONG}, {_YS} SELECT source, variable, year, {r('avg(v)')} AS mean, {r('quantile_cont(v, 0.1)')} AS p10, {r('quantile_cont(v, 0.9)')} AS p90, count(*) AS n FROM ys GROUP BY ALL")
def figure_ensemble_lines(spark, sf_dir):
    """Both methods' means with their 10 to 90 per cent bands."""
    by = ["source", "variable", "year"]
    g = yearly(monthly(spark, sf_dir)).groupBy(*by).agg(F.avg("v").alias("mean"), F.percentile("v", 0.1).alias("p10"), F.percentile("v", 0.9).alias("p90"), F.count("*").alias("n"))
    return out(g, by, ["mean", "p10", "p90"], ["n"])


@query(f"{A}, {SQL_ENERGY_LONG}, {_YS} SELECT source, variable, year, {r('avg(v)')} AS value, CASE WHEN year = 1995 THEN 'first' WHEN year = 2001 THEN 'last' ELSE '' END AS marker FROM ys GROUP BY ALL")
def figure_endpoint_series(spark, sf_dir):
    g = yearly(monthly(spark, sf_dir)).groupBy("source", "variable", "year").agg(F.avg("v").alias("value"))
    return out(g.withColumn("marker", F.when(F.col("year") == 1995, "first").when(F.col("year") == 2001, "last").otherwise("")), ["source", "variable", "year", "marker"], ["value"])


@query(f"{A}, {SQL_ENERGY_LONG}, {_G}, m AS (SELECT source, period, variable, lat, lon, CASE WHEN count(value) >= {LEAST} THEN avg(value) END AS v FROM g GROUP BY ALL) SELECT source, period, variable, lat, lon, {r('v')} AS value, CASE WHEN variable = 'wpd' AND v > 0 THEN {r('log10(CASE WHEN v > 0 THEN v END)')} ELSE {r('v')} END AS shown FROM m")
def figure_period_panels(spark, sf_dir):
    """Maps of periods; wind power on a logarithmic scale."""
    by = ["source", "period", "variable", "lat", "lon"]
    m = period_grid(monthly(spark, sf_dir)).groupBy(*by).agg(F.when(F.count("value") >= LEAST, F.avg("value")).alias("value"))
    v = F.col("value")
    return out(m.withColumn("shown", F.when((F.col("variable") == "wpd") & (v > 0), F.log10(F.when(v > 0, v))).otherwise(v)), by, ["value", "shown"])


@query(f"{A}, {SQL_CHANGE} SELECT source, variable, lat, lon, CASE WHEN count(change) >= {LEAST} THEN {r('avg(change)')} END AS change, CASE WHEN count(percent) >= {LEAST} THEN {r('avg(percent)')} END AS percent FROM ch GROUP BY ALL")
def figure_gridwise_change(spark, sf_dir):
    by = ["source", "variable", "lat", "lon"]
    some = lambda c: F.when(F.count(c) >= LEAST, F.avg(c)).alias(c)
    return out(grid_change(monthly(spark, sf_dir)).groupBy(*by).agg(some("change"), some("percent")), by, ["change", "percent"])


@query(f"{A}, {SQL_CHAIN}, {_SETS}, m AS (SELECT definition, source, cell, round(avg(rho), 9) AS rho FROM rr GROUP BY ALL) SELECT definition, source, cell, {r('rho')} AS rho, ({_CLASS_B})::INT AS class FROM m WHERE definition IN ('monthly_full', 'seasonal_full')")
def figure_class_maps(spark, sf_dir):
    """Maps of months and of seasons."""
    m = four_sets(monthly(spark, sf_dir)).where("definition in ('monthly_full', 'seasonal_full')").groupBy("definition", "source", "cell").agg(F.round(F.avg("rho"), 9).alias("rho"))
    return out(m.withColumn("class", comp.class_for_maps(F.col("rho"))), ["definition", "source", "cell", "class"], ["rho"])


@query(f"{A}, {SQL_CHAIN}, {_RHO}, m AS (SELECT source, cell, avg(rho) AS rho FROM rho GROUP BY ALL) SELECT o.cell, {r('o.rho - p.rho')} AS difference FROM m o JOIN m p ON o.cell = p.cell AND o.source = 'ref' AND p.source = 'gcm'")
def figure_rho_difference(spark, sf_dir):
    m = monthly_rho(monthly(spark, sf_dir)).groupBy("cell").pivot("source", ["ref", "gcm"]).agg(F.avg("rho"))
    return out(m.where("ref is not null and gcm is not null").withColumn("difference", F.col("ref") - F.col("gcm")), ["cell"], ["difference"])


@query(f"{A}, {SQL_ENERGY_LONG}, {_G}, m AS (SELECT source, period, variable, lat, lon, avg(value) AS v FROM g GROUP BY ALL) SELECT o.period, o.variable, o.lat, o.lon, CASE WHEN abs(p.v) > 1e-12 THEN {r('100 * (o.v - p.v) / p.v')} END AS percent FROM m o JOIN m p ON o.period = p.period AND o.variable = p.variable AND o.lat = p.lat AND o.lon = p.lon AND o.source = 'ref' AND p.source = 'gcm'")
def figure_method_difference_maps(spark, sf_dir):
    by = ["period", "variable", "lat", "lon"]
    m = period_grid(monthly(spark, sf_dir)).groupBy(*by).pivot("source", ["ref", "gcm"]).agg(F.avg("value")).where("ref is not null and gcm is not null")
    use = F.abs("gcm") > 1e-12
    return out(m.withColumn("percent", F.when(use, 100 * (F.col("ref") - F.col("gcm")) / F.when(use, F.col("gcm")))), by, ["percent"])


@query(f"{A}, {SQL_CHANGE}, {_NAT}, {_NC} SELECT variable, source, {r('percent')} AS percent, row_number() OVER (PARTITION BY variable ORDER BY percent DESC, source) AS place FROM nc")
def figure_change_bars(spark, sf_dir):
    from pyspark.sql import Window

    d = change_table(monthly(spark, sf_dir)).withColumn("place", F.row_number().over(Window.partitionBy("variable").orderBy(F.col("percent").desc(), "source")))
    return out(d, ["variable", "source"], ["percent"], ["place"])


@query(f"{A}, {SQL_ENERGY_LONG}, {_YS}, c AS (SELECT source, variable, count(DISTINCT year) AS years, count(DISTINCT model) AS models, min(n) AS least_months FROM ys GROUP BY ALL) SELECT *, years >= 7 AND models >= 3 AS complete FROM c")
def figure_completeness(spark, sf_dir):
    g = yearly(monthly(spark, sf_dir)).groupBy("source", "variable").agg(F.countDistinct("year").alias("years"), F.countDistinct("model").alias("models"), F.min("n").alias("least_months"))
    return g.withColumn("complete", (F.col("years") >= 7) & (F.col("models") >= 3))


@query(f"{A}, p AS (SELECT model, source, variable, month, avg(value) AS v FROM al GROUP BY ALL) SELECT model, source, variable, {', '.join(f'{r(f'max(CASE WHEN month = {m} THEN v END)')} AS m{m:02d}' for m in range(1, 13))} FROM p GROUP BY ALL")
def figure_heatmap(spark, sf_dir):
    """Models by months, pivoted."""
    p = long_form(monthly(spark, sf_dir)).groupBy("model", "source", "variable").pivot("month", list(range(1, 13))).agg(F.avg("value"))
    p = p.select("model", "source", "variable", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])
    return out(p, ["model", "source", "variable"], [f"m{m:02d}" for m in range(1, 13)])


@query(f"{A}, q AS (SELECT source, variable, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi, quantile_cont(abs(value), 0.99) AS sym FROM al GROUP BY ALL) SELECT source, variable, {r('lo - 0.04 * (hi - lo)')} AS low, {r('hi + 0.04 * (hi - lo)')} AS high, {r('sym')} AS symmetric FROM q")
def figure_axis_limits(spark, sf_dir):
    by, d = ["source", "variable"], long_form(monthly(spark, sf_dir))
    # values and sizes as two kinds of one pass
    both = F.array(F.struct(F.lit("value").alias("kind"), F.col("value").alias("x")), F.struct(F.lit("size").alias("kind"), F.abs("value").alias("x")))
    q = stats.pooled_quantiles(d.select(*by, F.explode(both).alias("e")).select(*by, "e.*"), [*by, "kind"], "x", {"lo": 0.01, "hi": 0.99})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    q = q.groupBy(*by).agg(of("value", "lo").alias("lo"), of("value", "hi").alias("hi"), of("size", "hi").alias("symmetric"))
    pad = 0.04 * (F.col("hi") - F.col("lo"))
    return out(q.withColumn("low", F.col("lo") - pad).withColumn("high", F.col("hi") + pad), ["source", "variable"], ["low", "high", "symmetric"])
