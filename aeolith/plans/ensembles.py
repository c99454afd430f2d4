"""Ensembles over models, changes, warnings."""

from pyspark.sql import functions as F

from aeolith.functions.numeric import percent_of
from aeolith.operators import ensemble
from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, SQL_PERIOD, monthly, out, period, r
from aeolith.plans.energy import SQL_ENERGY_LONG, energy_long
from aeolith.plans.registry import query

#: The three proxy models all have to be there: ceil(0.8 * 3).
LEAST = ensemble.least_models(3)
_G = f"g AS (SELECT model, source, cell, lat, lon, weight, variable, period, avg(value) AS value FROM (SELECT el.*, lat, lon, {SQL_PERIOD} AS period FROM el JOIN (SELECT DISTINCT cell, lat, lon FROM a) USING (cell)) WHERE period IS NOT NULL GROUP BY ALL)"
_CH = """ch AS (SELECT f.model, f.source, f.cell, f.lat, f.lon, f.weight, f.variable, f.value AS base, t.value AS future, t.value - f.value AS change, CASE WHEN abs(f.value) > 1e-12 THEN 100 * (t.value - f.value) / f.value END AS percent
FROM g f JOIN g t ON f.model = t.model AND f.source = t.source AND f.cell = t.cell AND f.variable = t.variable AND f.period = 'fit' AND t.period = 'target')"""
SQL_CHANGE = f"{SQL_ENERGY_LONG}, {_G}, {_CH}"


def period_grid(cube):
    d = energy_long(cube).withColumn("period", period(F.col("year"))).where("period is not null")
    return d.groupBy("model", "source", "cell", "lat", "lon", "weight", "variable", "period").agg(F.avg("value").alias("value"))


def grid_change(cube):
    """Change of each cell on the model's own grid, absolute and relative; both periods from one pass."""
    g = period_grid(cube).groupBy("model", "source", "cell", "lat", "lon", "weight", "variable").pivot("period", ["fit", "target"]).agg(F.max("value"))
    g = g.where("fit is not null and target is not null").withColumnRenamed("fit", "base").withColumnRenamed("target", "future")
    return g.withColumn("change", F.col("future") - F.col("base")).withColumn("percent", percent_of(F.col("change"), F.col("base")))


_STATS = f"count(%(x)s) AS model_count, {', '.join(f'CASE WHEN count(%(x)s) >= {LEAST} THEN {r(e)} END AS {n}' for n, e in (('mean', 'avg(%(x)s)'), ('median', 'quantile_cont(%(x)s, 0.5)'), ('std', 'stddev_pop(%(x)s)'), ('p10', 'quantile_cont(%(x)s, 0.1)'), ('p90', 'quantile_cont(%(x)s, 0.9)')))}"


@query(f"{A}, {SQL_ENERGY_LONG}, {_G} SELECT source, period, variable, cell, {_STATS % {'x': 'value'}} FROM g GROUP BY ALL")
def ensemble_stats(spark, sf_dir):
    by = ["source", "period", "variable", "cell"]
    return out(ensemble.statistics(period_grid(monthly(spark, sf_dir)), by, "value", LEAST), by, ["mean", "median", "std", "p10", "p90"], ["model_count"])


@query(f"""{A}, {SQL_CHANGE}, m AS (SELECT *, avg(change) OVER (PARTITION BY source, variable, cell) AS mean FROM ch)
SELECT source, variable, cell, count(*) AS model_count, CASE WHEN count(*) >= {LEAST} AND max(mean) <> 0 THEN {r('100 * avg(CASE WHEN sign(change) = sign(mean) THEN 1.0 ELSE 0.0 END)')} END AS agreement FROM m GROUP BY ALL""")
def sign_agreement(spark, sf_dir):
    by = ["source", "variable", "cell"]
    return out(ensemble.sign_agreement(grid_change(monthly(spark, sf_dir)), by, "change", LEAST), by, ["agreement"], ["model_count"])


_NAT = "n AS (SELECT model, source, period, variable, sum(value * weight) / sum(weight) AS value FROM g WHERE weight > 0 GROUP BY ALL)"


def national(cube):
    return period_grid(cube).where("weight > 0").groupBy("model", "source", "period", "variable").agg(weighted_mean(F.col("value"), F.col("weight")).alias("value"))


_SUM = ("mean", "avg({x})"), ("median", "quantile_cont({x}, 0.5)"), ("std", "stddev_pop({x})"), ("p10", "quantile_cont({x}, 0.1)"), ("p90", "quantile_cont({x}, 0.9)"), ("min", "min({x})"), ("max", "max({x})")


@query(f"{A}, {SQL_ENERGY_LONG}, {_G}, {_NAT} SELECT source, period, variable, count(value) AS n, {', '.join(f'{r(e.format(x='value'))} AS {k}' for k, e in _SUM)} FROM n GROUP BY ALL")
def scalar_ensemble(spark, sf_dir):
    by = ["source", "period", "variable"]
    return out(national(monthly(spark, sf_dir)).groupBy(*by).agg(*ensemble.summary("value")), by, [k for k, _ in _SUM], ["n"])


@query(f"""{A}, {SQL_ENERGY_LONG}, {_G}, {_NAT} SELECT p.model, p.period, p.variable, {r('o.value')} AS a, {r('p.value')} AS b, {r('o.value - p.value')} AS difference
FROM n p JOIN n o ON p.model = o.model AND p.period = o.period AND p.variable = o.variable AND p.source = 'gcm' AND o.source = 'ref'""")
def method_difference(spark, sf_dir):
    """Optimized minus paper, of the models that both have."""
    by = ["model", "period", "variable"]
    return out(ensemble.difference(national(monthly(spark, sf_dir)), by, "source", "ref", "gcm", "value"), by, ["a", "b", "difference"])


_NC = f"""en AS (SELECT source, variable, period, avg(value) AS v FROM n GROUP BY ALL),
d2 AS (SELECT h.source, h.variable, h.v AS base, f.v AS future FROM en h JOIN en f ON h.source = f.source AND h.variable = f.variable AND h.period = 'fit' AND f.period = 'target'),
em AS (SELECT source, variable, cell, weight, CASE WHEN count(percent) >= {LEAST} THEN avg(percent) END AS p FROM ch GROUP BY ALL),
d1 AS (SELECT source, variable, sum(p * weight) / sum(CASE WHEN p IS NOT NULL THEN weight END) AS gridwise FROM em WHERE weight > 0 GROUP BY ALL),
nc AS (SELECT d2.*, future - base AS change, 100 * (future - base) / base AS percent, gridwise FROM d2 JOIN d1 USING (source, variable))"""


def change_table(cube):
    """Definition 2 (change of ensemble means), and the mean of gridwise changes (definition 1) beside it."""
    en = national(cube).groupBy("source", "variable").pivot("period", ["fit", "target"]).agg(F.avg("value")).withColumnRenamed("fit", "base").withColumnRenamed("target", "future")
    cell = grid_change(cube).groupBy("source", "variable", "cell", "weight").agg(F.when(F.count("percent") >= LEAST, F.avg("percent")).alias("p"))
    one = cell.where("weight > 0").groupBy("source", "variable").agg(weighted_mean(F.col("p"), F.col("weight")).alias("gridwise"))
    return en.join(one, ["source", "variable"]).withColumn("change", F.col("future") - F.col("base")).withColumn("percent", percent_of(F.col("future") - F.col("base"), F.col("base")))


@query(f"{A}, {SQL_CHANGE}, {_NAT}, {_NC} SELECT source, variable, {', '.join(f'{r(c)} AS {c}' for c in ('base', 'future', 'change', 'percent', 'gridwise'))}, {r('gridwise - percent')} AS gap FROM nc")
def national_change(spark, sf_dir):
    d = change_table(monthly(spark, sf_dir)).withColumn("gap", F.col("gridwise") - F.col("percent"))
    return out(d, ["source", "variable"], ["base", "future", "change", "percent", "gridwise", "gap"])


@query(f"""{A}, {SQL_CHANGE}, {_NAT}, {_NC} SELECT b.variable, {r('d.future - b.future')} AS difference, {r('100 * (d.future - b.future) / b.future')} AS difference_percent, {r('d.percent - b.percent')} AS change_points
FROM nc b JOIN nc d ON b.variable = d.variable AND b.source = 'gcm' AND d.source = 'ref'""")
def d_minus_b(spark, sf_dir):
    """Both sides in one pass by conditional aggregates."""
    side = lambda s, c: F.max(F.when(F.col("source") == s, F.col(c)))
    g = change_table(monthly(spark, sf_dir)).groupBy("variable").agg(side("gcm", "future").alias("b"), side("ref", "future").alias("d"), side("gcm", "percent").alias("bp"), side("ref", "percent").alias("dp"))
    g = g.select("variable", (F.col("d") - F.col("b")).alias("difference"), percent_of(F.col("d") - F.col("b"), F.col("b")).alias("difference_percent"), (F.col("dp") - F.col("bp")).alias("change_points"))
    return out(g, ["variable"], ["difference", "difference_percent", "change_points"])


_Z = """nm AS (SELECT model, source, variable, ym, year, month, sum(value * weight) / sum(weight) AS v FROM al WHERE weight > 0 GROUP BY ALL),
zb AS (SELECT model, source, variable, month, avg(v) AS m, stddev_samp(v) AS s FROM nm WHERE year <= 1997 GROUP BY ALL),
z AS (SELECT nm.*, CASE WHEN s > 0 THEN (v - m) / s END AS z, CASE variable WHEN 'rsds' THEN 'solar_pv' ELSE variable END AS family FROM nm JOIN zb USING (model, source, variable, month) WHERE year > 1997)"""


def transition(cube):
    from aeolith.sources.cubes import long_form

    by = ["model", "source", "variable"]
    m = long_form(cube).where("weight > 0").groupBy(*by, "ym", "year", "month").agg(weighted_mean(F.col("value"), F.col("weight")).alias("v"))
    z = ensemble.z_scores(m.where("year > 1997"), m.where("year <= 1997"), [*by, "month"], "v")
    return z.withColumn("family", ensemble.warning_family(F.col("variable")))


@query(f"{A}, {_Z} SELECT model, source, variable, ym, {r('v')} AS v, {r('z')} AS z, coalesce(abs(z) > 3, FALSE) AS flagged FROM z")
def transition_z(spark, sf_dir):
    z = transition(monthly(spark, sf_dir)).withColumn("flagged", F.coalesce(F.abs("z") > 3, F.lit(False)))
    return out(z, ["model", "source", "variable", "ym", "flagged"], ["v", "z"])


_UP = "count(*) AS raw_rows, array_to_string(list_sort(list(DISTINCT variable)), ';') AS variables, array_to_string(list_sort(list(DISTINCT source)), ';') AS runs, max(abs(z)) AS m"


@query(f"""{A}, {_Z}, w AS (SELECT * FROM z WHERE abs(z) > 1.5),
u AS (SELECT model, ym, variable, NULL AS family, {_UP} FROM w GROUP BY model, ym, variable UNION ALL SELECT model, ym, NULL, family, {_UP} FROM w GROUP BY model, ym, family)
SELECT model, ym, variable, family, raw_rows, variables, runs, {r('m')} AS max_abs_z FROM u""")
def warning_rollup(spark, sf_dir):
    e = ensemble.roll_up(transition(monthly(spark, sf_dir)).where("abs(z) > 1.5"))
    return out(e, ["model", "ym", "variable", "family", "variables", "runs"], ["max_abs_z"], ["raw_rows"])
