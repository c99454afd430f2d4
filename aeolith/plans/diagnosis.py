"""Validation and diagnostics."""

from pyspark.sql import functions as F

from aeolith.operators import diagnostics as diag
from aeolith.operators import stats
from aeolith.plans.common import A, long_form, monthly, out, r, reused
from aeolith.plans.registry import query
from aeolith.plans.statistics import _PAIR, pairs

_BY = ["model", "variable", "month"]
_VM = f"""{_PAIR}, v AS (SELECT *, ym % 12 + 1 AS month FROM z WHERE x IS NOT NULL AND y IS NOT NULL AND weight > 0),
cl AS (SELECT model, variable, month, cell, weight, avg(x) AS x, avg(y) AS y, stddev_samp(x) AS sx, stddev_samp(y) AS sy FROM v GROUP BY ALL),
b AS (SELECT *, x - y AS bias, abs(sx - sy) AS std_error FROM cl),
bm AS (SELECT model, variable, month, count(*) AS cells, sum(bias * weight) / sum(weight) AS bias_mean, sum(abs(bias) * weight) / sum(weight) AS abs_bias_mean, sqrt(sum(bias * bias * weight) / sum(weight)) AS rmse,
       sum(x * weight) / sum(weight) AS mx, sum(y * weight) / sum(weight) AS my FROM b GROUP BY ALL),
bq AS (SELECT model, variable, month, min(CASE WHEN s >= 0.5 * t THEN bias END) AS bias_median FROM (SELECT *, sum(weight) OVER (PARTITION BY model, variable, month ORDER BY bias ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, variable, month) AS t FROM b) GROUP BY ALL),
bs AS (SELECT model, variable, month, min(CASE WHEN s >= 0.5 * t THEN std_error END) AS std_error_median FROM (SELECT *, sum(weight) OVER (PARTITION BY model, variable, month ORDER BY std_error ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, variable, month) AS t FROM b WHERE std_error IS NOT NULL) GROUP BY ALL),
bc AS (SELECT model, variable, month, sum(weight * (x - mx) * (y - my)) AS xy, sum(weight * (x - mx) * (x - mx)) AS xx, sum(weight * (y - my) * (y - my)) AS yy FROM b JOIN bm USING (model, variable, month) GROUP BY ALL),
ba AS (SELECT model, variable, month, min(CASE WHEN s >= 0.5 * t THEN a END) AS abs_bias_median FROM (SELECT *, sum(weight) OVER (PARTITION BY model, variable, month ORDER BY a ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, variable, month) AS t FROM (SELECT *, abs(bias) AS a FROM b)) GROUP BY ALL),
px AS (SELECT model, variable, month, min(CASE WHEN s >= 0.1 * t THEN x END) AS model_p10, min(CASE WHEN s >= 0.5 * t THEN x END) AS model_median, min(CASE WHEN s >= 0.9 * t THEN x END) AS model_p90 FROM (SELECT *, sum(weight) OVER (PARTITION BY model, variable, month ORDER BY x ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, variable, month) AS t FROM v) GROUP BY ALL),
py AS (SELECT model, variable, month, min(CASE WHEN s >= 0.1 * t THEN y END) AS reference_p10, min(CASE WHEN s >= 0.5 * t THEN y END) AS reference_median, min(CASE WHEN s >= 0.9 * t THEN y END) AS reference_p90 FROM (SELECT *, sum(weight) OVER (PARTITION BY model, variable, month ORDER BY y ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, variable, month) AS t FROM v) GROUP BY ALL),
vm AS (SELECT abs_bias_median, mx AS model_mean, my AS reference_mean, model_p10, model_median, model_p90, reference_p10, reference_median, reference_p90, model, variable, month, cells, bias_mean, abs_bias_mean, rmse, bias_median, std_error_median, CASE WHEN cells >= 3 AND xx > 0 AND yy > 0 THEN xy / sqrt(xx * yy) END AS r FROM bm JOIN bq USING (model, variable, month) JOIN bc USING (model, variable, month) JOIN ba USING (model, variable, month) JOIN px USING (model, variable, month) JOIN py USING (model, variable, month) LEFT JOIN bs USING (model, variable, month))"""
_M = ("bias_mean", "abs_bias_mean", "rmse", "bias_median", "abs_bias_median", "std_error_median", "r", "model_mean", "reference_mean", *[f"{s}_{q}" for s in ("model", "reference") for q in ("p10", "median", "p90")])


def validation(cube):
    """Each month's climatology against the reference's, weighted by area."""
    v = pairs(cube).where("x is not null and y is not null and weight > 0")
    cl = v.groupBy(*_BY, "cell", "weight").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    b = cl.withColumn("bias", F.col("x") - F.col("y")).withColumn("std_error", F.abs(F.col("sx") - F.col("sy")))
    w = F.col("weight")
    m = b.groupBy(*_BY).agg(F.count("*").alias("cells"), stats.weighted_mean(F.col("bias"), w).alias("bias_mean"), stats.weighted_mean(F.abs("bias"), w).alias("abs_bias_mean"), F.sqrt(stats.weighted_mean(F.col("bias") ** 2, w)).alias("rmse"), stats.weighted_mean(F.col("x"), w).alias("model_mean"), stats.weighted_mean(F.col("y"), w).alias("reference_mean"))
    q = stats.weighted_quantiles(b, _BY, "bias", "weight", {"bias_median": 0.5})
    s = stats.weighted_quantiles(b, _BY, "std_error", "weight", {"std_error_median": 0.5})
    c = stats.weighted_correlation(b, _BY, "x", "y", "weight").select(*_BY, "r")
    a = stats.weighted_quantiles(b.withColumn("a", F.abs("bias")), _BY, "a", "weight", {"abs_bias_median": 0.5})
    points = {"p10": 0.1, "median": 0.5, "p90": 0.9}
    pooled = [stats.weighted_quantiles(v, _BY, k, "weight", {f"{side}_{q}": p for q, p in points.items()}) for k, side in (("x", "model"), ("y", "reference"))]
    return m.join(q, _BY).join(a, _BY).join(pooled[0], _BY).join(pooled[1], _BY).join(s, _BY, "left").join(c, _BY)


@query(f"{A}, {_VM} SELECT model, variable, month, cells, {', '.join(f'{r(c)} AS {c}' for c in _M)} FROM vm")
def validation_monthly(spark, sf_dir):
    return out(validation(reused(monthly(spark, sf_dir))), _BY, _M, ["cells"])


@query(f"{A}, {_VM} SELECT model, variable, count(*) AS months, {', '.join(f'{r(f'quantile_cont({c}, 0.5)')} AS {c}' for c in _M)}, {r('avg(rmse)')} AS rmse_mean, {r('max(rmse)')} AS rmse_max FROM vm GROUP BY ALL")
def validation_summary(spark, sf_dir):
    """Medians over months."""
    g = validation(reused(monthly(spark, sf_dir))).groupBy("model", "variable").agg(F.count("*").alias("months"), *[F.percentile(c, 0.5).alias(c) for c in _M], F.avg("rmse").alias("rmse_mean"), F.max("rmse").alias("rmse_max"))
    return out(g, ["model", "variable"], [*_M, "rmse_mean", "rmse_max"], ["months"])


_FL = "CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END"
_QS = [f"q{int(100 * p):02d}" for p in diag.POINTS]


def _sql_cells(side: str, source: str) -> str:
    share = lambda cond: f"100 * avg(CASE WHEN {cond} THEN 1.0 WHEN value IS NOT NULL THEN 0.0 END)"
    q = ", ".join(f"quantile_cont(value, {p}) AS {side}_{n}" for p, n in zip(diag.POINTS, _QS))
    return f"""
{side}0 AS (SELECT model, variable, month, cell, {share(f'abs(value) <= {_FL}')} AS {side}_near_zero_percent, {share('value < 0')} AS {side}_negative_percent, avg(value) AS {side}_mean, stddev_samp(value) AS {side}_std, {q} FROM pv WHERE source = '{source}' GROUP BY ALL),
{side}1 AS (SELECT model, variable, month, cell, avg(pow((value - {side}_mean) / {side}_std, 3)) AS {side}_skew FROM pv JOIN {side}0 USING (model, variable, month, cell) WHERE source = '{source}' AND {side}_std > 1e-9 GROUP BY ALL),
{side}2 AS (SELECT * FROM {side}0 LEFT JOIN {side}1 USING (model, variable, month, cell))"""


_PAIRS = """pr AS (SELECT model, variable, month, cell, year, max(CASE WHEN source = 'gcm' THEN value END) AS x, max(CASE WHEN source = 'ref' THEN value END) AS y FROM al WHERE year <= 1999 GROUP BY ALL),
pc AS (SELECT *, bool_and(x IS NOT NULL AND y IS NOT NULL) OVER (PARTITION BY model, variable, month, cell) AS complete FROM pr),
pv AS (SELECT model, variable, month, cell, 'gcm' AS source, x AS value FROM pc WHERE complete UNION ALL SELECT model, variable, month, cell, 'ref', y FROM pc WHERE complete)"""
_CELLS = f"""{_PAIRS}, {_sql_cells('model', 'gcm')}, {_sql_cells('reference', 'ref')},
db AS (SELECT *, model_mean - reference_mean AS mean_bias, CASE WHEN abs(model_mean) > {_FL} THEN reference_mean / model_mean END AS multiply_mean, CASE WHEN abs(model_std) > 1e-12 THEN reference_std / model_std END AS multiply_std,
       {', '.join(f'reference_{q} - model_{q} AS add_{q}, CASE WHEN abs(model_{q}) > {_FL} THEN reference_{q} / model_{q} END AS multiply_{q}' for q in _QS)} FROM model2 JOIN reference2 USING (model, variable, month, cell))"""
_MEASURES = diag.measures()
_DIAG = f"""{_CELLS}, dl AS (UNPIVOT (SELECT model, variable, month, {', '.join(f'{m}::DOUBLE AS {m}' for m in _MEASURES)} FROM db) ON {', '.join(_MEASURES)} INTO NAME measure VALUE value)"""


def both_distributions(cube):
    """(pairs, cells): samples of both sides until 1999, and the distributions of cells that have all of them."""
    d = long_form(cube).where("year <= 1999")
    by = [*_BY, "cell"]
    pairs = diag.complete_pairs(d.where("source = 'gcm'"), d.where("source = 'ref'"), by, "year", "value")
    whole = pairs.where("complete")
    m = diag.cell_distributions(whole, by, "x", "model")
    o = diag.cell_distributions(whole, by, "y", "reference")
    return pairs, diag.adjustments(m.join(o, by))


@query(f"""{A}, {_DIAG} SELECT model, variable, month, measure, count(value) AS n,
{', '.join(f'{r(e)} AS {n}' for n, e in (('min', 'min(value)'), ('p10', 'quantile_cont(value, 0.1)'), ('median', 'quantile_cont(value, 0.5)'), ('mean', 'avg(value)'), ('p90', 'quantile_cont(value, 0.9)'), ('max', 'max(value)')))} FROM dl GROUP BY ALL""")
def distribution_diagnostics(spark, sf_dir):
    """41 measures of each month, six statistics over complete cells each."""
    _, cells = both_distributions(reused(monthly(spark, sf_dir)))
    # a deviation that is only the noise of sums has no skewness
    cells = cells.withColumns({f"{s}_skew": F.when(F.col(f"{s}_std") > 1e-9, F.col(f"{s}_skew")) for s in ("model", "reference")})
    s = diag.spatial_summary(cells.select(*_BY, *_MEASURES), _BY, _MEASURES)
    return out(s.where("n > 0"), [*_BY, "measure"], ["min", "p10", "median", "mean", "p90", "max"], ["n"])


_SCALARS = ["complete_percent", "paired_percent", "model_near_zero_percent", "reference_near_zero_percent", "model_negative_percent", "reference_negative_percent", "model_mean", "reference_mean", "mean_ratio_invalid_percent", "std_ratio_invalid_percent", *[f"{q}_invalid_percent" for q in _QS]]


@query(f"""{A}, {_CELLS},
g AS (SELECT model, variable, month, count(DISTINCT cell) AS grid_cells, count(DISTINCT cell) FILTER (WHERE complete) AS complete_cells, 100 * avg((x IS NOT NULL AND y IS NOT NULL)::INT) AS paired_percent, {', '.join(f"100 * avg(CASE WHEN complete THEN ({cond})::INT END) AS {n}" for n, cond in (('model_near_zero_percent', f'abs(x) <= {_FL}'), ('reference_near_zero_percent', f'abs(y) <= {_FL}'), ('model_negative_percent', 'x < 0'), ('reference_negative_percent', 'y < 0')))},
      avg(CASE WHEN complete THEN x END) AS model_mean, avg(CASE WHEN complete THEN y END) AS reference_mean FROM pc GROUP BY ALL),
i AS (SELECT model, variable, month, 100 * avg((abs(model_mean) <= {_FL})::INT) AS mean_ratio_invalid_percent, 100 * avg((abs(model_std) <= 1e-12)::INT) AS std_ratio_invalid_percent, {', '.join(f'100 * avg((abs(model_{q}) <= {_FL})::INT) AS {q}_invalid_percent' for q in _QS)} FROM db GROUP BY ALL),
z AS (SELECT g.*, 100 * complete_cells / grid_cells AS complete_percent, i.* EXCLUDE (model, variable, month) FROM g LEFT JOIN i USING (model, variable, month))
SELECT model, variable, month, grid_cells, complete_cells, {', '.join(f'{r(c)} AS {c}' for c in _SCALARS)} FROM z""")
def distribution_scalars(spark, sf_dir):
    """What a month says as a whole."""
    pairs, cells = both_distributions(reused(monthly(spark, sf_dir)))
    return out(diag.month_scalars(pairs, cells, _BY), _BY, _SCALARS, ["grid_cells", "complete_cells"])


@query(f"""{A}, k AS (SELECT model, variable, month, cell, value, row_number() OVER (PARTITION BY model, variable, month, cell ORDER BY value DESC) AS k FROM al WHERE source = 'gcm' AND value IS NOT NULL),
q AS (SELECT model, variable, month, cell, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.99) FILTER (WHERE k > 1) AS w FROM k GROUP BY ALL),
m AS (SELECT model, variable, month, quantile_cont(CASE WHEN abs(q99) > {_FL} THEN 100 * abs(w - q99) / abs(q99) END, 0.9) AS s, 100 * avg(CASE WHEN abs(q01) <= {_FL} THEN 1.0 ELSE 0.0 END) AS i FROM q GROUP BY ALL),
nz AS (SELECT model, variable, max(z) AS z FROM (SELECT model, variable, month, source, 100 * avg(CASE WHEN abs(value) <= {_FL} THEN 1.0 ELSE 0.0 END) AS z FROM al WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL),
bb AS (SELECT model, variable, month, quantile_cont(b, 0.5) AS b FROM (SELECT model, variable, month, cell, avg(CASE WHEN source = 'gcm' THEN value END) - avg(CASE WHEN source = 'ref' THEN value END) AS b FROM al GROUP BY ALL) GROUP BY ALL),
g AS (SELECT model, variable, quantile_cont(abs(b), 0.5) AS median_absolute_bias, quantile_cont(s, 0.5) AS median_sensitivity, max(s) AS worst_sensitivity, max(z) AS worst_near_zero, max(i) AS worst_invalid FROM m JOIN bb USING (model, variable, month) JOIN nz USING (model, variable) GROUP BY ALL)
SELECT model, variable, {r('median_absolute_bias')} AS median_absolute_bias, {r('median_sensitivity')} AS median_sensitivity, {r('worst_sensitivity')} AS worst_sensitivity, {r('worst_near_zero')} AS worst_near_zero, {r('worst_invalid')} AS worst_invalid, CASE WHEN worst_sensitivity > 10 THEN '{diag.FLAGS[0]}' ELSE '{diag.FLAGS[1]}' END AS flag,
CASE WHEN worst_sensitivity > 10 THEN '{diag.BOUNDS[0]}' ELSE '{diag.BOUNDS[1]}' END AS bounds, CASE WHEN variable = 'tas' THEN '{diag.ACTIONS['tas']}' WHEN worst_near_zero > 1 OR worst_invalid > 1 THEN '{diag.ACTIONS['near_zero']}' ELSE '{diag.ACTIONS['other']}' END AS action FROM g""")
def recommendations(spark, sf_dir):
    by = [*_BY, "cell"]
    both = long_form(reused(monthly(spark, sf_dir)))
    d = both.where("source = 'gcm'")
    full = d.groupBy(*by).agg(F.percentile("value", 0.01).alias("q01"), F.percentile("value", 0.99).alias("q99"))
    less = stats.without_greatest(d, by, "value").groupBy(*by).agg(F.percentile("value", 0.99).alias("w"))
    floor = F.when(F.col("variable") == "wind", 0.1).otherwise(1.0)
    use = F.abs("q99") > floor
    c = full.join(less, by, "left").withColumn("s", F.when(use, 100 * F.abs(F.col("w") - F.col("q99")) / F.abs(F.when(use, F.col("q99")))))
    m = c.groupBy(*_BY).agg(F.percentile("s", 0.9).alias("s"), diag.invalid_percent(F.col("q01"), floor).alias("i"))
    z = both.where("value is not null").groupBy(*_BY, "source").agg((100 * F.avg((F.abs("value") <= floor).cast("double"))).alias("z")).groupBy(*_BY).agg(F.max("z").alias("z"))
    pick = lambda side: F.avg(F.when(F.col("source") == side, F.col("value")))
    b = both.groupBy(*by).agg((pick("gcm") - pick("ref")).alias("b")).groupBy(*_BY).agg(F.percentile("b", 0.5).alias("b"))
    g = diag.recommend(m.join(z, _BY).join(b, _BY), ["model", "variable"], "s", "z", "i", "b")
    return out(g, ["model", "variable", "flag", "bounds", "action"], ["median_absolute_bias", "median_sensitivity", "worst_sensitivity", "worst_near_zero", "worst_invalid"])


@query(f"""{A}, pm AS (SELECT model, variable, avg(value) AS m, stddev_pop(value) AS s FROM al WHERE source = 'gcm' GROUP BY ALL), wm AS (SELECT variable, sum(value * weight) / sum(CASE WHEN value IS NOT NULL THEN weight END) AS w FROM al WHERE source = 'gcm' GROUP BY ALL)
SELECT variable, {r('avg(value)')} AS plain, {r('stddev_pop(value)')} AS plain_std, {r('any_value(pmean)')} AS by_model, {r('any_value(pstd)')} AS by_model_std, {r('any_value(w)')} AS weighted, {r('sqrt(sum(weight * (value - w) * (value - w)) / sum(CASE WHEN value IS NOT NULL THEN weight END))')} AS weighted_std, count(value) AS n
FROM al JOIN (SELECT variable, avg(m) AS pmean, avg(s) AS pstd FROM pm GROUP BY variable) USING (variable) JOIN wm USING (variable) WHERE source = 'gcm' GROUP BY variable""")
def pooled_candidates(spark, sf_dir):
    """Three orders of averaging: all values, model by model, by area."""
    d = long_form(monthly(spark, sf_dir)).where("source = 'gcm'")
    one = d.groupBy("model", "variable").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).groupBy("variable").agg(F.avg("m").alias("by_model"), F.avg("s").alias("by_model_std"))
    g = d.groupBy("variable").agg(F.avg("value").alias("plain"), F.stddev_pop("value").alias("plain_std"), F.count("value").alias("n"))
    w = stats.weighted_moments(d, ["variable"], "value", "weight").select("variable", F.col("mean").alias("weighted"), F.col("std").alias("weighted_std"))
    return out(g.join(one, "variable").join(w, "variable"), ["variable"], ["plain", "plain_std", "by_model", "by_model_std", "weighted", "weighted_std"], ["n"])
