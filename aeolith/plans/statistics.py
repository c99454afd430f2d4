"""Statistics with and without weights."""

from pyspark.sql import functions as F

from aeolith.config import DEFAULT
from aeolith.operators import stats
from aeolith.operators.cdf import cross_cdf, self_cdf, tied_ranks
from aeolith.plans.common import A, long_form, monthly, out, r, table
from aeolith.plans.registry import query

BY = ["model", "source", "variable", "ym"]
W = "weight > 0 AND value IS NOT NULL"


@query(f"""{A}, q AS (SELECT model, cell, month, variable, quantile_cont(value, {[round(p, 12) for p in DEFAULT.node_points]}) AS q FROM al WHERE source = 'gcm' AND year BETWEEN 1995 AND 1997 GROUP BY ALL)
SELECT model, cell, month, variable, k::INT AS node, {r('q[k]')} AS value FROM q, unnest(range(1, 100)) AS t(k)""")
def cell_quantile_nodes(spark, sf_dir):
    d = long_form(monthly(spark, sf_dir)).where("source = 'gcm' and year between 1995 and 1997")
    q = d.groupBy("model", "cell", "month", "variable").agg(stats.linear_quantiles("value", [round(p, 12) for p in DEFAULT.node_points]).alias("q"))
    q = q.select("model", "cell", "month", "variable", F.posexplode("q").alias("k", "value"))
    return out(q.withColumn("node", F.col("k") + 1), ["model", "cell", "month", "variable", "node"], ["value"])


_CUM = f", c AS (SELECT *, sum(weight) OVER (PARTITION BY model, source, variable, ym ORDER BY value ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY model, source, variable, ym) AS t FROM al WHERE {W})"


@query(f"""{A}{_CUM} SELECT model, source, variable, ym, {', '.join(f"{r(f'min(CASE WHEN s >= {p} * t THEN value END)')} AS {n}" for n, p in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))} FROM c GROUP BY ALL""")
def weighted_quantiles(spark, sf_dir):
    q = stats.weighted_quantiles(long_form(monthly(spark, sf_dir)), BY, "value", "weight", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return out(q, BY, ["p10", "median", "p90"])


_QBY = "model, source, variable"


@query(f"""{A}, d AS (SELECT *, sum(weight) OVER (PARTITION BY {_QBY} ORDER BY value ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY {_QBY}) AS t FROM al WHERE {W}),
m AS (SELECT {_QBY}, count(*) AS n, sum(value * weight) / sum(weight) AS mean, 100 * sum(CASE WHEN value < 0 THEN weight ELSE 0 END) / sum(weight) AS negative_percent, min(value) AS min, max(value) AS max,
      min(CASE WHEN s >= 0.01 * t THEN value END) AS p01, min(CASE WHEN s >= 0.5 * t THEN value END) AS median, min(CASE WHEN s >= 0.99 * t THEN value END) AS p99 FROM d GROUP BY ALL),
v AS (SELECT {_QBY}, sqrt(sum(weight * (value - mean) * (value - mean)) / sum(weight)) AS std FROM d JOIN m USING ({_QBY}) GROUP BY ALL),
x AS (SELECT {_QBY}, 100 * sum(CASE WHEN value IS NULL THEN weight ELSE 0 END) / sum(weight) AS missing_percent FROM al WHERE weight > 0 GROUP BY ALL)
SELECT {_QBY}, n, {', '.join(f'{r(c)} AS {c}' for c in ('missing_percent', 'negative_percent', 'min', 'p01', 'median', 'mean', 'std', 'p99', 'max'))} FROM m JOIN v USING ({_QBY}) JOIN x USING ({_QBY})""")
def qc_statistics(spark, sf_dir):
    """Weighted statistics pooled over months and cells."""
    by = ["model", "source", "variable"]
    return out(stats.area_statistics(long_form(monthly(spark, sf_dir)), by, "value", "weight", pooled=True), by, stats.AREA_STATISTICS, ["n"])


@query(f"""{A}, p AS (SELECT model, source, variable, cell, weight, avg(value) AS value FROM al GROUP BY ALL),
c AS (SELECT *, sum(weight) OVER (PARTITION BY {_QBY} ORDER BY value ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY {_QBY}) AS t FROM p WHERE {W})
SELECT {_QBY}, {r('min(CASE WHEN s >= 0.5 * t THEN value END)')} AS median, {r('sum(value * weight) / sum(weight)')} AS mean, {r('min(CASE WHEN s >= 0.1 * t THEN value END)')} AS p10,
       {r('min(CASE WHEN s >= 0.9 * t THEN value END)')} AS p90, {r('max(value)')} AS max FROM c GROUP BY ALL""")
def spatial_statistics(spark, sf_dir):
    by = ["model", "source", "variable"]
    p = long_form(monthly(spark, sf_dir)).groupBy(*by, "cell", "weight").agg(F.avg("value").alias("value"))
    q = stats.weighted_quantiles(p, by, "value", "weight", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    m = p.where("weight > 0").groupBy(*by).agg(stats.weighted_mean(F.col("value"), F.col("weight")).alias("mean"), F.max("value").alias("max"))
    return out(q.join(m, by), by, ["median", "mean", "p10", "p90", "max"])


@query(f"""{A} SELECT model, source, variable, month, count(value) AS n, {r('100 * avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_percent, {r('100 * avg(CASE WHEN value < 0 THEN 1.0 WHEN value >= 0 THEN 0.0 END)')} AS negative_percent,
{', '.join(f'{r(e)} AS {c}' for c, e in (('min', 'min(value)'), ('p01', 'quantile_cont(value, 0.01)'), ('median', 'quantile_cont(value, 0.5)'), ('mean', 'avg(value)'), ('std', 'stddev_pop(value)'), ('p99', 'quantile_cont(value, 0.99)'), ('max', 'max(value)')))} FROM al GROUP BY ALL""")
def unweighted_statistics(spark, sf_dir):
    by = ["model", "source", "variable", "month"]
    g = stats.plain_statistics(long_form(monthly(spark, sf_dir)), by, "value")
    return out(g, by, ["missing_percent", "negative_percent", "min", "p01", "median", "mean", "std", "p99", "max"], ["n"])


@query(f"{A} SELECT model, source, variable, {r('quantile_cont(value, 0.5)')} AS median, {r('avg(value)')} AS mean, {r('quantile_cont(value, 0.9)')} AS p90, {r('max(value)')} AS max FROM al GROUP BY ALL")
def finite_summary(spark, sf_dir):
    by = ["model", "source", "variable"]
    d = long_form(monthly(spark, sf_dir))
    g = d.groupBy(*by).agg(F.avg("value").alias("mean"), F.max("value").alias("max")).join(stats.pooled_quantiles(d, by, "value", {"median": 0.5, "p90": 0.9}), by)
    return out(g, by, ["median", "mean", "p90", "max"])


@query(f"""{A} SELECT model, source, variable, ym, {r('value')} AS max, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY model, source, variable, ym ORDER BY value DESC, lat, lon) AS k FROM al WHERE value IS NOT NULL) WHERE k = 1""")
def place_of_maximum(spark, sf_dir):
    p = stats.place_of_max(long_form(monthly(spark, sf_dir)), BY, "value")
    return out(p, [*BY, "lat", "lon"], ["max"])


@query(f"""{A} SELECT model, source, variable, cell, month, year, {r('(rank() OVER g - 1 + 0.5 * count(*) OVER (PARTITION BY model, source, variable, cell, month, value)) / count(*) OVER (PARTITION BY model, source, variable, cell, month)')} AS p
FROM al WHERE value IS NOT NULL WINDOW g AS (PARTITION BY model, source, variable, cell, month ORDER BY value)""")
def self_cdf_months(spark, sf_dir):
    by = ["model", "source", "variable", "cell", "month"]
    d = long_form(monthly(spark, sf_dir)).where("value is not null").withColumn("p", self_cdf(by, "value"))
    return out(d, [*by, "year"], ["p"])


@query(f"""{A}, s AS (SELECT model, variable, cell, month, list(value) AS v FROM al WHERE source = 'gcm' AND year BETWEEN 1995 AND 1997 AND value IS NOT NULL GROUP BY ALL)
SELECT t.model, t.variable, t.cell, t.month, t.year, {r('(len(list_filter(v, lambda x: x < t.value)) + 0.5 * len(list_filter(v, lambda x: x = t.value))) / len(v)')} AS p
FROM al t LEFT JOIN s USING (model, variable, cell, month) WHERE t.source = 'gcm' AND t.year BETWEEN 1998 AND 2000 AND t.value IS NOT NULL""")
def cross_cdf_months(spark, sf_dir):
    by = ["model", "variable", "cell", "month"]
    d = long_form(monthly(spark, sf_dir)).where("source = 'gcm'")
    return out(cross_cdf(d.where("year between 1995 and 1997"), d.where("year between 1998 and 2000"), by, "value", ["year"]), [*by, "year"], ["p"])


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber, {r('rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2')} AS rank,
{r('(rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 + 0.5 * count(*) OVER (PARTITION BY l_suppkey, l_quantity)) / count(*) OVER (PARTITION BY l_suppkey)')} AS p FROM lineitem""")
def ranks_with_ties(spark, sf_dir):
    """Average ranks and mid-rank distribution where most values are tied."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return out(tied_ranks(d, ["l_suppkey"], "l_quantity"), ["l_suppkey", "l_orderkey", "l_linenumber"], ["rank", "p"])


_PAIR = "z AS (SELECT model, variable, ym, cell, weight, max(CASE WHEN source = 'gcm' THEN value END) AS x, max(CASE WHEN source = 'ref' THEN value END) AS y FROM al GROUP BY ALL)"


def pairs(cube):
    """(model, variable, ym, month, cell, weight, x of the model, y of the reference)"""
    g = long_form(cube).groupBy("model", "variable", "ym", "month", "cell", "weight").pivot("source", ["gcm", "ref"]).agg(F.max("value"))
    return g.withColumnRenamed("gcm", "x").withColumnRenamed("ref", "y")


@query(f"""{A}, {_PAIR}, k AS (SELECT * FROM z WHERE x IS NOT NULL AND y IS NOT NULL AND weight > 0),
m AS (SELECT model, variable, ym, count(*) AS n, sum(x * weight) / sum(weight) AS mx, sum(y * weight) / sum(weight) AS my FROM k GROUP BY ALL),
c AS (SELECT model, variable, ym, n, sum(weight * (x - mx) * (y - my)) AS xy, sum(weight * (x - mx) * (x - mx)) AS xx, sum(weight * (y - my) * (y - my)) AS yy, sqrt(sum(weight * (x - y) * (x - y)) / sum(weight)) AS rmse FROM k JOIN m USING (model, variable, ym) GROUP BY ALL)
SELECT model, variable, ym, n, CASE WHEN n >= 3 AND xx > 0 AND yy > 0 THEN {r('xy / sqrt(xx * yy)')} END AS r, {r('rmse')} AS rmse FROM c""")
def weighted_correlation(spark, sf_dir):
    """Pattern correlation and error of each month, weighted by area."""
    by = ["model", "variable", "ym"]
    d = pairs(monthly(spark, sf_dir))
    c = stats.weighted_correlation(d, by, "x", "y", "weight")
    both = d.where("x is not null and y is not null and weight > 0")
    e = both.groupBy(*by).agg(F.sqrt(stats.weighted_mean((F.col("x") - F.col("y")) ** 2, F.col("weight"))).alias("rmse"))
    return out(c.join(e, by), by, ["r", "rmse"], ["n"])


@query(f"""{A}, m AS (SELECT model, source, variable, cell, avg(value) AS m, stddev_samp(value) AS s, count(value) AS n FROM al GROUP BY ALL)
SELECT model, source, variable, cell, n, {r('avg(pow((value - m) / s, 3))')} AS skew FROM al JOIN m USING (model, source, variable, cell) WHERE value IS NOT NULL AND n > 2 AND s > 0 GROUP BY ALL""")
def skewness_ddof1(spark, sf_dir):
    by = ["model", "source", "variable", "cell"]
    g = long_form(monthly(spark, sf_dir)).groupBy(*by).agg(F.count("value").alias("n"), F.stddev_samp("value").alias("s"), stats.skewness("value").alias("skew"))
    return out(g.where("n > 2 and s > 0"), by, ["skew"], ["n"])


@query(f"""{A}, k AS (SELECT model, variable, cell, value, row_number() OVER (PARTITION BY model, variable, cell ORDER BY value DESC) AS k FROM al WHERE source = 'gcm' AND value IS NOT NULL),
q AS (SELECT model, variable, cell, quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.99) FILTER (WHERE k > 1) AS q99_without FROM k GROUP BY ALL)
SELECT model, variable, cell, {r('q99')} AS q99, {r('q99_without')} AS q99_without, CASE WHEN abs(q99) > CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END THEN {r('100 * abs(q99_without - q99) / abs(q99)')} END AS sensitivity_percent FROM q""")
def leave_max_q99(spark, sf_dir):
    by = ["model", "variable", "cell"]
    d = long_form(monthly(spark, sf_dir)).where("source = 'gcm'")
    full = d.groupBy(*by).agg(F.percentile("value", 0.99).alias("q99"))
    less = stats.without_greatest(d, by, "value").groupBy(*by).agg(F.percentile("value", 0.99).alias("q99_without"))
    floor = F.when(F.col("variable") == "wind", 0.1).otherwise(1.0)
    use = F.abs("q99") > floor
    s = full.join(less, by, "left").withColumn("sensitivity_percent", F.when(use, 100 * F.abs(F.col("q99_without") - F.col("q99")) / F.abs(F.when(use, F.col("q99")))))
    return out(s, by, ["q99", "q99_without", "sensitivity_percent"])
