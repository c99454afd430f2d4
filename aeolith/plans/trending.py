"""Trends of series."""

from pyspark.sql import functions as F

from aeolith.functions.numeric import normal_p, same_direction
from aeolith.operators import trends
from aeolith.plans.common import B, out, phases, r, table
from aeolith.plans.registry import query

BY = ["cell", "phase"]
_P = "p AS (SELECT a.cell, a.phase, a.cycle AS t1, b2.cycle AS t2, a.value AS x1, b2.value AS x2 FROM b a JOIN b b2 ON a.cell = b2.cell AND a.phase = b2.phase AND a.cycle < b2.cycle WHERE a.value IS NOT NULL AND b2.value IS NOT NULL)"
_MK = f"""{_P}, s AS (SELECT cell, phase, sum(sign(x2 - x1)) AS s FROM p GROUP BY ALL), k AS (SELECT cell, phase, value, count(*) AS k FROM b WHERE value IS NOT NULL GROUP BY ALL),
v AS (SELECT cell, phase, sum(k) AS n, (sum(k) * (sum(k) - 1) * (2 * sum(k) + 5) - sum(k * (k - 1) * (2 * k + 5))) / 18 AS var_s FROM k GROUP BY ALL)"""


@query(f"{B}, {_MK} SELECT cell, phase, n::BIGINT AS n, {r('s')} AS s, {r('var_s')} AS var_s, {r('CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END')} AS z FROM v JOIN s USING (cell, phase)")
def mann_kendall(spark, sf_dir):
    return out(trends.mann_kendall(phases(spark, sf_dir), BY, "cycle", "value"), BY, ["s", "var_s", "z"], ["n"])


@query()
def mann_kendall_p(spark, sf_dir):
    """The two-sided p needs the error function, which neither engine has."""
    m = trends.mann_kendall(phases(spark, sf_dir), BY, "cycle", "value")
    return out(m.withColumn("p", normal_p(F.col("z"))), BY, ["z", "p"])


@query(f"{B} SELECT cell, phase, {r('regr_slope(value, cycle)')} AS slope, {r('regr_intercept(value, cycle)')} AS intercept FROM b GROUP BY ALL")
def ols_trend(spark, sf_dir):
    return out(trends.least_squares(phases(spark, sf_dir), BY, "cycle", "value"), BY, ["slope", "intercept"])


@query(f"{B}, {_P} SELECT cell, phase, {r('quantile_cont((x2 - x1) / (t2 - t1), 0.5)')} AS slope FROM p GROUP BY ALL")
def theil_sen(spark, sf_dir):
    return out(trends.theil_sen(phases(spark, sf_dir), BY, "cycle", "value"), BY, ["slope"])


_EP = {"first_value": "cycle = 1", "last_value": "cycle = 30", "late_mean": "cycle >= 24", "start_mean": "cycle BETWEEN 1 AND 5", "end_mean": "cycle BETWEEN 26 AND 30"}
_EPS = ", ".join(f"avg(CASE WHEN {c} THEN value END) AS {n}" for n, c in _EP.items())


@query(f"{B}, e AS (SELECT cell, phase, {_EPS} FROM b GROUP BY ALL) SELECT cell, phase, {', '.join(f'{r(n)} AS {n}' for n in _EP)}, {r('first_value - last_value')} AS decline, {r('start_mean - end_mean')} AS smoothed_decline FROM e")
def series_metrics(spark, sf_dir):
    e = trends.endpoints(phases(spark, sf_dir), BY, "cycle", "value", 1, 30, 24, 5)
    return out(e, BY, [*_EP, "decline", "smoothed_decline"])


@query(f"""{B}, e AS (SELECT cell, phase, {_EPS} FROM b GROUP BY ALL), p AS (SELECT DISTINCT event_type AS cell, length(event_type) % 2 * 2 - 1 AS sign FROM events)
SELECT cell, phase, sign::INT AS published, {r('first_value - last_value')} AS decline, coalesce((first_value - last_value >= 0) = (sign >= 0), FALSE) AS direction_match FROM e JOIN p USING (cell)""")
def published_comparison(spark, sf_dir):
    """Metrics beside a small table of published values."""
    e = trends.endpoints(phases(spark, sf_dir), BY, "cycle", "value", 1, 30, 24, 5)
    p = table(spark, sf_dir, "events").select(F.col("event_type").alias("cell"), (F.length("event_type") % 2 * 2 - 1).alias("published")).distinct()
    d = e.join(p, "cell").withColumn("direction_match", F.coalesce(same_direction(F.col("decline"), F.col("published")), F.lit(False)))
    return out(d, [*BY, "published", "direction_match"], ["decline"])
