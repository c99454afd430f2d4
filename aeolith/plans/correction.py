"""Bias correction, its checks and its signals: fitted on 1995 to 1997, applied to 1998 to 2000.

All groups are read; those without a value in each of the three years of all three samples
aren't complete, and have no corrected values.
"""

import dataclasses

from pyspark.sql import functions as F

from aeolith.config import DEFAULT
from aeolith.functions.numeric import change
from aeolith.operators import bias, stats
from aeolith.plans.common import A, B, long_form, monthly, out, phases, r, reused
from aeolith.plans.registry import query

BY = ["model", "variable", "cell", "month"]
YEARS = {bias.FIT: 3, bias.OBS: 3, bias.TARGET: 3}


def samples(cube, target="source = 'gcm' and year between 1998 and 2000"):
    """Rows of the three samples by ``role``; a row can have two."""
    d = long_form(cube).select(*BY, "source", "weight", "year", "value")
    roles = F.array(F.when(F.expr("source = 'gcm' and year between 1995 and 1997"), bias.FIT), F.when(F.expr("source = 'ref' and year between 1995 and 1997"), bias.OBS), F.when(F.expr(target), bias.TARGET))
    return d.select(*BY, "weight", "year", "value", F.explode(F.filter(roles, lambda x: x.isNotNull())).alias("role"))


def corrected(spark, sf_dir, bounds=None, **how):
    return bias.correct_samples(samples(monthly(spark, sf_dir), **how), BY, expected=YEARS, bounds=bounds)


_KEYS = "model, variable, cell, month"
_FIT, _OBS, _TARGET = "source = 'gcm' AND year BETWEEN 1995 AND 1997", "source = 'ref' AND year BETWEEN 1995 AND 1997", "source = 'gcm' AND year BETWEEN 1998 AND 2000"


def sql_corrected(low: str = "0.02", high: str = "0.98", target: str = _TARGET, p: str = "") -> str:
    """Common table expressions from al to cq: (keys, year, weight, value, ok, fm, om, and for both methods m: m_p, m, m_tail, m_fallback)."""
    nodes = [round(float(low) + k * (float(high) - float(low)) / 98, 12) for k in range(99)]

    def method(m: str, ratio: str) -> str:
        return f"""
{p}{m}1 AS (SELECT *, (least(greatest({m}_p, {low}), {high}) - {low}) / ({high} - {low}) * 98 AS pos FROM {p}x1),
{p}{m}2 AS (SELECT *, least(floor(pos), 98)::INT AS j FROM {p}{m}1),
{p}{m}3 AS (SELECT *, mq[j + 1] + (pos - j) * (mq[least(j + 2, 99)] - mq[j + 1]) AS m, oq[j + 1] + (pos - j) * (oq[least(j + 2, 99)] - oq[j + 1]) AS o FROM {p}{m}2),
{p}{m} AS (SELECT {_KEYS}, year, CASE WHEN good THEN CASE WHEN variable = 'tas' THEN CASE WHEN {ratio} AND abs(m) > 1 THEN value * o / m ELSE value + o - m END
      WHEN abs(m) > CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END THEN greatest(value * o / m, 0) ELSE greatest(value + o - m, 0) END END AS {m},
      CASE WHEN good THEN {m}_p < {low} OR {m}_p > {high} END AS {m}_tail, CASE WHEN good THEN ({ratio} OR variable <> 'tas') AND NOT abs(m) > CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END END AS {m}_fallback FROM {p}{m}3)"""

    return f"""
{p}f AS (SELECT {_KEYS}, list(value) FILTER (WHERE {_FIT} AND value IS NOT NULL) AS fit, list(value) FILTER (WHERE {target} AND value IS NOT NULL) AS tgt, avg(value) FILTER (WHERE {_FIT}) AS fm, avg(value) FILTER (WHERE {_OBS}) AS om,
       quantile_cont(value, {nodes}) FILTER (WHERE {_FIT}) AS mq, quantile_cont(value, {nodes}) FILTER (WHERE {_OBS}) AS oq,
       count(value) FILTER (WHERE {_FIT}) = 3 AND count(value) FILTER (WHERE {_OBS}) = 3 AND count(value) FILTER (WHERE {target}) = 3 AS ok FROM al GROUP BY {_KEYS}),
{p}x AS (SELECT {_KEYS}, al.year, al.weight, al.value, ok AND value IS NOT NULL AS good, {p}f.* EXCLUDE ({_KEYS}) FROM al JOIN {p}f USING ({_KEYS}) WHERE {target}),
{p}x1 AS (SELECT *, CASE WHEN value IS NOT NULL AND len(fit) > 0 THEN (len(list_filter(fit, lambda v: v < value)) + 0.5 * len(list_filter(fit, lambda v: v = value))) / len(fit) END AS qm_p,
              CASE WHEN value IS NOT NULL THEN (len(list_filter(tgt, lambda v: v < value)) + 0.5 * len(list_filter(tgt, lambda v: v = value))) / len(tgt) END AS qdm_p FROM {p}x),{method('qm', 'TRUE')},{method('qdm', 'FALSE')},
{p}cq AS (SELECT x.model, x.variable, x.cell, x.month, x.year, weight, value, ok, fm, om, qm_p, qm, qm_tail, qm_fallback, qdm_p, qdm, qdm_tail, qdm_fallback FROM {p}x1 x JOIN {p}qm USING ({_KEYS}, year) JOIN {p}qdm USING ({_KEYS}, year))"""


SQL = f"{A}, {sql_corrected()}"


@query(f"{SQL} SELECT {_KEYS}, year, ok AS complete, {r('qm_p')} AS p, {r('qm')} AS y, qm_tail AS tail, qm_fallback AS fallback FROM cq")
def qm_ratio(spark, sf_dir):
    return _rows(spark, sf_dir, "qm")


@query(f"{SQL} SELECT {_KEYS}, year, ok AS complete, {r('qdm_p')} AS p, {r('qdm')} AS y, qdm_tail AS tail, qdm_fallback AS fallback FROM cq")
def qdm_additive(spark, sf_dir):
    return _rows(spark, sf_dir, "qdm")


def _rows(spark, sf_dir, m):
    d = corrected(spark, sf_dir).select(*BY, "year", "complete", F.col(f"{m}_p").alias("p"), F.col(m).alias("y"), F.col(f"{m}_tail").alias("tail"), F.col(f"{m}_fallback").alias("fallback"))
    return out(d, [*BY, "year", "complete", "tail", "fallback"], ["p", "y"])


#: Few samples for each phase need few nodes.
CONFIG = dataclasses.replace(DEFAULT, nodes=9, window=10)
_BQ = """
h AS (SELECT cell, phase, quantile_cont(value, [0.02, 0.14, 0.26, 0.38, 0.5, 0.62, 0.74, 0.86, 0.98]) FILTER (WHERE cycle % 2 = 0) AS mq, quantile_cont(value, [0.02, 0.14, 0.26, 0.38, 0.5, 0.62, 0.74, 0.86, 0.98]) FILTER (WHERE cycle % 2 = 1) AS oq FROM b GROUP BY ALL),
i AS (SELECT *, row_number() OVER (PARTITION BY cell, phase ORDER BY cycle) - 1 AS i, count(*) OVER (PARTITION BY cell, phase) AS n FROM b),
s AS (SELECT *, least(greatest(i - 5, 0), n - 10) AS start FROM i WHERE n >= 10),
m AS (SELECT s.cell, s.phase, s.cycle, s.value, count(o.value) AS have, sum(CASE WHEN o.value < s.value THEN 1.0 WHEN o.value = s.value THEN 0.5 ELSE 0.0 END) / 10 AS p
      FROM s JOIN i AS o ON s.cell = o.cell AND s.phase = o.phase AND o.i >= s.start AND o.i < s.start + 10 GROUP BY ALL),
q1 AS (SELECT *, (least(greatest(p, 0.02), 0.98) - 0.02) / (0.98 - 0.02) * 8 AS pos FROM m JOIN h USING (cell, phase) WHERE have = 10),
q2 AS (SELECT *, least(floor(pos), 8)::INT AS j FROM q1),
q AS (SELECT *, mq[j + 1] + (pos - j) * (mq[least(j + 2, 9)] - mq[j + 1]) AS mv, oq[j + 1] + (pos - j) * (oq[least(j + 2, 9)] - oq[j + 1]) AS ov FROM q2)"""


@query(f"{B}, {_BQ} SELECT cell, phase, cycle, {r('p')} AS p, {r('value + ov - mv')} AS qdm, p < 0.02 OR p > 0.98 AS tail FROM q")
def qdm_moving_window(spark, sf_dir):
    """Windows of ten days on 6-hour series; even days stand for the model, odd ones for the reference."""
    d = phases(spark, sf_dir)
    even, odd = d.where("cycle % 2 = 0"), d.where("cycle % 2 = 1")
    even, odd, d = (x.withColumn("variable", F.lit("tas")) for x in (even, odd, d))
    q = bias.moving_delta_mapping(even, odd, d, ["variable", "cell", "phase"], "cycle", "value", config=CONFIG)
    return out(q.where("p is not null"), ["cell", "phase", "cycle", F.col("qdm_tail").alias("tail")], ["p", "qdm"])


_99 = [round(0.02 + k * 0.96 / 98, 12) for k in range(99)]


@query(f"""{A}, g AS (SELECT model, variable, cell, quantile_cont(value, {_99}) FILTER (WHERE {_FIT}) AS mq, quantile_cont(value, {_99}) FILTER (WHERE {_OBS}) AS oq,
       count(*) FILTER (WHERE ({_FIT}) AND value IS NULL) = 0 AND count(*) FILTER (WHERE ({_OBS}) AND value IS NULL) = 0 AS ok FROM al GROUP BY ALL),
i AS (SELECT model, variable, cell, ym, value, row_number() OVER (PARTITION BY model, variable, cell ORDER BY ym) - 1 AS i, count(*) OVER (PARTITION BY model, variable, cell) AS n FROM al WHERE source = 'gcm'),
s AS (SELECT *, CASE WHEN n >= 30 THEN least(greatest(i - 15, 0), n - 30) END AS start FROM i),
m AS (SELECT s.model, s.variable, s.cell, s.ym, s.value, count(o.value) AS have, sum(CASE WHEN o.value < s.value THEN 1.0 WHEN o.value = s.value THEN 0.5 ELSE 0.0 END) / 30 AS p0
      FROM s LEFT JOIN i AS o ON s.model = o.model AND s.variable = o.variable AND s.cell = o.cell AND o.i >= s.start AND o.i < s.start + 30 GROUP BY ALL),
q1 AS (SELECT *, CASE WHEN have = 30 AND value IS NOT NULL THEN p0 END AS p FROM m JOIN g USING (model, variable, cell) WHERE mq IS NOT NULL AND oq IS NOT NULL),
q2 AS (SELECT *, (least(greatest(p, 0.02), 0.98) - 0.02) / (0.98 - 0.02) * 98 AS pos FROM q1 WHERE p IS NOT NULL),
q3 AS (SELECT *, least(floor(pos), 98)::INT AS j FROM q2),
q4 AS (SELECT *, mq[j + 1] + (pos - j) * (mq[least(j + 2, 99)] - mq[j + 1]) AS mv, oq[j + 1] + (pos - j) * (oq[least(j + 2, 99)] - oq[j + 1]) AS ov, CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END AS floor FROM q3)
SELECT model, variable, cell, ym, {r('p')} AS p, {r("CASE WHEN ok THEN CASE WHEN variable = 'tas' THEN value + ov - mv WHEN abs(mv) > floor THEN greatest(value * ov / mv, 0) ELSE greatest(value + ov - mv, 0) END END")} AS qdm,
       CASE WHEN ok THEN p < 0.02 OR p > 0.98 END AS tail, CASE WHEN ok THEN variable <> 'tas' AND NOT abs(mv) > floor END AS fallback FROM q4""")
def qdm_thirty_months(spark, sf_dir):
    """The default settings (99 nodes, windows of 30) over all months of a cell, for all three variables."""
    d = long_form(monthly(spark, sf_dir)).select("model", "source", "variable", "cell", "ym", "year", "value")
    history, by = d.where("year between 1995 and 1997"), ["model", "variable", "cell"]
    q = bias.moving_delta_mapping(history.where("source = 'gcm'"), history.where("source = 'ref'"), d.where("source = 'gcm'"), by, "ym", "value")
    return out(q.where("p is not null"), [*by, "ym", F.col("qdm_tail").alias("tail"), F.col("qdm_fallback").alias("fallback")], ["p", "qdm"])


#: Raw, qm and qdm of the same targets, one row each.
_METHODS = f"""
u AS (SELECT 'raw' AS method, {_KEYS}, year, weight, ok, fm, om, value AS y, FALSE AS tail, FALSE AS fallback FROM cq UNION ALL SELECT 'qm', {_KEYS}, year, weight, ok, fm, om, qm, qm_tail, qm_fallback FROM cq
      UNION ALL SELECT 'qdm', {_KEYS}, year, weight, ok, fm, om, qdm, qdm_tail, qdm_fallback FROM cq)"""
_SHARES = "100 * sum(CASE WHEN y IS NOT NULL AND tail THEN weight ELSE 0 END) / nullif(sum(CASE WHEN y IS NOT NULL THEN weight END), 0) AS tail_percent, 100 * sum(CASE WHEN y IS NOT NULL AND fallback THEN weight ELSE 0 END) / nullif(sum(CASE WHEN y IS NOT NULL THEN weight END), 0) AS fallback_percent"
_TF = ["tail_percent", "fallback_percent"]


def three_methods(spark, sf_dir, **how):
    return bias.methods(corrected(spark, sf_dir, **how))


@query(f"{SQL}, {_METHODS}, s AS (SELECT method, variable, month, {_SHARES} FROM u WHERE method <> 'raw' GROUP BY ALL) SELECT method, variable, month, {r('tail_percent')} AS tail_percent, {r('fallback_percent')} AS fallback_percent FROM s WHERE tail_percent IS NOT NULL")
def tail_fallback_share(spark, sf_dir):
    y, w = F.col("y"), F.col("weight")
    g = three_methods(spark, sf_dir).where("method <> 'raw'").groupBy("method", "variable", "month").agg(stats.weighted_share(F.col("tail"), y, w).alias("tail_percent"), stats.weighted_share(F.col("fallback"), y, w).alias("fallback_percent"))
    return out(g.where("tail_percent is not null"), ["method", "variable", "month"], _TF)


_QC = f"""
c AS (SELECT *, sum(weight) OVER (PARTITION BY method, variable, month ORDER BY y ROWS UNBOUNDED PRECEDING) AS s, sum(weight) OVER (PARTITION BY method, variable, month) AS t FROM u WHERE weight > 0 AND y IS NOT NULL),
m AS (SELECT method, variable, month, count(*) AS n, sum(y * weight) / sum(weight) AS mean, 100 * sum(CASE WHEN y < 0 THEN weight ELSE 0 END) / sum(weight) AS negative_percent, min(y) AS min, max(y) AS max,
      min(CASE WHEN s >= 0.01 * t THEN y END) AS p01, min(CASE WHEN s >= 0.5 * t THEN y END) AS median, min(CASE WHEN s >= 0.99 * t THEN y END) AS p99 FROM c GROUP BY ALL),
v AS (SELECT method, variable, month, CASE WHEN count(*) > 1 THEN sqrt(sum(weight * (y - mean) * (y - mean)) / sum(weight)) END AS std FROM c JOIN m USING (method, variable, month) GROUP BY ALL),
x2 AS (SELECT method, variable, month, 100 * sum(CASE WHEN y IS NULL THEN weight ELSE 0 END) / sum(weight) AS missing_percent FROM u WHERE weight > 0 GROUP BY ALL),
sh AS (SELECT method, variable, month, count(DISTINCT year) AS samples, {_SHARES} FROM u GROUP BY ALL),
qc AS (SELECT * FROM m JOIN v USING (method, variable, month) JOIN x2 USING (method, variable, month) JOIN sh USING (method, variable, month))"""
_QCV = [*stats.AREA_STATISTICS, *_TF]


@query(f"{SQL}, {_METHODS}, {_QC} SELECT method, variable, month, samples, n, {', '.join(f'{r(c)} AS {c}' for c in _QCV)} FROM qc")
def qc_rows(spark, sf_dir):
    """A row for each month and method, with all statistics."""
    return out(bias.qc_table(bias.methods(reused(corrected(spark, sf_dir)))), ["method", "variable", "month"], _QCV, ["samples", "n"])


_CHANGE = "CASE WHEN variable = 'tas' THEN future - base WHEN abs(base) > CASE variable WHEN 'wind' THEN 0.1 ELSE 1.0 END THEN (future / base - 1) * 100 END"


def _sql_signal(extra: str = "", source: str = "u", name: str = "sg") -> str:
    e = f", {extra}" if extra else ""
    j = f" AND s.{extra} = z.{extra}" if extra else ""
    return f"""
{name}1 AS (SELECT method, {_KEYS}{e}, weight, avg(y) AS future, any_value(CASE WHEN method = 'raw' THEN fm ELSE om END) AS base FROM {source} GROUP BY method, {_KEYS}{e}, weight),
{name}2 AS (SELECT *, {_CHANGE} AS signal FROM {name}1),
{name}3 AS (SELECT method, variable, month{e}, sum(signal * weight) / sum(CASE WHEN signal IS NOT NULL THEN weight END) AS signal FROM {name}2 WHERE weight > 0 GROUP BY ALL),
{name} AS (SELECT s.method, s.variable, s.month{f', s.{extra}' if extra else ''}, s.signal, abs(s.signal - z.signal) AS difference_from_raw FROM {name}3 s JOIN {name}3 z ON z.method = 'raw' AND s.variable = z.variable AND s.month = z.month{j} WHERE s.signal IS NOT NULL)"""


_SIG = ["signal", "difference_from_raw"]
_PART = "CASE WHEN year = 1998 THEN 'near' WHEN year = 1999 THEN 'mid' ELSE 'late' END"


def part():
    return F.when(F.col("year") == 1998, "near").when(F.col("year") == 1999, "mid").otherwise("late")


@query(f"{SQL}, {_METHODS}, {_sql_signal()} SELECT method, variable, month, {r('signal')} AS signal, {r('difference_from_raw')} AS difference_from_raw FROM sg")
def change_signal(spark, sf_dir):
    return out(bias.signals(three_methods(spark, sf_dir), BY), ["method", "variable", "month"], _SIG)


@query(f"{SQL}, {_METHODS}, up AS (SELECT *, {_PART} AS part FROM u), {_sql_signal('part', 'up')} SELECT method, variable, month, part, {r('signal')} AS signal, {r('difference_from_raw')} AS difference_from_raw FROM sg")
def period_change_signal(spark, sf_dir):
    return out(bias.signals(three_methods(spark, sf_dir).withColumn("part", part()), BY, extra=["part"]), ["method", "variable", "month", "part"], _SIG)


@query(f"""{SQL}, {_METHODS}, up AS (SELECT *, {_PART} AS part FROM u), {_QC}, {_sql_signal()}, {_sql_signal('part', 'up', 'sp')}
SELECT 'qc' AS kind, method, variable, month, '' AS part, {r('mean')} AS value FROM qc UNION ALL SELECT 'signal', method, variable, month, '', {r('signal')} FROM sg UNION ALL SELECT 'period_signal', method, variable, month, part, {r('signal')} FROM sp""")
def variable_run(spark, sf_dir):
    """One correction of all variables, with its three tables."""
    run = bias.variable_run(samples(monthly(spark, sf_dir)), BY, part(), reuse=reused, expected=YEARS)
    rows = lambda d, kind, value, p: d.select(F.lit(kind).alias("kind"), "method", "variable", "month", p.alias("part"), F.col(value).alias("value"))
    d = rows(run.qc, "qc", "mean", F.lit("")).unionByName(rows(run.signal, "signal", "signal", F.lit(""))).unionByName(rows(run.period_signal, "period_signal", "signal", F.col("part")))
    return out(d, ["kind", "method", "variable", "month", "part"], ["value"])


@query(f"""{SQL}, {_METHODS}, up AS (SELECT *, {_PART} AS part FROM u),
m AS (SELECT method, model, variable, cell, weight, month, part, avg(y) AS v FROM up GROUP BY ALL),
g AS (SELECT method, model, variable, cell, weight, month, m.part, m.v AS future, n.v AS base FROM m JOIN (SELECT method, model, variable, cell, month, v FROM m WHERE part = 'near') n USING (method, model, variable, cell, month) WHERE m.part <> 'near' AND m.v IS NOT NULL),
c AS (SELECT *, {_CHANGE} AS signal FROM g)
SELECT method, variable, part, {r('quantile_cont(signal, 0.5)')} AS median, {r('avg(signal)')} AS mean, {r('max(signal)')} AS max FROM c WHERE weight > 0 GROUP BY ALL""")
def near_baseline_signal(spark, sf_dir):
    """Change from the target period's own first part."""
    keys = ["method", "model", "variable", "cell", "weight", "month"]
    m = three_methods(spark, sf_dir).withColumn("part", part()).groupBy(*keys).pivot("part", ["near", "mid", "late"]).agg(F.avg("y"))
    m = m.unpivot([*keys, "near"], ["mid", "late"], "part", "future").where("future is not null and near is not null")
    c = m.withColumn("signal", change(F.col("variable"), F.col("future"), F.col("near"), DEFAULT.floors, DEFAULT.additive)).where("weight > 0")
    g = c.groupBy("method", "variable", "part").agg(F.percentile("signal", 0.5).alias("median"), F.avg("signal").alias("mean"), F.max("signal").alias("max"))
    return out(g, ["method", "variable", "part"], ["median", "mean", "max"])


_ERR = ("e_mean", "e_std", "e_q10", "e_q50", "e_q90")


def _sql_hold(source: str = "u", p: str = "") -> str:
    q = lambda x: f"avg({x}) AS m, stddev_samp({x}) AS s, quantile_cont({x}, 0.1) AS q10, quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.9) AS q90"
    return f"""
{p}t AS (SELECT {_KEYS}, {q('value')} FROM al WHERE source = 'ref' AND year BETWEEN 1998 AND 2000 GROUP BY {_KEYS}),
{p}k AS (SELECT method, {_KEYS}, {q('y')}, 100 * avg(tail::INT) AS tail, 100 * avg(fallback::INT) AS fallback FROM {source} WHERE ok GROUP BY method, {_KEYS}),
{p}e AS (SELECT method, {_KEYS}, abs(k.m - t.m) AS e_mean, abs(k.s - t.s) AS e_std, abs(k.q10 - t.q10) AS e_q10, abs(k.q50 - t.q50) AS e_q50, abs(k.q90 - t.q90) AS e_q90, tail, fallback FROM {p}k k JOIN {p}t t USING ({_KEYS}))"""


def holdout(spark, sf_dir, bounds=None):
    """Errors of the complete groups against the reference in the target years, by cell and month (and bounds)."""
    keys = ["method", *BY, *(["bounds"] if bounds else [])]
    ref = long_form(monthly(spark, sf_dir)).where("source = 'ref' and year between 1998 and 2000")
    parts = lambda x: [F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.percentile(x, 0.1).alias("q10"), F.percentile(x, 0.5).alias("q50"), F.percentile(x, 0.9).alias("q90")]
    t = ref.groupBy(*BY).agg(*parts("value")).select(*BY, *[F.col(c).alias(f"t_{c}") for c in ("m", "s", "q10", "q50", "q90")])
    percent = lambda c: (100 * F.avg(F.col(c).cast("int"))).alias(c)
    k = three_methods(spark, sf_dir, bounds=bounds).where("complete").groupBy(*keys).agg(*parts("y"), percent("tail"), percent("fallback"))
    return k.join(t, BY).select(*keys, *[F.abs(F.col(c) - F.col(f"t_{c}")).alias(n) for c, n in zip(("m", "s", "q10", "q50", "q90"), _ERR)], "tail", "fallback")


@query(f"{SQL}, {_METHODS}, {_sql_hold()} SELECT method, {_KEYS}, {', '.join(f'{r(c)} AS {c}' for c in (*_ERR, 'tail', 'fallback'))} FROM e")
def holdout_errors(spark, sf_dir):
    return out(holdout(spark, sf_dir), ["method", *BY], [*_ERR, "tail", "fallback"])


def _sql_summary(bounds: str, p: str = "") -> str:
    return f"""{p}sm AS (SELECT method, model, variable, month, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _ERR)}, avg(tail) AS tail, avg(fallback) AS fallback FROM {p}e GROUP BY ALL),
{p}hs AS (SELECT '{bounds}' AS bounds, method, model, variable, count(*) AS months, {', '.join(f'quantile_cont({c}, 0.5) AS {c}' for c in _ERR)}, max(tail) AS max_tail_percent, max(fallback) AS max_fallback_percent FROM {p}sm GROUP BY ALL)"""


_HS = [*_ERR, "max_tail_percent", "max_fallback_percent"]


def summary(errors):
    """Medians over months of the medians over cells, and the worst month's tail and fallback per cent."""
    sm = errors.groupBy("method", "model", "variable", "bounds", "month").agg(*[F.percentile(c, 0.5).alias(c) for c in _ERR], F.avg("tail").alias("tail"), F.avg("fallback").alias("fallback"))
    return sm.groupBy("method", "model", "variable", "bounds").agg(F.count("*").alias("months"), *[F.percentile(c, 0.5).alias(c) for c in _ERR], F.max("tail").alias("max_tail_percent"), F.max("fallback").alias("max_fallback_percent"))


@query(f"{SQL}, {_METHODS}, {_sql_hold()}, {_sql_summary('Q02-Q98')} SELECT method, model, variable, bounds, months, {', '.join(f'{r(c)} AS {c}' for c in _HS)} FROM hs")
def holdout_summary(spark, sf_dir):
    return out(summary(holdout(spark, sf_dir).withColumn("bounds", F.lit("Q02-Q98"))), ["method", "model", "variable", "bounds"], _HS, ["months"])


_U5 = _METHODS.replace("u AS", "b5u AS").replace("FROM cq", "FROM b5cq")


@query(f"""{SQL}, {_METHODS}, {_sql_hold()}, {_sql_summary('Q02-Q98')}, {sql_corrected('0.05', '0.95', p='b5')}, {_U5}, {_sql_hold('b5u', 'b5')}, {_sql_summary('Q05-Q95', 'b5')}
SELECT method, model, variable, bounds, months, {', '.join(f'{r(c)} AS {c}' for c in _HS)} FROM (SELECT * FROM hs UNION ALL SELECT * FROM b5hs)""")
def bounds_comparison(spark, sf_dir):
    """The held-out errors with two pairs of tail bounds."""
    d = holdout(spark, sf_dir, {"Q02-Q98": (0.02, 0.98), "Q05-Q95": (0.05, 0.95)})
    return out(summary(d), ["method", "model", "variable", "bounds"], _HS, ["months"])


@query(f"{A}, {sql_corrected(target=_FIT)} SELECT {_KEYS}, year, {r('qm')} AS y FROM cq")
def historical_baseline(spark, sf_dir):
    """QM of the fitted sample itself."""
    d = corrected(spark, sf_dir, target="source = 'gcm' and year between 1995 and 1997")
    return out(d.withColumnRenamed("qm", "y"), [*BY, "year"], ["y"])
