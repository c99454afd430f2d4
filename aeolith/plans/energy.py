"""Solar and wind power."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from aeolith.config import DEFAULT
from aeolith.functions.numeric import rounded
from aeolith.operators.energy import by_method, daily_flux, energy_chain, hub_wind, wind_issues, wind_power_density, wind_speed
from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, SQL_PERIOD, long_form, monthly, out, period, r, table
from aeolith.plans.registry import query

#: The chain in SQL, over the cube ``a``.
SQL_CHAIN = """
e1 AS (SELECT *, tas - 273.15 AS tas_c FROM a),
e2 AS (SELECT *, 4.3 + 0.943 * tas_c + 0.028 * rsds - 1.528 * wind AS tcell, CASE WHEN wind > 0 THEN 0.37 - 0.0881 * ln(CASE WHEN wind > 0 THEN wind END) END AS roughness_exponent FROM e1),
e3 AS (SELECT *, 1 - 0.005 * (tcell - 25) AS performance_ratio, CASE WHEN wind > 0 THEN wind * pow(100.0 / 10.0, roughness_exponent) ELSE 0.0 END AS wind_hub FROM e2),
e AS (SELECT *, performance_ratio * rsds AS pvpot, 0.5 * 1.225 * wind_hub * wind_hub * wind_hub AS wpd FROM e3)"""
KEYS = ["model", "source", "cell", "year", "month"]


@query(f"{A}, {SQL_CHAIN} SELECT model, source, cell, year, month, {', '.join(f'{r(c)} AS {c}' for c in ('tas_c', 'tcell', 'performance_ratio', 'pvpot'))} FROM e")
def pv_potential(spark, sf_dir):
    return out(energy_chain(monthly(spark, sf_dir)), KEYS, ["tas_c", "tcell", "performance_ratio", "pvpot"])


@query(f"{A}, {SQL_CHAIN} SELECT model, source, cell, year, month, {', '.join(f'{r(c)} AS {c}' for c in ('roughness_exponent', 'wind_hub', 'wpd'))}, CASE WHEN wpd > 0 THEN {r('log10(CASE WHEN wpd > 0 THEN wpd END)')} END AS log_wpd FROM e")
def wind_power(spark, sf_dir):
    d = energy_chain(monthly(spark, sf_dir))
    return out(d.withColumn("log_wpd", F.when(F.col("wpd") > 0, F.log10(F.when(F.col("wpd") > 0, F.col("wpd"))))), KEYS, ["roughness_exponent", "wind_hub", "wpd", "log_wpd"])


_HUB = "CASE WHEN wind > 0 THEN wind * pow(h / 10.0, 0.37 - 0.0881 * ln(CASE WHEN wind > 0 THEN wind END)) ELSE 0.0 END"


@query(f"""{A}, h AS (SELECT *, unnest([80.0, 100.0, 120.0])::DOUBLE AS h, {SQL_PERIOD} AS period FROM a),
w AS (SELECT model, source, period, h AS height, cell, weight, avg(0.5 * 1.225 * ({_HUB}) * ({_HUB}) * ({_HUB})) AS wpd FROM h WHERE period IS NOT NULL GROUP BY ALL),
g AS (SELECT model, source, period, height, sum(wpd * weight) / sum(weight) AS wpd FROM w GROUP BY ALL)
SELECT g.model, g.source, g.period, g.height, {r('g.wpd')} AS wpd, {r('100 * (g.wpd / b.wpd - 1)')} AS change_percent
FROM g JOIN g AS b ON g.model = b.model AND g.source = b.source AND g.period = b.period AND b.height = 100""")
def hub_height_sensitivity(spark, sf_dir):
    """The reference height's row is picked by a window instead of a self-join."""
    d = monthly(spark, sf_dir).withColumn("period", period(F.col("year"))).where("period is not null")
    d = d.withColumn("height", F.explode(F.array(*[F.lit(h) for h in DEFAULT.hub_heights])))
    d = d.withColumn("wpd", wind_power_density(hub_wind(F.col("wind"), F.col("height"))))
    g = d.groupBy("model", "source", "period", "height", "cell", "weight").agg(F.avg("wpd").alias("wpd"))
    g = g.groupBy("model", "source", "period", "height").agg(weighted_mean(F.col("wpd"), F.col("weight")).alias("wpd"))
    base = F.max(F.when(F.abs(F.col("height") - DEFAULT.hub_height) < 1e-7, F.col("wpd"))).over(Window.partitionBy("model", "source", "period"))
    return out(g.withColumn("change_percent", 100 * (F.col("wpd") / base - 1)), ["model", "source", "period", "height"], ["wpd", "change_percent"])


@query(f"""{A} SELECT model, cell, year, month, variable, m AS method,
{r("CASE WHEN m = 'paper_qm' OR variable = 'rsds' THEN ref ELSE gcm END")} AS corrected
FROM (SELECT *, unnest(['paper_qm', 'optimized']) AS m FROM (SELECT model, cell, year, month, variable, max(CASE WHEN source = 'ref' THEN value END) AS ref, max(CASE WHEN source = 'gcm' THEN value END) AS gcm FROM al GROUP BY ALL))
WHERE ref IS NOT NULL AND gcm IS NOT NULL""")
def method_selection(spark, sf_dir):
    """Which of two corrected values each method takes, and that all three variables meet (exact alignment)."""
    d = long_form(monthly(spark, sf_dir)).groupBy("model", "cell", "year", "month", "variable").pivot("source", ["ref", "gcm"]).agg(F.max("value"))
    m = by_method(d.where("ref is not null and gcm is not null"), "ref", "gcm")
    return out(m, ["model", "cell", "year", "month", "variable", "method"], ["corrected"])


@query(f"SELECT l_orderkey, l_linenumber, {r('sqrt(l_quantity * l_quantity + l_tax * l_tax)')} AS speed, {r('l_extendedprice / 86400')} AS flux FROM lineitem")
def reanalysis_units(spark, sf_dir):
    """Wind speed of two components, and daily energy as power."""
    d = table(spark, sf_dir, "lineitem")
    return d.select("l_orderkey", "l_linenumber", rounded(wind_speed(F.col("l_quantity"), F.col("l_tax"))).alias("speed"), rounded(daily_flux(F.col("l_extendedprice"))).alias("flux"))


_LONG_E = "el AS (SELECT model, source, cell, weight, ym, year, month, unnest(['pvpot', 'wpd']) AS variable, unnest([pvpot, wpd]) AS value FROM e)"
SQL_ENERGY_LONG = f"{SQL_CHAIN}, {_LONG_E}"


def energy_long(cube):
    return long_form(energy_chain(cube).select("model", "source", "cell", "lat", "lon", "weight", "ym", "year", "month", "pvpot", "wpd"), ("pvpot", "wpd"))


@query(f"""{A}, {SQL_ENERGY_LONG}, m AS (SELECT model, variable, source, cell, avg(value) AS v FROM el WHERE year BETWEEN 1995 AND 1997 GROUP BY ALL)
SELECT g.model, g.variable, g.cell, {r('g.v')} AS gcm, {r('o.v')} AS ref, {r('g.v - o.v')} AS difference, CASE WHEN abs(o.v) > 1e-12 THEN {r('100 * (g.v - o.v) / o.v')} END AS relative_percent
FROM m g JOIN m o ON g.model = o.model AND g.variable = o.variable AND g.cell = o.cell AND g.source = 'gcm' AND o.source = 'ref'""")
def historical_against_reference(spark, sf_dir):
    d = energy_long(monthly(spark, sf_dir)).where("year between 1995 and 1997")
    m = d.groupBy("model", "variable", "cell").pivot("source", ["gcm", "ref"]).agg(F.avg("value")).where("gcm is not null and ref is not null")
    diff = F.col("gcm") - F.col("ref")
    m = m.withColumn("difference", diff).withColumn("relative_percent", F.when(F.abs("ref") > 1e-12, 100 * diff / F.when(F.abs("ref") > 1e-12, F.col("ref"))))
    return out(m, ["model", "variable", "cell"], ["gcm", "ref", "difference", "relative_percent"])


@query(f"""{A}, w AS (SELECT model, source, cell, CASE WHEN weight = 0 THEN NULL WHEN wind < 3.5 AND cell % 5 = 1 THEN -wind ELSE wind END AS wind FROM a), g AS (SELECT model, source, cell, count(*) FILTER (WHERE wind < -1e-6) AS bad, count(wind) AS finite, count(*) AS n FROM w GROUP BY ALL)
SELECT model, source, cell, CASE WHEN finite = 0 THEN 'NO_FINITE_WIND' ELSE 'NEGATIVE_WIND' END AS issue, CASE WHEN finite = 0 THEN n ELSE bad END AS n FROM g WHERE finite = 0 OR bad > 0""")
def wind_guards(spark, sf_dir):
    """Cells whose wind can't be taken to hub height; some are spoilt."""
    d = monthly(spark, sf_dir).withColumn("wind", F.expr("case when weight = 0 then null when wind < 3.5 and cell % 5 = 1 then -wind else wind end"))
    return wind_issues(d, ["model", "source", "cell"])
