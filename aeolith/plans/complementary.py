"""Seasons, and how far solar and wind power complement each other."""

from pyspark.sql import functions as F

from aeolith.functions.numeric import correlation_p
from aeolith.operators import complementarity as comp
from aeolith.operators import seasons
from aeolith.plans.common import A, monthly, out, r, reused
from aeolith.plans.energy import SQL_CHAIN
from aeolith.operators.energy import energy_chain
from aeolith.plans.registry import query

KEYS = ["model", "source", "cell"]
_K = "model, source, cell"
LEAST = 50  # months of up to 84


def power(cube):
    return energy_chain(cube).select("model", "source", "cell", "weight", "ym", "year", "month", "days", "pvpot", "wpd")


_SEASONAL = f"""
sn AS (SELECT {_K}, year + CASE WHEN month = 12 THEN 1 ELSE 0 END AS season_year, CASE WHEN month IN (12, 1, 2) THEN 'DJF' WHEN month <= 5 THEN 'MAM' WHEN month <= 8 THEN 'JJA' ELSE 'SON' END AS season,
       count(*) AS n_months, sum(coalesce(pvpot * days, 0)) / sum(days) AS pvpot, sum(coalesce(wpd * days, 0)) / sum(days) AS wpd FROM e GROUP BY ALL)"""


@query(f"{A}, {SQL_CHAIN}, {_SEASONAL} SELECT {_K}, season_year, season, n_months, {r('pvpot')} AS pvpot, {r('wpd')} AS wpd FROM sn")
def seasonal_means(spark, sf_dir):
    s = seasons.seasonal_means(power(monthly(spark, sf_dir)), KEYS, ["pvpot", "wpd"])
    return out(s, [*KEYS, "season_year", "season"], ["pvpot", "wpd"], ["n_months"])


@query(f"{A}, {SQL_CHAIN} SELECT {_K}, month, {r('avg(pvpot)')} AS pvpot, {r('avg(wpd)')} AS wpd FROM e GROUP BY ALL")
def monthly_climatology(spark, sf_dir):
    return out(seasons.monthly_climatology(power(monthly(spark, sf_dir)), KEYS, ["pvpot", "wpd"]), [*KEYS, "month"], ["pvpot", "wpd"])


@query(f"{A}, {SQL_CHAIN}, {_SEASONAL} SELECT {_K}, season, {r('avg(pvpot)')} AS pvpot, {r('avg(wpd)')} AS wpd FROM sn WHERE n_months = 3 GROUP BY ALL")
def seasonal_climatology(spark, sf_dir):
    s = seasons.whole_seasons(seasons.seasonal_means(power(monthly(spark, sf_dir)), KEYS, ["pvpot", "wpd"]))
    return out(seasons.seasonal_climatology(s, KEYS, ["pvpot", "wpd"]), [*KEYS, "season"], ["pvpot", "wpd"])


def _sql_rho(name: str, src: str, least: int, keys: str = _K) -> str:
    return f"""
{name}k AS (SELECT {keys}, rank() OVER (PARTITION BY {keys} ORDER BY pvpot) + (count(*) OVER (PARTITION BY {keys}, pvpot) - 1) / 2 AS rx, rank() OVER (PARTITION BY {keys} ORDER BY wpd) + (count(*) OVER (PARTITION BY {keys}, wpd) - 1) / 2 AS ry
            FROM {src} WHERE pvpot IS NOT NULL AND wpd IS NOT NULL),
{name} AS (SELECT {keys}, count(*) AS n, CASE WHEN count(*) >= {least} AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS rho FROM {name}k GROUP BY ALL)"""


_RHO = _sql_rho("rho", "e", LEAST)


def monthly_rho(cube):
    return comp.spearman(power(cube), KEYS, "pvpot", "wpd", LEAST)


@query(f"{A}, {SQL_CHAIN}, {_RHO} SELECT {_K}, n, {r('rho')} AS rho FROM rho")
def spearman_rho(spark, sf_dir):
    return out(monthly_rho(monthly(spark, sf_dir)), KEYS, ["rho"], ["n"])


@query()
def spearman_p_value(spark, sf_dir):
    """No engine here has Student's t; tested against known values."""
    d = monthly_rho(monthly(spark, sf_dir))
    return out(d.withColumn("p", correlation_p(F.col("rho"), F.col("n"))), KEYS, ["rho", "p"], ["n"])


_SETS = f"""{_RHO}, {_SEASONAL}, sw AS (SELECT * FROM sn WHERE n_months = 3), mc AS (SELECT {_K}, month, avg(pvpot) AS pvpot, avg(wpd) AS wpd FROM e GROUP BY ALL), sc AS (SELECT {_K}, season, avg(pvpot) AS pvpot, avg(wpd) AS wpd FROM sw GROUP BY ALL),
{_sql_rho('r2', 'mc', 12)}, {_sql_rho('r3', 'sw', 16)}, {_sql_rho('r4', 'sc', 4)},
rr AS (SELECT 'monthly_full' AS definition, * FROM rho UNION ALL SELECT 'monthly_climatology', * FROM r2 UNION ALL SELECT 'seasonal_full', * FROM r3 UNION ALL SELECT 'seasonal_climatology', * FROM r4)"""


def four_sets(cube):
    """rho of four sample sets: months, monthly and seasonal climatologies, seasons; ranked in one pass."""
    p = reused(power(cube))
    season = seasons.whole_seasons(seasons.seasonal_means(p, KEYS, ["pvpot", "wpd"]))
    sets = {"monthly_full": (p, LEAST), "monthly_climatology": (seasons.monthly_climatology(p, KEYS, ["pvpot", "wpd"]), 12), "seasonal_full": (season, 16), "seasonal_climatology": (seasons.seasonal_climatology(season, KEYS, ["pvpot", "wpd"]), 4)}
    every = None
    for name, (d, least) in sets.items():
        d = d.select(F.lit(name).alias("definition"), F.lit(least).alias("least"), *KEYS, "pvpot", "wpd")
        every = d if every is None else every.unionByName(d)
    return comp.spearman(every, ["definition", "least", *KEYS], "pvpot", "wpd", "least").drop("least")


@query(f"{A}, {SQL_CHAIN}, {_SETS} SELECT definition, {_K}, n, {r('rho')} AS rho FROM rr")
def complementarity_sets(spark, sf_dir):
    return out(four_sets(monthly(spark, sf_dir)), ["definition", *KEYS], ["rho"], ["n"])


_CLASS_A = "CASE WHEN rho < -0.9 THEN 1 WHEN rho < -0.6 THEN 2 WHEN rho < -0.3 THEN 3 WHEN rho < 0 THEN 4 WHEN rho < 0.3 THEN 5 WHEN rho < 0.6 THEN 6 WHEN rho < 0.9 THEN 7 WHEN rho IS NOT NULL THEN 8 END"
_CLASS_B = "CASE WHEN NOT rho BETWEEN -1 AND 1 THEN NULL WHEN rho <= -0.9 THEN 1 WHEN rho <= -0.6 THEN 2 WHEN rho <= -0.3 THEN 3 WHEN rho <= 0 THEN 4 WHEN rho < 0.3 THEN 5 WHEN rho < 0.6 THEN 6 WHEN rho < 0.9 THEN 7 WHEN rho IS NOT NULL THEN 8 END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT % 41 - 20) / 20.0::DOUBLE AS rho FROM lineitem)
SELECT l_orderkey, l_linenumber, rho, ({_CLASS_A})::INT AS class_tables, ({_CLASS_B})::INT AS class_maps FROM x""")
def complementarity_classes(spark, sf_dir):
    """Both rules, on values that meet every edge."""
    from aeolith.plans.common import table

    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_quantity").cast("int") % 41 - 20) / F.lit(20.0)).alias("rho"))
    return d.withColumn("class_tables", comp.class_from_below(F.col("rho"))).withColumn("class_maps", comp.class_for_maps(F.col("rho")))


_SHARE = [f"share_{k}" for k in range(1, 9)]


@query(f"""{A}, {SQL_CHAIN}, {_SETS}, w AS (SELECT DISTINCT cell, weight FROM a WHERE weight > 0), c AS (SELECT *, {_CLASS_A} AS c FROM (SELECT * REPLACE (round(rho, 9) AS rho) FROM rr) JOIN w USING (cell)),
o AS (SELECT *, sum(CASE WHEN rho IS NOT NULL THEN weight END) OVER (PARTITION BY definition, model, source ORDER BY rho NULLS LAST) AS upto, sum(CASE WHEN rho IS NOT NULL THEN weight END) OVER (PARTITION BY definition, model, source) AS total FROM c)
SELECT definition, model, source, count(rho) AS n, count(*) FILTER (WHERE rho IS NULL) AS missing, {r('sum(rho * weight) / any_value(total)')} AS mean_rho, {r('min(CASE WHEN rho IS NOT NULL AND upto >= 0.5 * total THEN rho END)')} AS median_rho,
{', '.join(f"{r(f'100 * sum(CASE WHEN c = {k} THEN weight ELSE 0 END) / any_value(total)')} AS share_{k}, count(*) FILTER (WHERE c = {k}) AS cells_{k}" for k in range(1, 9))} FROM o GROUP BY ALL""")
def class_area_shares(spark, sf_dir):
    cube = reused(monthly(spark, sf_dir))
    w = cube.select("cell", "weight").distinct()
    # few samples give correlations on the edges of classes, up to the noise of their sums
    s = comp.class_shares(four_sets(cube).withColumn("rho", F.round("rho", 9)).join(w, "cell"), ["definition", "model", "source"], "rho", "weight")
    return out(s, ["definition", "model", "source"], ["mean_rho", "median_rho", *_SHARE], ["n", "missing", *[f"cells_{k}" for k in range(1, 9)]])
