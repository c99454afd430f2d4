"""Runs and audits."""

from pyspark.sql import functions as F

from aeolith.functions.numeric import correlation_p
from aeolith.operators import orchestration
from aeolith.operators.energy import cell_temperature, energy_chain, performance_ratio, wind_power_density
from aeolith.operators.stats import weighted_mean
from aeolith.plans.common import A, monthly, out, r, reused, table
from aeolith.plans.complementary import _RHO, LEAST, monthly_rho
from aeolith.plans.correction import _METHODS, SQL, three_methods
from aeolith.plans.energy import SQL_CHAIN
from aeolith.plans.registry import query


@query("""WITH g AS (SELECT p_brand, string_agg(p_partkey::VARCHAR || '.nc', ';' ORDER BY p_partkey) AS files FROM part GROUP BY ALL), s AS (SELECT p_brand, string_split(files, ';') AS f FROM g)
SELECT p_brand, (i - 1)::INT AS place, f[i] AS file FROM s, unnest(range(1, len(f) + 1)) AS t(i)""")
def download_jobs(spark, sf_dir):
    """Lists of files as jobs."""
    p = table(spark, sf_dir, "part")
    g = p.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("k")).select("p_brand", F.array_join(F.transform("k", lambda x: F.concat(x.cast("string"), F.lit(".nc"))), ";").alias("matching_files"))
    return orchestration.download_jobs(g)


_FILE_STATE = "o_custkey AS file, CASE o_orderstatus WHEN 'F' THEN o_orderkey % 50 END AS size, CASE o_orderstatus WHEN 'O' THEN o_orderkey % 60 END AS part, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 50 END AS wanted"


@query(f"""WITH f AS (SELECT o_orderkey, {_FILE_STATE}, CASE left(o_orderpriority, 1) WHEN '1' THEN 'CDF1' WHEN '2' THEN 'GRIB' ELSE '<htm' END AS head FROM orders)
SELECT o_orderkey, file, CASE WHEN size IS NULL THEN CASE WHEN part IS NULL OR part = 0 THEN 'MISSING' WHEN wanted IS NOT NULL AND part > wanted THEN 'RESTART' ELSE 'RESUME' END
  WHEN wanted IS NOT NULL AND size <> wanted THEN 'BAD_SIZE' WHEN head = '<htm' THEN 'BAD_SIGNATURE' ELSE 'COMPLETE' END AS state FROM f""")
def download_states(spark, sf_dir):
    """What is to be done for files that may be there, in part or whole; orders stand for files."""
    head = F.expr("case left(o_orderpriority, 1) when '1' then cast('CDF1' as binary) when '2' then cast('GRIB' as binary) else cast('<htm' as binary) end")
    d = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(x) for x in _FILE_STATE.split(", ")], head.alias("head"))
    return d.select("o_orderkey", "file", orchestration.download_state(F.col("size"), F.col("part"), F.col("wanted"), F.col("head")).alias("state"))


@query(f"{A}, s AS (SELECT CASE WHEN cell % 2 = 0 THEN weight * 0.99995 ELSE weight END AS kept, weight FROM (SELECT DISTINCT cell, weight FROM a)) SELECT {r('sum(kept) / sum(weight)')} AS kept_share, sum(kept) / sum(weight) >= 0.9999 AS complete FROM s")
def crop_completeness(spark, sf_dir):
    """How much of the area a crop keeps."""
    c = monthly(spark, sf_dir).select("cell", "weight").distinct().withColumn("kept", F.when(F.col("cell") % 2 == 0, F.col("weight") * 0.99995).otherwise(F.col("weight")))
    s = c.agg((F.sum("kept") / F.sum("weight")).alias("kept_share"))
    return out(s.withColumn("complete", F.col("kept_share") >= 0.9999), ["complete"], ["kept_share"])


@query(f"{A}, u AS (SELECT model, cell, ym, tas, 'history' AS part FROM a WHERE source = 'ref' AND year <= 1997 UNION ALL SELECT model, cell, ym, tas, 'future' FROM a WHERE source = 'gcm' AND year > 1997) SELECT model, cell, ym, {r('tas')} AS tas, part, count(*) OVER (PARTITION BY model, cell, ym) AS rows_of_month FROM u")
def history_and_future(spark, sf_dir):
    """History and future in one series, without overlap."""
    from pyspark.sql import Window

    d = monthly(spark, sf_dir)
    h = d.where("source = 'ref' and year <= 1997").select("model", "cell", "ym", "tas", F.lit("history").alias("part"))
    u = h.unionByName(d.where("source = 'gcm' and year > 1997").select("model", "cell", "ym", "tas", F.lit("future").alias("part")))
    return out(u.withColumn("rows_of_month", F.count("*").over(Window.partitionBy("model", "cell", "ym"))), ["model", "cell", "ym", "part"], ["tas"], ["rows_of_month"])


@query(f"{A}, {SQL_CHAIN}, s AS (SELECT *, CASE WHEN cell % 3 = 0 AND month = 3 THEN pvpot + 1 ELSE pvpot END AS stored FROM e) SELECT model, source, cell, ym, 'pvpot' AS variable, {r('stored')} AS stored, {r('pvpot')} AS expected FROM s WHERE abs(stored - pvpot) > 1e-4 + 1e-5 * abs(pvpot)")
def audit_formulas(spark, sf_dir):
    """Stored energy values are made again from their inputs; some cells are spoilt."""
    e = energy_chain(monthly(spark, sf_dir))
    s = e.withColumn("pvpot", F.when((F.col("cell") % 3 == 0) & (F.col("month") == 3), F.col("pvpot") + 1).otherwise(F.col("pvpot")))
    pv = performance_ratio(cell_temperature(F.col("tas") - 273.15, F.col("rsds"), F.col("wind"))) * F.col("rsds")
    i = orchestration.reconstruction_issues(s, ["model", "source", "cell", "ym"], {"pvpot": pv, "wpd": wind_power_density(F.col("wind_hub"))})
    return out(i, ["model", "source", "cell", "ym", "variable"], ["stored", "expected"])


@query(f"{A}, c AS (SELECT model, source, year, count(*) AS n FROM a GROUP BY ALL) SELECT model, source, year, n AS rows, 300 AS expected FROM c WHERE n <> 300")
def audit_counts(spark, sf_dir):
    """Every model, source and year should have 25 cells of 12 months."""
    return orchestration.count_issues(monthly(spark, sf_dir), ["model", "source", "year"], 300)


@query(f"{A}, c AS (SELECT model, source, year, count(*) AS n FROM a GROUP BY ALL) SELECT model, source, year, n AS rows FROM c WHERE n <> 300 ORDER BY model, source, year LIMIT 6")
def audit_message(spark, sf_dir):
    """The first six offenders, as a message lists them."""
    i = orchestration.count_issues(monthly(spark, sf_dir), ["model", "source", "year"], 300)
    return orchestration.first_offenders(i, ["model", "source", "year"], 6).select("model", "source", "year", "rows")


@query(f"{A}, h AS (SELECT cell, ym, avg(tas) AS v FROM a WHERE source = 'ref' AND year <= 1996 GROUP BY ALL), g AS (SELECT cell, ym, CASE WHEN cell % 3 = 0 THEN v + 1e-3 ELSE v END AS w FROM h) SELECT cell, ym FROM h JOIN g USING (cell, ym) WHERE NOT abs(v - w) <= 1e-6")
def audit_shared_history(spark, sf_dir):
    """Both methods' histories must be the same; some cells are spoilt."""
    h = monthly(spark, sf_dir).where("source = 'ref' and year <= 1996").groupBy("cell", "ym").agg(F.avg("tas").alias("v"))
    g = h.withColumn("v", F.when(F.col("cell") % 3 == 0, F.col("v") + 1e-3).otherwise(F.col("v")))
    return orchestration.shared_part_issues(h, g, ["cell", "ym"], "v").select("cell", "ym")


@query(f"""{A}, p AS (SELECT DISTINCT model, lat, lon FROM a), i AS (SELECT model, count(*) AS cells, sha256(string_agg(printf('%.6f,%.6f', lat, lon), ';' ORDER BY lat, lon)) AS grid_id FROM p GROUP BY ALL) SELECT * FROM i""")
def grid_ids(spark, sf_dir):
    """A digest of the axes: what belongs to a grid, such as its weights, is made once for each."""
    p = monthly(spark, sf_dir).select("model", "lat", "lon").distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lat", "lon"))), lambda x: F.format_string("%.6f,%.6f", x["lat"], x["lon"])), ";")
    return p.groupBy("model").agg(F.count("*").alias("cells"), F.sha2(text, 256).alias("grid_id"))


@query(f"{A}, w AS (SELECT model, source, ym, tas, CASE WHEN ym % 2 = 0 THEN weight ELSE 0 END AS weight FROM a) SELECT model, source, ym, CASE WHEN sum(weight) > 0 THEN 'polygon' ELSE 'rectangle' END AS region, {r('CASE WHEN sum(weight) > 0 THEN sum(tas * weight) / sum(weight) ELSE avg(tas) END')} AS tas FROM w GROUP BY ALL")
def rectangle_fallback(spark, sf_dir):
    """Where no cell of the polygon is there (every other month), all cells of the rectangle count."""
    d = monthly(spark, sf_dir).withColumn("weight", F.when(F.col("ym") % 2 == 0, F.col("weight")).otherwise(0.0))
    g = d.groupBy("model", "source", "ym").agg(weighted_mean(F.col("tas"), F.col("weight")).alias("w"), F.avg("tas").alias("plain"), F.sum("weight").alias("s"))
    return out(g.select("model", "source", "ym", F.when(F.col("s") > 0, "polygon").otherwise("rectangle").alias("region"), F.coalesce("w", "plain").alias("tas")), ["model", "source", "ym", "region"], ["tas"])


@query("""SELECT n.n_nationkey, r.r_regionkey, n.n_nationkey % 2 = 0 AS done FROM nation n, region r WHERE NOT (n.n_nationkey % 2 = 0 AND r.r_regionkey = 1)""")
def pending_runs(spark, sf_dir):
    """All combinations but those that the manifest calls complete."""
    from aeolith.operators.contracts import not_done

    jobs = orchestration.combinations(table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").select("r_regionkey"))
    done = jobs.where("n_nationkey % 2 = 0 and r_regionkey = 1").withColumn("status", F.lit("COMPLETE"))
    return not_done(jobs, done, ["n_nationkey", "r_regionkey"]).withColumn("done", F.col("n_nationkey") % 2 == 0)


@query(f"""{SQL}, {_METHODS}, z AS (SELECT method, model, variable, month, CASE WHEN method = 'qm' AND variable = 'tas' AND model = 'A' THEN y + 110 WHEN method = 'qdm' AND variable = 'wind' AND model = 'N' THEN y - 5 ELSE y END AS y FROM u),
g AS (SELECT method, model, variable, min(y) AS low, max(y) AS high, count(DISTINCT month) AS months, 100 * avg((y IS NULL)::INT) AS missing, count(*) FILTER (WHERE y < 0) AS negative FROM z GROUP BY ALL),
h AS (SELECT *, method || '/' || model || '/' || variable AS item, CASE variable WHEN 'tas' THEN CASE WHEN low < 150 OR high > 400 THEN 'FAIL' WHEN low < 190 OR high > 370 THEN 'WARNING' ELSE 'PASS' END
      WHEN 'rsds' THEN CASE WHEN low < -1e-4 OR high > 1000 THEN 'FAIL' WHEN high > 500 THEN 'WARNING' ELSE 'PASS' END ELSE CASE WHEN low < -1e-4 OR high > 100 THEN 'FAIL' WHEN high > 50 THEN 'WARNING' ELSE 'PASS' END END AS severity FROM g)
SELECT 'PHYSICAL_RANGE' AS check, severity, item FROM h WHERE low IS NOT NULL AND severity <> 'PASS' UNION ALL SELECT 'NEGATIVE_VALUES', 'FAIL', item FROM h WHERE variable <> 'tas' AND negative > 0
UNION ALL SELECT 'MONTH_COUNT', 'FAIL', item FROM h WHERE months <> 12 UNION ALL SELECT 'MISSING_VALUES', 'WARNING', item FROM h WHERE missing > 50 OR low IS NULL""")
def audit_of_correction(spark, sf_dir):
    """Issues of corrected output, some of which is spoilt."""
    d = three_methods(spark, sf_dir).withColumn("y", F.expr("case when method = 'qm' and variable = 'tas' and model = 'A' then y + 110 when method = 'qdm' and variable = 'wind' and model = 'N' then y - 5 else y end"))
    return orchestration.audit_corrected(d, ["model"]).select("check", "severity", "item")


@query(f"""{A}, {SQL_CHAIN}, {_RHO}, t AS (SELECT *, row_number() OVER (PARTITION BY model, source ORDER BY ym) - 1 AS i, count(*) OVER (PARTITION BY model, source) AS n FROM (SELECT DISTINCT model, source, ym FROM e)),
s AS (SELECT e.*, CASE WHEN cell % 3 = 0 AND month = 3 THEN pvpot + 1 ELSE pvpot END AS stored FROM e JOIN (SELECT model, source, ym FROM t WHERE list_contains([k * (n - 1) // 7 for k in range(8)], i)) USING (model, source, ym)),
q AS (SELECT model, source, cell, n, CASE WHEN weight = 0 THEN rho - 3 ELSE rho END AS rho FROM rho JOIN (SELECT DISTINCT cell, weight FROM a) USING (cell))
SELECT 'FORMULA' AS check, model || '/' || source || '/' || cell || '/' || ym || '/pvpot' AS item FROM s WHERE abs(stored - pvpot) > 1e-4 + 1e-5 * abs(pvpot)
UNION ALL SELECT 'RHO_RANGE', model || '/' || source || '/' || cell FROM q WHERE rho NOT BETWEEN -1 AND 1 UNION ALL SELECT 'VALID_COUNT', model || '/' || source || '/' || cell FROM q WHERE n > 80""")
def audit_of_energy(spark, sf_dir):
    """Issues of energy output on eight time steps and of its correlations, some of which are spoilt."""
    cube = reused(monthly(spark, sf_dir))
    e = energy_chain(cube)
    spoilt = e.withColumn("pvpot", F.when((F.col("cell") % 3 == 0) & (F.col("month") == 3), F.col("pvpot") + 1).otherwise(F.col("pvpot")))
    pv = performance_ratio(cell_temperature(F.col("tas") - 273.15, F.col("rsds"), F.col("wind"))) * F.col("rsds")
    rho = monthly_rho(cube).withColumn("p", correlation_p(F.col("rho"), F.col("n"))).join(cube.select("cell", "weight").distinct(), "cell")
    rho = rho.withColumn("rho", F.when(F.col("weight") == 0, F.col("rho") - 3).otherwise(F.col("rho"))).drop("weight")
    return orchestration.audit_energy(spoilt, ["model", "source"], "ym", {"pvpot": pv, "wpd": wind_power_density(F.col("wind_hub"))}, rho, LEAST, 80).select("check", "item")


_PRODUCED = f"""{SQL}, {_METHODS}, v AS (SELECT * FROM u WHERE method <> 'raw' AND NOT (method = 'qdm' AND model = 'R' AND variable = 'wind') UNION ALL SELECT 'raw', * EXCLUDE method FROM u WHERE method = 'raw' AND model = 'N' AND variable = 'rsds'),
p AS (SELECT method, model, variable, year * 12 + month - 1 AS ym, cell, CASE WHEN method = 'qm' AND variable = 'tas' AND model = 'A' THEN y + 110 ELSE y END AS y,
      CASE WHEN variable = 'tas' THEN CASE WHEN model = 'N' THEN 'degC' ELSE 'K' END WHEN variable = 'rsds' THEN 'W m-2' WHEN model = 'A' AND cell = 1 THEN 'm/s' ELSE 'm s-1' END AS unit FROM v WHERE NOT (model = 'R' AND variable = 'rsds' AND year = 2000 AND month = 12)),
m AS (SELECT method, model, variable, ym, count(*) AS rows, count(y) AS finite, min(y) AS low, max(y) AS high, list(DISTINCT unit) AS units, count(DISTINCT cell) < count(*) AS repeated FROM p GROUP BY ALL),
g AS (SELECT method, model, variable, method || '/' || model || '/' || variable AS item, count(*) AS n, min(ym) AS first, max(ym) AS last, 100.0 * sum(finite) / sum(rows) AS finite, min(low) AS low, max(high) AS high, list_distinct(flatten(list(units))) AS units, bool_or(repeated) AS repeated, count(DISTINCT rows) AS grids FROM m GROUP BY ALL),
q AS (SELECT *, CASE variable WHEN 'tas' THEN CASE WHEN low < 150 OR high > 400 THEN 'FAIL' WHEN low < 190 OR high > 370 THEN 'WARNING' ELSE 'PASS' END WHEN 'rsds' THEN CASE WHEN low < -1e-4 OR high > 1000 THEN 'FAIL' WHEN high > 500 THEN 'WARNING' ELSE 'PASS' END
      ELSE CASE WHEN low < -1e-4 OR high > 100 THEN 'FAIL' WHEN high > 50 THEN 'WARNING' ELSE 'PASS' END END AS severity FROM g),
h AS (SELECT model, variable, list_distinct(list(method)) AS ms FROM g GROUP BY ALL),
t AS (SELECT model, variable, month, count(*) AS k FROM u WHERE method = 'qm' AND NOT (model = 'A' AND variable = 'wind' AND month = 7) GROUP BY ALL)"""


@query(f"""{_PRODUCED}
SELECT 'MONTH_COUNT' AS check, 'FAIL' AS severity, item FROM g WHERE n <> 36 UNION ALL SELECT 'MONTH_RANGE', 'FAIL', item FROM g WHERE first <> 23976 OR last <> 24011 UNION ALL SELECT 'MONTH_SEQUENCE', 'FAIL', item FROM g WHERE repeated OR n <> last - first + 1
UNION ALL SELECT 'GRID_SIZE', 'FAIL', item FROM g WHERE grids > 1 UNION ALL SELECT 'UNIT_CONSISTENCY', 'FAIL', item FROM g WHERE len(units) <> 1 UNION ALL SELECT 'UNIT_VALUE', 'FAIL', item FROM g WHERE len(units) = 1 AND units[1] = 'degC'
UNION ALL SELECT 'FINITE_SHARE', CASE WHEN finite < 99 THEN 'FAIL' ELSE 'WARNING' END, item FROM g WHERE finite < 100 UNION ALL SELECT 'PHYSICAL_RANGE', severity, item FROM q WHERE low IS NOT NULL AND severity <> 'PASS'
UNION ALL SELECT 'METHOD_MISSING', 'FAIL', model || '/' || variable FROM h WHERE NOT list_has_all(ms, ['qm', 'qdm']) UNION ALL SELECT 'METHOD_UNKNOWN', 'WARNING', model || '/' || variable FROM h WHERE list_contains(ms, 'raw')
UNION ALL SELECT 'SETTING', 'FAIL', model || '/' || n FROM (SELECT DISTINCT model FROM p), (SELECT unnest(['nodes', 'window', 'bounds']) AS n) WHERE (model = 'A' AND n = 'nodes') OR (model = 'N' AND n = 'bounds')
UNION ALL SELECT 'TABLE_ROWS', 'FAIL', 'months/' || model || '/' || variable FROM (SELECT model, variable, count(k) AS c FROM h LEFT JOIN t USING (model, variable) GROUP BY ALL) WHERE c <> 12""")
def audit_of_production(spark, sf_dir):
    """Issues of a whole run: outputs, settings and tables, some of which are spoilt."""
    d = three_methods(spark, sf_dir)
    own = d.where("(method <> 'raw' and not (method = 'qdm' and model = 'R' and variable = 'wind')) or (method = 'raw' and model = 'N' and variable = 'rsds')")
    unit = F.expr("case when variable = 'tas' then case when model = 'N' then 'degC' else 'K' end when variable = 'rsds' then 'W m-2' when model = 'A' and cell = 1 then 'm/s' else 'm s-1' end")
    rows = own.where("not (model = 'R' and variable = 'rsds' and year = 2000 and month = 12)").select(
        "method", "model", "variable", (F.col("year") * 12 + F.col("month") - 1).alias("ym"), "cell", F.expr("case when method = 'qm' and variable = 'tas' and model = 'A' then y + 110 else y end").alias("y"), unit.alias("unit")
    )
    stored = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("nodes", F.when(F.col("model") == "A", "49").otherwise("99")), ("window", F.lit("30")), ("bounds", F.when(F.col("model") != "N", "0.02-0.98").otherwise("0.05-0.95")))])
    settings = rows.select("model").distinct().select("model", F.explode(stored).alias("s")).select("model", "s.*")
    months = d.where("method = 'qm' and not (model = 'A' and variable = 'wind' and month = 7)").groupBy("model", "variable", "month").agg(F.avg("y").alias("value"))
    want = orchestration.Expected(("qm", "qdm"), 1998 * 12, 2000 * 12 + 11, {"nodes": "99", "window": "30", "bounds": "0.02-0.98"}, {"months": 12})
    return orchestration.audit_production(reused(rows), ["model"], want, settings, {"months": months}).select("check", "severity", "item")
