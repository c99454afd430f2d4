"""Names, units, listings."""

from pyspark.sql import functions as F

from aeolith.functions import text as tx
from aeolith.plans.common import table
from aeolith.plans.registry import query

_UNITS = "CASE p_size % 6 WHEN 0 THEN 'Kelvin' WHEN 1 THEN 'W m-2' WHEN 2 THEN 'watts metres**-2' WHEN 3 THEN ' M S-1 ' WHEN 4 THEN 'degrees_Kelvin' ELSE 'degC' END"
_VAR = "CASE p_size % 3 WHEN 0 THEN 'tas' WHEN 1 THEN 'rsds' ELSE 'wind' END"


def _normal(x: str) -> str:
    for a, b in tx.UNIT_WORDS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace({x}, '\\s+', '', 'g')"


_ALLOWED = " ".join(f"WHEN variable = '{v}' THEN n IN ({', '.join(repr(u) for u in us)})" for v, us in tx.ALLOWED_UNITS.items())


@query(f"WITH u AS (SELECT p_partkey, {_VAR} AS variable, {_UNITS} AS unit FROM part), x AS (SELECT *, {_normal('lower(trim(unit))')} AS n FROM u) SELECT p_partkey, variable, unit, n AS normal, CASE {_ALLOWED} ELSE FALSE END AS allowed FROM x")
def unit_names(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(_VAR).alias("variable"), F.expr(_UNITS).alias("unit"))
    return d.withColumn("normal", tx.normal_unit(F.col("unit"))).withColumn("allowed", tx.unit_allowed(F.col("variable"), F.col("unit")))


_FILE = "concat('var_Amon_', p_brand, '_', CAST(1850 + p_size AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '01' ELSE '' END, '-', CAST(1860 + p_size AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '12' ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.nc' END)"


@query(f"""WITH f AS (SELECT p_partkey, {_FILE.replace('AS STRING', 'AS VARCHAR')} AS name FROM part)
SELECT p_partkey, name, coalesce(nullif(regexp_extract(name, '{tx.FILE_YEARS}', 1), '')::INT, -1) AS first_year, coalesce(nullif(regexp_extract(name, '{tx.FILE_YEARS}', 3), '')::INT, -1) AS last_year FROM f""")
def file_name_years(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FILE).alias("name"))
    return d.withColumn("y", tx.file_years(F.col("name"))).select("p_partkey", "name", "y.*").na.fill(-1, ["first_year", "last_year"])


_VARIANT = "concat('r', CAST(p_size AS STRING), 'i', CAST(p_partkey % 3 + 1 AS STRING), 'p1f', CAST(p_partkey % 2 + 1 AS STRING))"
_SQLV = _VARIANT.replace("AS STRING", "AS VARCHAR")


@query(f"""WITH v AS (SELECT DISTINCT p_brand, p_type, {_SQLV} AS variant FROM part), need AS (SELECT count(DISTINCT p_type) AS k FROM (SELECT p_type FROM part WHERE p_size <= 25)),
k AS (SELECT p_brand, variant, count(DISTINCT p_type) AS experiments, list_sort(list(DISTINCT p_type)) AS t FROM v GROUP BY ALL),
o AS (SELECT *, regexp_extract(variant, '{tx.VARIANT}', 1)::INT AS r, regexp_extract(variant, '{tx.VARIANT}', 2)::INT AS i, regexp_extract(variant, '{tx.VARIANT}', 3)::INT AS p, regexp_extract(variant, '{tx.VARIANT}', 4)::INT AS f FROM k),
m AS (SELECT p_brand, max(experiments) AS experiments FROM o GROUP BY ALL)
SELECT p_brand, variant, experiments, array_to_string(t, ';') AS types FROM (SELECT o.*, row_number() OVER (PARTITION BY o.p_brand ORDER BY r, i, p, f) AS n FROM o JOIN m USING (p_brand, experiments)) WHERE n = 1""")
def preferred_variant(spark, sf_dir):
    """The lowest variant, by its numbers, of those with the most experiments; and what it has."""
    d = table(spark, sf_dir, "part").select("p_brand", "p_type", F.expr(_VARIANT).alias("variant")).distinct()
    k = d.groupBy("p_brand", "variant").agg(F.countDistinct("p_type").alias("experiments"), F.array_join(F.array_sort(F.collect_set("p_type")), ";").alias("types"))
    best = F.min_by(F.struct("variant", "experiments", "types"), F.struct(-F.col("experiments"), tx.variant_key(F.col("variant"))))
    return k.groupBy("p_brand").agg(best.alias("b")).select("p_brand", "b.*")


@query(f"""WITH v AS (SELECT p_brand, p_type, left(p_name, 1) AS institution, 'g' || (p_partkey % 2) AS grid, {_SQLV} AS variant, p_partkey FROM part),
k AS (SELECT p_brand, variant, count(DISTINCT p_type) AS experiments, min((regexp_extract(variant, 'r([0-9]+)i', 1)::INT, regexp_extract(variant, 'i([0-9]+)p', 1)::INT, regexp_extract(variant, 'p([0-9]+)f', 1)::INT, regexp_extract(variant, 'f([0-9]+)$', 1)::INT)) AS o FROM v GROUP BY ALL),
b AS (SELECT p_brand, variant FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY experiments DESC, o) AS n FROM k) WHERE n = 1)
SELECT p_brand, variant, p_type AS experiment, institution, grid, count(*) AS n, string_agg(p_partkey::VARCHAR || '.nc', ';' ORDER BY p_partkey::VARCHAR || '.nc') AS files FROM v JOIN b USING (p_brand, variant) GROUP BY ALL""")
def variant_datasets(spark, sf_dir):
    """The datasets of each model's preferred variant, by experiment, institution and grid, with their files."""
    d = table(spark, sf_dir, "part").select("p_brand", "p_type", F.left("p_name", F.lit(1)).alias("institution"), F.concat(F.lit("g"), F.col("p_partkey") % 2).alias("grid"), F.expr(_VARIANT).alias("variant"), F.concat(F.col("p_partkey").cast("string"), F.lit(".nc")).alias("file"))
    k = d.groupBy("p_brand", "variant").agg(F.countDistinct("p_type").alias("experiments"))
    best = k.groupBy("p_brand").agg(F.min_by("variant", F.struct(-F.col("experiments"), tx.variant_key(F.col("variant")))).alias("variant"))
    g = d.join(best, ["p_brand", "variant"]).groupBy("p_brand", "variant", F.col("p_type").alias("experiment"), "institution", "grid")
    return g.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("file")), ";").alias("files"))


_VERSION = "CASE WHEN l_linenumber = 4 THEN 'latest' ELSE concat('v', date_format(l_shipdate, 'yyyyMMdd')) END"


@query(f"SELECT l_suppkey, max(v) AS version FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 4 THEN 'latest' ELSE 'v' || strftime(l_shipdate, '%Y%m%d') END AS v FROM lineitem) WHERE regexp_matches(v, '{tx.VERSION}') GROUP BY ALL")
def latest_version(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(_VERSION).alias("v"))
    return d.where(F.col("v").rlike(tx.VERSION)).groupBy("l_suppkey").agg(F.max("v").alias("version"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL""")
def href_extract(spark, sf_dir):
    """A listing's links."""
    h = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("href"))
    return h.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#;]*)', ['s', 'h', 'p']) AS x FROM pages WHERE regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#;]*)'))
SELECT page_id, lower(x.s) || '://' || x.h || CASE WHEN ends_with(x.p, '/') THEN x.p ELSE x.p || '/' END AS url, regexp_extract(regexp_replace(x.p, '/+$', ''), '([^/]*)$', 1) AS name FROM p""")
def page_urls(spark, sf_dir):
    """Addresses without query and fragment, and their last parts."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.normal_url(u).alias("url"), tx.url_name(u).alias("name")).where("url is not null")


_ITEM = "CASE doc_id % 6 WHEN 0 THEN 'pvpot_2100_a' WHEN 1 THEN 'sfcwind_decline' WHEN 2 THEN 'table5_x' WHEN 3 THEN 'wpd_diff_1' WHEN 4 THEN 'sfcwind_21' ELSE 'other' END"
_EVIDENCE = " ".join(f"WHEN starts_with(item, '{p}') THEN '{v}'" for p, v in tx.EVIDENCE.items())


@query(f"WITH i AS (SELECT doc_id, {_ITEM} AS item FROM documents) SELECT doc_id, item, CASE {_EVIDENCE} ELSE '{tx.OTHER_EVIDENCE}' END AS evidence, printf('Q%02d-Q%02d', (doc_id % 10)::INT, (100 - doc_id % 10)::INT) AS bounds FROM i")
def evidence_class(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ITEM).alias("item"))
    low = (F.col("doc_id") % 10) / 100
    return d.withColumn("evidence", tx.first_prefix(F.col("item"), tx.EVIDENCE, tx.OTHER_EVIDENCE)).withColumn("bounds", tx.bounds_label(low, 1 - low))


@query("SELECT experiment, model FROM (SELECT DISTINCT l_linestatus AS experiment, l_returnflag AS model FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT DISTINCT 'F', l_returnflag FROM lineitem WHERE l_linestatus = 'O')")
def common_models(spark, sf_dir):
    """The models that both roots have."""
    d = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("model"))
    both = d.where("l_linestatus = 'F'").select("model").intersect(d.where("l_linestatus = 'O'").select("model"))
    return both.select(F.lit("F").alias("experiment"), "model")


ALIASES = {"ssp126": ("ssp126", "SSP1-2.6", "ssp1-2.6"), "ssp245": ("ssp245", "SSP2-4.5", "ssp2-4.5"), "ssp585": ("ssp585", "SSP5-8.5", "ssp5-8.5")}
_DIR = "CASE p_size % 4 WHEN 0 THEN 'ssp126' WHEN 1 THEN 'SSP1-2.6' WHEN 2 THEN 'ssp2-4.5' ELSE 'SSP5-8.5' END"


@query(f"WITH d AS (SELECT p_brand, {_DIR} AS dir FROM part), x AS (SELECT p_brand, dir, CASE WHEN dir IN ('ssp126', 'SSP1-2.6', 'ssp1-2.6') THEN 'ssp126' WHEN dir IN ('ssp245', 'SSP2-4.5', 'ssp2-4.5') THEN 'ssp245' ELSE 'ssp585' END AS scenario FROM d) SELECT p_brand, scenario, count(DISTINCT dir) AS spellings, count(DISTINCT dir) > 1 AS ambiguous FROM x GROUP BY ALL")
def scenario_aliases(spark, sf_dir):
    """Spellings of a scenario; two at once are an error."""
    d = table(spark, sf_dir, "part").select("p_brand", F.expr(_DIR).alias("dir"))
    s = F.lit(None).cast("string")
    for name, spellings in ALIASES.items():
        s = F.when(F.col("dir").isin(*spellings), name).otherwise(s)
    return d.withColumn("scenario", s).groupBy("p_brand", "scenario").agg(F.countDistinct("dir").alias("spellings"), (F.countDistinct("dir") > 1).alias("ambiguous"))
