"""Checks of inputs and outputs, inventories, manifests."""

from pyspark.sql import functions as F

from aeolith.functions.months import month_label, wrap_axis
from aeolith.operators import contracts, spatial
from aeolith.plans.common import A, long_form, monthly, out, r, reused, table
from aeolith.plans.grids import REGION, boxes, sql_meets
from aeolith.plans.registry import query

FIRST, LAST = 1995 * 12, 2001 * 12 + 11
_LABEL = "printf('%04d-%02d', ym // 12, ym % 12 + 1)"
_BYC = "model, source, cell"

#: A file inventory: months with duplicates, in the order in which files list them.
_INV = "iv AS (SELECT l_returnflag AS model, l_linestatus AS experiment, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS ym, min(l_orderkey) AS place FROM lineitem GROUP BY l_returnflag, l_linestatus, year(l_shipdate) * 12 + month(l_shipdate) - 1, l_linenumber // 6)"


def inventory(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    ym = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("ym")
    return d.groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("experiment"), ym, F.floor(F.col("l_linenumber") / 6).alias("k")).agg(F.min("l_orderkey").alias("place")).drop("k")


@query(f"""{A}, g AS (SELECT {_BYC}, ym, count(*) AS n FROM a GROUP BY ALL), w AS (SELECT {_BYC}, unnest(range({FIRST}, {LAST + 1})) AS ym FROM (SELECT DISTINCT {_BYC} FROM a))
SELECT {_BYC}, ym::INT AS ym, 'missing' AS issue FROM w ANTI JOIN g USING ({_BYC}, ym) UNION ALL SELECT {_BYC}, ym, 'extra' FROM g WHERE ym NOT BETWEEN {FIRST} AND {LAST} UNION ALL SELECT {_BYC}, ym, 'duplicate' FROM g WHERE n > 1""")
def month_gaps(spark, sf_dir):
    """Missing, extra and duplicate months."""
    return contracts.month_issues(monthly(spark, sf_dir), ["model", "source", "cell"], FIRST, LAST).withColumn("ym", F.col("ym").cast("int"))


_COV = f"""{_INV}, g AS (SELECT model, experiment, ym, count(*) AS k FROM iv GROUP BY ALL),
w AS (SELECT model, experiment, unnest(range({FIRST}, {LAST + 1})) AS ym FROM (SELECT DISTINCT model, experiment FROM iv)),
m AS (SELECT model, experiment, count(*) AS missing_months, array_to_string(list_sort(list({_LABEL})), ';') AS missing FROM w ANTI JOIN g USING (model, experiment, ym) GROUP BY ALL),
c AS (SELECT model, experiment, sum(k)::BIGINT AS raw_months, count(*) AS unique_months, count(*) FILTER (WHERE k > 1) AS duplicate_months FROM g GROUP BY ALL),
o AS (SELECT model, experiment, count(*) FILTER (WHERE d < 0) AS out_of_order FROM (SELECT model, experiment, ym - lag(ym) OVER (PARTITION BY model, experiment ORDER BY place, ym) AS d FROM iv) GROUP BY ALL),
x AS (SELECT c.*, out_of_order, coalesce(missing_months, 0) AS missing_months, coalesce(missing, '') AS missing FROM c JOIN o USING (model, experiment) LEFT JOIN m USING (model, experiment))"""
_N = LAST - FIRST + 1


@query(f"""WITH {_COV} SELECT *, CASE WHEN missing_months > 0 THEN 'MISSING_MONTHS' WHEN duplicate_months > 0 THEN 'DUPLICATE_MONTHS' WHEN raw_months <> {_N} THEN 'COUNT_MISMATCH' ELSE 'OK' END AS status,
CASE WHEN raw_months <> {_N} THEN 'TIME_COUNT_MISMATCH' WHEN missing_months > 0 THEN 'MISSING_MONTHS' WHEN duplicate_months > 0 THEN 'DUPLICATE_MONTHS' WHEN out_of_order > 0 THEN 'TIME_ORDER_MISMATCH' ELSE 'OK' END AS status_by_count FROM x""")
def month_coverage(spark, sf_dir):
    # equal places are told apart by the month
    d = inventory(spark, sf_dir).withColumn("place", F.struct("place", "ym"))
    return contracts.month_coverage(d, ["model", "experiment"], FIRST, LAST)


@query(f"""WITH {_INV} SELECT model, experiment, ym::INT AS ym, place FROM (SELECT *, row_number() OVER (PARTITION BY model, experiment, ym ORDER BY place) AS k FROM iv) WHERE k = 1""")
def month_dedup(spark, sf_dir):
    return contracts.first_of_month(inventory(spark, sf_dir), ["model", "experiment"], ["place"]).select("model", "experiment", "ym", "place")


@query(f"""{A}, d AS (SELECT {_BYC}, ym - lag(ym) OVER (PARTITION BY {_BYC} ORDER BY ym) AS d FROM a)
SELECT {_BYC}, count(*) AS n, coalesce(bool_and(d = 1), TRUE) AS consecutive, coalesce(sum(d - 1), 0)::BIGINT AS missing FROM d GROUP BY ALL""")
def consecutive_months(spark, sf_dir):
    return contracts.gaps(monthly(spark, sf_dir), ["model", "source", "cell"])


@query(f"""WITH x AS (SELECT p_size % 4 AS grid, 'price' AS axis, p_partkey AS place, p_retailprice::DOUBLE AS v FROM part UNION ALL SELECT p_size % 4, 'key', p_partkey, -p_partkey FROM part), d AS (SELECT *, v - lag(v) OVER (PARTITION BY grid, axis ORDER BY place) AS d FROM x)
SELECT grid, axis, count(*) AS n, {r('min(v)')} AS low, {r('max(v)')} AS high, {r('quantile_cont(abs(d), 0.5)')} AS spacing, min(d) > 0 OR max(d) < 0 AS monotonic, (min(d) > 0 OR max(d) < 0) AND max(d) - min(d) <= 1e-6 AS regular FROM d GROUP BY ALL""")
def grid_spacing(spark, sf_dir):
    """Axes as they are stored: prices go up and down, negative keys fall."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("grid"), "p_partkey", "p_retailprice")
    both = F.array(F.struct(F.lit("price").alias("axis"), F.col("p_retailprice").cast("double").alias("v")), F.struct(F.lit("key").alias("axis"), (-F.col("p_partkey")).cast("double").alias("v")))
    d = p.select("grid", F.col("p_partkey").alias("place"), F.explode(both).alias("a")).select("grid", "place", "a.*")
    return out(contracts.axis(d, ["grid", "axis"], "v", "place"), ["grid", "axis", "monotonic", "regular"], ["low", "high", "spacing"], ["n"])


@query(f"""{A}, c AS (SELECT model, source, count(DISTINCT (lat, lon)) AS points, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM a GROUP BY ALL), s AS (SELECT *, (points, south, north, west, east) AS sig FROM c)
SELECT model, source, points, south, north, west, east, CASE WHEN east > 180 THEN '0_360' ELSE '-180_180' END AS longitudes, (SELECT count(DISTINCT sig) FROM s) AS distinct_grids,
CASE WHEN model = 'R' AND source = 'ref' THEN 'FAILED' WHEN points = 0 THEN 'COORDINATE_MISSING' WHEN model = 'N' AND source = 'ref' THEN 'NON_1D_GRID' ELSE 'OK_1D' END AS status FROM s""")
def grid_signatures(spark, sf_dir):
    """One grid stands for a file that can't be read, and one for a curved grid."""
    c = monthly(spark, sf_dir).groupBy("model", "source").agg(F.countDistinct("lat", "lon").alias("points"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    n = c.select(F.countDistinct(F.struct("points", "south", "north", "west", "east")).alias("distinct_grids"))
    d = c.crossJoin(F.broadcast(n))  # one row
    status = contracts.grid_status(F.col("points"), F.expr("not (model = 'N' and source = 'ref')"), F.expr("model = 'R' and source = 'ref'"))
    return d.withColumn("longitudes", F.when(F.col("east") > 180, "0_360").otherwise("-180_180")).withColumn("status", status)


@query(f"""{A}, w AS (SELECT model, source, cell, ym, CASE WHEN source = 'gcm' THEN lon * 3 ELSE lon * 1.44 END AS lon FROM a), m AS (SELECT *, max(lon) OVER (PARTITION BY model, source) AS top FROM w)
SELECT model, source, cell, {r('lon')} AS lon, {r('CASE WHEN top > 180 THEN ((lon + 180) % 360 + 360) % 360 - 180 ELSE lon END')} AS wrapped, ym, {_LABEL} AS label FROM m""")
def longitude_and_labels(spark, sf_dir):
    """Longitudes are wrapped on grids that go beyond 180 degrees only."""
    d = monthly(spark, sf_dir).withColumn("lon", F.col("lon") * F.when(F.col("source") == "gcm", 3.0).otherwise(1.44))
    d = wrap_axis(d.select("model", "source", "cell", "ym", "lon", F.col("lon").alias("wrapped")), ["model", "source"], "wrapped")
    return out(d.withColumn("label", month_label(F.col("ym"))), ["model", "source", "cell", "ym", "label"], ["lon", "wrapped"])


_SEV = """CASE variable WHEN 'tas' THEN CASE WHEN low < 150 OR high > 400 THEN 'FAIL' WHEN low < 190 OR high > 370 THEN 'WARNING' ELSE 'PASS' END
WHEN 'rsds' THEN CASE WHEN low < -1e-4 OR high > 1000 THEN 'FAIL' WHEN low < -1e-4 OR high > 500 THEN 'WARNING' ELSE 'PASS' END
ELSE CASE WHEN low < -1e-4 OR high > 100 THEN 'FAIL' WHEN low < -1e-4 OR high > 50 THEN 'WARNING' ELSE 'PASS' END END"""


@query(f"{A}, x AS (SELECT model, source, variable, min(value) AS low, max(value) AS high, count(value) AS finite, count(*) - count(value) AS missing FROM al GROUP BY ALL) SELECT model, source, variable, {r('low')} AS low, {r('high')} AS high, finite, missing, {_SEV} AS severity FROM x")
def range_severity(spark, sf_dir):
    """Physical ranges, and how many values are finite."""
    d = long_form(monthly(spark, sf_dir)).groupBy("model", "source", "variable").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("finite"), F.count_if(F.col("value").isNull()).alias("missing"))
    d = d.withColumn("severity", contracts.range_severity(F.col("variable"), F.col("low"), F.col("high")))
    return out(d, ["model", "source", "variable", "severity"], ["low", "high"], ["finite", "missing"])


@query(f"""{A}, x AS (SELECT model, source, variable, min(value) AS low, max(value) AS high FROM al GROUP BY ALL), s AS (SELECT {_SEV} AS status FROM x) SELECT status, count(*) AS n FROM s GROUP BY ALL""")
def status_counts(spark, sf_dir):
    d = long_form(monthly(spark, sf_dir)).groupBy("model", "source", "variable").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return d.select(contracts.range_severity(F.col("variable"), F.col("low"), F.col("high")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{A}, g AS (SELECT DISTINCT source, CASE WHEN source = 'ref' THEN cell + 5 ELSE cell END AS cell, lat, lon FROM a), f AS (SELECT x.lat AS la, y.lat AS lb, x.lon AS oa, y.lon AS ob FROM (SELECT * FROM g WHERE source = 'gcm') x FULL JOIN (SELECT * FROM g WHERE source = 'ref') y ON x.cell = y.cell)
SELECT count(*) FILTER (WHERE la IS NOT NULL AND lb IS NOT NULL) AS common, count(*) FILTER (WHERE la IS NULL OR lb IS NULL) AS unmatched, {r('coalesce(max(greatest(abs(la - lb), abs(oa - ob))), 0)')} AS max_difference, count(*) FILTER (WHERE la IS NULL OR lb IS NULL) = 0 AND max(greatest(abs(la - lb), abs(oa - ob))) <= 1e-10 AS equal FROM f""")
def grid_equality(spark, sf_dir):
    """The reference's cells have numbers that are shifted by one row."""
    d = monthly(spark, sf_dir).select("source", "cell", "lat", "lon").distinct()
    g = contracts.grids_equal(d.where("source = 'gcm'"), d.where("source = 'ref'").withColumn("cell", F.col("cell") + 5), ["cell"], ["lat", "lon"])
    return out(g, ["equal"], ["max_difference"], ["common", "unmatched"])


@query(f"""{A}, z AS (SELECT *, CASE model WHEN 'A' THEN lon + 1e-9 WHEN 'N' THEN lon + 1e-7 ELSE lon END AS moved FROM a WHERE source = 'ref'),
s AS (SELECT model, min(lat) AS south, max(lat) AS north, min(moved) AS west, max(moved) AS east FROM z GROUP BY ALL), t AS (SELECT model, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM a WHERE source = 'gcm' GROUP BY ALL)
SELECT s.model, s.south <= t.south + 1e-8 AND s.north >= t.north - 1e-8 AND s.west <= t.west + 1e-8 AND s.east >= t.east - 1e-8 AS covers FROM s JOIN t USING (model)""")
def domain_cover(spark, sf_dir):
    """Whether the source's grid covers the target's; one is moved by less than the tolerance, one by more."""
    d = monthly(spark, sf_dir)
    ref = d.where("source = 'ref'").withColumn("lon", F.col("lon") + F.expr("case model when 'A' then 1e-9 when 'N' then 1e-7 else 0.0 end"))
    return contracts.covers(ref, d.where("source = 'gcm'"), ["model"])


@query(f"""{A}, b AS (SELECT min(lat) AS la, max(lat) AS lb, min(lon) AS oa, max(lon) AS ob FROM a WHERE {sql_meets(REGION, 'lon - 6', 'lat - 4', 'lon + 6', 'lat + 4')})
SELECT model, source, cell, ym, {r('tas')} AS tas FROM a, b WHERE lat BETWEEN la AND lb AND lon BETWEEN oa AND ob""")
def polygon_crop(spark, sf_dir):
    """The smallest box around all cells that meet a polygon, then the cells in it."""
    d = reused(monthly(spark, sf_dir))
    o = spatial.overlap(boxes(d), [REGION]).select("cell", "intersects")
    return out(spatial.crop(d.join(F.broadcast(o), "cell"), F.col("intersects")), ["model", "source", "cell", "ym"], ["tas"])


@query(f"""{A}, p AS (SELECT model, source, cell, ym, tas FROM a WHERE year <= 1998), q AS (SELECT model, source, cell, ym, tas + CASE WHEN cell = 5 THEN 2e-5 ELSE 0 END AS tas FROM a WHERE year >= 1998)
SELECT p.model, count(*) AS n, {r('max(abs(p.tas - q.tas))')} AS max_difference, count(*) FILTER (WHERE abs(p.tas - q.tas) > 1e-12) AS changed, max(abs(p.tas - q.tas)) <= 1e-5 AS ok FROM p JOIN q USING (model, source, cell, ym) GROUP BY p.model""")
def overlap_regression(spark, sf_dir):
    """Two versions of a series must agree where they overlap."""
    d = monthly(spark, sf_dir)
    new = d.where("year >= 1998").withColumn("tas", F.col("tas") + F.when(F.col("cell") == 5, 2e-5).otherwise(0.0))
    g = contracts.overlap_check(d.where("year <= 1998"), new, ["model", "source", "cell", "ym"], ["model"], "tas")
    return out(g, ["model", "ok"], ["max_difference"], ["n", "changed"])


_AUDITED = f"""{A}, l AS (SELECT model, source, cell, CASE WHEN cell = 8 AND source = 'ref' THEN lat + 0.5 ELSE lat END AS lat, lon, variable, ym, value, CASE WHEN cell = 6 THEN -ym ELSE ym END AS place,
      CASE WHEN cell = 4 AND source = 'ref' THEN 'degC' WHEN variable = 'tas' THEN 'K' WHEN variable = 'rsds' THEN 'W m-2' WHEN ym % 2 = 0 AND cell = 9 THEN 'm/s' ELSE 'm s-1' END AS unit FROM al),
t AS (SELECT model, source, cell, variable, ym, min(place) AS place FROM l GROUP BY ALL),
ti AS (SELECT *, row_number() OVER (PARTITION BY model, source, cell, variable ORDER BY ym) - 1 AS i, count(*) OVER (PARTITION BY model, source, cell, variable) AS n, ym - lag(ym) OVER (PARTITION BY model, source, cell, variable ORDER BY ym) AS step, ym < lag(ym) OVER (PARTITION BY model, source, cell, variable ORDER BY place, ym) AS back FROM t),
tm AS (SELECT model, source, cell, variable, count(*) AS time_count, min(ym)::INT AS first, max(ym)::INT AS last, coalesce(sum(step - 1), 0)::BIGINT AS gaps, count(*) FILTER (WHERE back) AS disorder FROM ti GROUP BY ALL),
sm AS (SELECT model, source, cell, variable, min(value) AS sample_min, max(value) AS sample_max, 100.0 * count(value) / count(*) AS finite_percent FROM l JOIN (SELECT model, source, cell, variable, ym FROM ti WHERE i = 0 OR i = n // 2 OR i = n - 1) USING (model, source, cell, variable, ym) GROUP BY ALL),
un AS (SELECT model, source, cell, variable, list_sort(list(DISTINCT unit)) AS us FROM l GROUP BY ALL),
ga AS (SELECT *, list_filter([CASE WHEN gaps > 0 THEN printf('%d months lack between the first and the last', gaps) END, CASE WHEN len(us) <> 1 THEN 'several units: ' || array_to_string(us, ', ') END, CASE WHEN len(us) = 1 AND us[1] = 'degC' THEN 'not a unit of this variable: degC' END,
        CASE WHEN sample_max > CASE variable WHEN 'tas' THEN 285 WHEN 'rsds' THEN 1500 ELSE 150 END THEN 'sampled values over the limit' END], lambda x: x IS NOT NULL) AS e, list_filter([CASE WHEN disorder > 0 THEN 'months are not stored in order' END], lambda x: x IS NOT NULL) AS w FROM tm JOIN sm USING (model, source, cell, variable) JOIN un USING (model, source, cell, variable)),
au AS (SELECT model, source, cell, variable, time_count, first, last, array_to_string(us, '; ') AS units, sample_min, sample_max, finite_percent, CASE WHEN len(e) > 0 THEN 'FAILED' WHEN len(w) > 0 THEN 'WARNING' ELSE 'PASSED' END AS status, array_to_string(list_concat(e, w), ' | ') AS message FROM ga)"""


def _audited(spark, sf_dir):
    """Rows with units and places; one cell of the reference has a wrong unit, one lies elsewhere, one cell is stored backwards, one has two units."""
    d = long_form(monthly(spark, sf_dir))
    unit = F.expr("case when cell = 4 and source = 'ref' then 'degC' when variable = 'tas' then 'K' when variable = 'rsds' then 'W m-2' when ym % 2 = 0 and cell = 9 then 'm/s' else 'm s-1' end")
    return d.select("model", "source", "cell", F.expr("case when cell = 8 and source = 'ref' then lat + 0.5 else lat end").alias("lat"), "lon", "variable", "ym", "value", F.expr("case when cell = 6 then -ym else ym end").alias("place"), unit.alias("unit"))


_OWN_LIMITS = contracts.SAMPLE_LIMITS | {"tas": (150.0, 285.0)}
_AUDIT = ["sample_min", "sample_max", "finite_percent"]


@query(f"{_AUDITED} SELECT model, source, cell, variable, time_count, first, last, units, {', '.join(f'{r(c)} AS {c}' for c in _AUDIT)}, status, message FROM au")
def group_audit(spark, sf_dir):
    """Each cell's series as a group of files: times, units, and values on three time steps."""
    by = ["model", "source", "cell", "variable"]
    return out(contracts.group_audit(_audited(spark, sf_dir), by, "place", "value", "unit", limits=_OWN_LIMITS), [*by, "first", "last", "units", "status", "message"], _AUDIT, ["time_count"])


@query(f"""{_AUDITED}, g AS (SELECT model, source, cell, variable, list_sort(list(DISTINCT (lat, lon))) AS g FROM l GROUP BY ALL),
ab AS (SELECT model, cell, variable, count(*) AS absent FROM (SELECT DISTINCT model, cell, variable, ym FROM l WHERE source = 'ref') ANTI JOIN (SELECT DISTINCT model, cell, variable, ym FROM l WHERE source = 'gcm') USING (model, cell, variable, ym) GROUP BY ALL),
p AS (SELECT m.model, m.cell, m.variable, m.status AS sm, r.status AS sr, m.units AS um, r.units AS ur, gm.g AS gm, gr.g AS gr, coalesce(absent, 0) AS absent FROM (SELECT * FROM au WHERE source = 'gcm') m JOIN (SELECT * FROM au WHERE source = 'ref') r USING (model, cell, variable)
      JOIN (SELECT * FROM g WHERE source = 'gcm') gm USING (model, cell, variable) JOIN (SELECT * FROM g WHERE source = 'ref') gr USING (model, cell, variable) LEFT JOIN ab USING (model, cell, variable)),
e AS (SELECT *, list_filter([CASE WHEN sm = 'FAILED' THEN 'the model''s own audit failed' END, CASE WHEN sr = 'FAILED' THEN 'the reference''s own audit failed' END, CASE WHEN gm <> gr THEN 'unlike grids' END, CASE WHEN absent > 0 THEN printf('%d of the reference''s months lack', absent) END, CASE WHEN um <> ur THEN 'unlike units' END], lambda x: x IS NOT NULL) AS e FROM p)
SELECT model, cell, variable, CASE WHEN len(e) > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, array_to_string(e, ' | ') AS message FROM e""")
def pair_audit(spark, sf_dir):
    """Model and reference as pairs: their own audits, grids, months and units."""
    d = _audited(spark, sf_dir)
    by = ["model", "cell", "variable"]
    audit = contracts.group_audit(d, ["source", *by], "place", "value", "unit", limits=_OWN_LIMITS)
    return contracts.pair_audit(audit, d, by, "source", "gcm", "ref")


@query(f"{A}, g AS (SELECT DISTINCT model, cell, ym FROM a WHERE source = 'gcm'), r AS (SELECT DISTINCT model, cell, ym FROM a WHERE source = 'ref') SELECT model, cell, ym, CASE WHEN g.ym IS NULL THEN 'ref' ELSE 'gcm' END AS only_in FROM (SELECT *, ym AS k FROM g) g FULL JOIN (SELECT *, ym AS k FROM r) r USING (model, cell, ym) WHERE g.k IS NULL OR r.k IS NULL".replace("g.ym IS NULL", "g.k IS NULL"))
def exact_coverage(spark, sf_dir):
    """Months that only the model or only the reference has."""
    d = monthly(spark, sf_dir)
    return contracts.exact_coverage(d.where("source = 'gcm'"), d.where("source = 'ref'"), ["model", "cell", "ym"], ("gcm", "ref"))


@query(f"""{A}, z AS (SELECT model, source, cell, ym, CASE WHEN variable = 'wind' AND weight = 0 THEN 'rsds' ELSE variable END AS variable FROM al), c AS (SELECT model, source, cell, ym, count(*) FILTER (WHERE variable = 'tas') AS t, count(*) FILTER (WHERE variable = 'rsds') AS s, count(*) FILTER (WHERE variable = 'wind') AS w FROM z GROUP BY ALL),
x AS (SELECT model, source, cell, ym, array_to_string(list_filter([CASE WHEN t = 0 THEN 'tas' END, CASE WHEN s = 0 THEN 'rsds' END, CASE WHEN w = 0 THEN 'wind' END], lambda x: x IS NOT NULL), ';') AS missing, array_to_string(list_filter([CASE WHEN t > 1 THEN 'tas' END, CASE WHEN s > 1 THEN 'rsds' END, CASE WHEN w > 1 THEN 'wind' END], lambda x: x IS NOT NULL), ';') AS repeated FROM c)
SELECT * FROM x WHERE missing <> '' OR repeated <> ''""")
def exact_alignment(spark, sf_dir):
    """Three variables must have the same keys; in some cells wind is filed as radiation."""
    d = long_form(monthly(spark, sf_dir)).withColumn("variable", F.expr("case when variable = 'wind' and weight = 0 then 'rsds' else variable end"))
    return contracts.exact_alignment(d, ["model", "source", "cell", "ym"], ["tas", "rsds", "wind"])


@query("""WITH h AS (SELECT DISTINCT c_custkey AS holder, o_orderpriority AS item FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT holder, count(DISTINCT item) AS n FROM h WHERE holder <> 13 GROUP BY holder HAVING count(DISTINCT item) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def model_completeness(spark, sf_dir):
    """Relational division: who has every item."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("item"))
    h = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").alias("holder"), "item")
    return contracts.holders_of_all(h, "holder", "item", o.select("item"), exclude=[13])


@query("""WITH m AS (SELECT o_orderkey, o_orderstatus AS status FROM orders), n AS (SELECT o_orderkey, 'R' AS status FROM orders WHERE o_orderkey % 5 = 0)
SELECT * FROM m ANTI JOIN n USING (o_orderkey) UNION ALL SELECT * FROM n""")
def manifest_replace(spark, sf_dir):
    m = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return contracts.replace_rows(m, m.where("o_orderkey % 5 = 0").withColumn("status", F.lit("R")), ["o_orderkey"])


@query("""SELECT DISTINCT o_custkey FROM orders ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') USING (o_custkey)""")
def incremental_skip(spark, sf_dir):
    """Jobs that no finished manifest row covers."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return contracts.not_done(o.select("o_custkey").distinct(), o, ["o_custkey"], "o_orderstatus", "F")


@query("""WITH f AS (SELECT CASE WHEN o_totalprice < 1000 THEN 'ZERO_BYTE' WHEN o_orderkey % 97 = 0 THEN 'OPEN_FAILED' WHEN o_orderpriority LIKE '1%' THEN 'VARIABLE_MISSING' WHEN o_orderpriority LIKE '2%' THEN 'TIME_MISSING' WHEN o_orderstatus = 'P' THEN 'SPATIAL_COORD_MISSING' ELSE 'OK' END AS status FROM orders)
SELECT status, count(*) AS n FROM f GROUP BY ALL""")
def file_integrity(spark, sf_dir):
    """The first fault of a file, counted; orders stand for files."""
    c = F.col
    size = F.when(c("o_totalprice") < 1000, 0).otherwise(c("o_totalprice"))
    s = contracts.file_status(size, c("o_orderkey") % 97 != 0, ~c("o_orderpriority").startswith("1"), ~c("o_orderpriority").startswith("2"), c("o_orderstatus") != "P")
    return table(spark, sf_dir, "orders").groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT o_orderkey, year(o_orderdate)::INT AS first_year, (year(o_orderdate) + o_orderkey % 4)::INT AS last_year FROM orders) SELECT *, last_year >= 1996 AND first_year <= 1997 AS overlaps FROM f""")
def period_overlap(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("first_year"), (F.year("o_orderdate") + F.col("o_orderkey") % 4).cast("int").alias("last_year"))
    return f.withColumn("overlaps", contracts.overlaps(F.col("first_year"), F.col("last_year"), 1996, 1997))


@query("""WITH g AS (SELECT l_returnflag AS experiment, l_suppkey, min(year(l_shipdate))::INT AS first_year, max(year(l_shipdate))::INT AS last_year FROM lineitem GROUP BY ALL), c AS (SELECT experiment, first_year, last_year, count(*) AS n FROM g GROUP BY ALL)
SELECT experiment, first_year, last_year, n FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY n DESC, first_year, last_year) AS k FROM c) WHERE k = 1""")
def most_common_period(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment"), "l_suppkey").agg(F.min(F.year("l_shipdate")).alias("first_year"), F.max(F.year("l_shipdate")).alias("last_year"))
    c = g.groupBy("experiment", "first_year", "last_year").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("first_year", "last_year", "n"), F.struct("n", -F.col("first_year"), -F.col("last_year")))
    return c.groupBy("experiment").agg(best.alias("b")).select("experiment", "b.*")


@query("""SELECT calendar, l_returnflag AS model, count(*) AS files, count(DISTINCT l_suppkey) AS groups FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN '360_day' WHEN 1 THEN 'noleap' ELSE 'gregorian' END AS calendar FROM lineitem) GROUP BY ALL""")
def calendar_inventory(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("calendar", F.when(F.col("l_linenumber") % 3 == 0, "360_day").when(F.col("l_linenumber") % 3 == 1, "noleap").otherwise("gregorian"))
    return d.groupBy("calendar", F.col("l_returnflag").alias("model")).agg(F.count("*").alias("files"), F.countDistinct("l_suppkey").alias("groups"))
