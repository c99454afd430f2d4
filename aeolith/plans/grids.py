"""Edges, areas, overlaps and regridding."""

from pyspark.sql import functions as F

from aeolith.operators import spatial
from aeolith.plans.common import A, monthly, out, r
from aeolith.plans.registry import query

TARGET_LAT = spatial.axis_points(15.0, 47.0, 4.0)
TARGET_LON = spatial.axis_points(73.0, 133.0, 5.0)


@query(f"""{A}, x AS (SELECT DISTINCT lat AS v FROM a), e AS (SELECT v, lag(v) OVER (ORDER BY v) AS b, lead(v) OVER (ORDER BY v) AS n FROM x)
SELECT v AS lat, {r('v - coalesce((v - b) / 2, (n - v) / 2)')} AS low, {r('v + coalesce((n - v) / 2, (v - b) / 2)')} AS high FROM e""")
def cell_edges(spark, sf_dir):
    return out(spatial.cell_edges(monthly(spark, sf_dir).select("lat").distinct(), "lat"), ["lat"], ["low", "high"])


def boxes(cube):
    """The grid's cells as boxes."""
    c = cube.select("cell", "lat", "lon").distinct()
    la = spatial.cell_edges(c.select("lat").distinct(), "lat").select("lat", F.col("low").alias("south"), F.col("high").alias("north"))
    lo = spatial.cell_edges(c.select("lon").distinct(), "lon").select("lon", F.col("low").alias("west"), F.col("high").alias("east"))
    return c.join(la, "lat").join(lo, "lon")


@query()
def cell_areas(spark, sf_dir):
    """Geodesic areas: no SQL; tested against closed forms."""
    return out(spatial.cell_areas(boxes(monthly(spark, sf_dir))), ["cell"], ["area_km2"])


#: A six-sided domain with a hole, counter-clockwise and clockwise.
DOMAIN = (((75.0, 17.0), (100.0, 12.0), (125.0, 20.0), (120.0, 45.0), (95.0, 50.0), (74.0, 35.0)), ((95.0, 25.0), (95.0, 30.0), (103.0, 30.0), (103.0, 25.0)))


#: A convex region inside it, counter-clockwise.
REGION = ((80.0, 18.0), (104.0, 14.0), (112.0, 30.0), (90.0, 38.0))


def sql_meets(ring, west: str, south: str, east: str, north: str) -> str:
    """Whether a box and a convex counter-clockwise ring share an area: no side of either parts them."""
    x, y = [p[0] for p in ring], [p[1] for p in ring]
    parts = [f"{east} > {min(x)}", f"{west} < {max(x)}", f"{north} > {min(y)}", f"{south} < {max(y)}"]
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]]):
        left = [f"{bx - ax} * (({q}) - {ay}) - {by - ay} * (({p}) - {ax})" for p in (west, east) for q in (south, north)]
        parts.append(f"greatest({', '.join(left)}) > 1e-9")
    return " AND ".join(parts)


@query()
def polygon_weights(spark, sf_dir):
    """Share of each cell inside a domain; cells outside the domain weigh nothing."""
    o = spatial.overlap(boxes(monthly(spark, sf_dir)), DOMAIN)
    return out(o, ["cell", "intersects", "inside"], ["area_km2", "intersection_km2", "fraction"])


_PTS = f"tg AS (SELECT * FROM (SELECT unnest({TARGET_LAT})::DOUBLE AS tlat), (SELECT unnest({TARGET_LON})::DOUBLE AS tlon))"
_REG = f"""{_PTS}, s AS (SELECT model, lat, lon, avg(CASE WHEN cell <> 12 THEN tas END) AS v FROM a WHERE source = 'gcm' GROUP BY ALL),
yi AS (SELECT lat AS lo, lead(lat) OVER (ORDER BY lat) AS hi FROM (SELECT DISTINCT lat FROM s)), xi AS (SELECT lon AS lo, lead(lon) OVER (ORDER BY lon) AS hi FROM (SELECT DISTINCT lon FROM s)),
c AS (SELECT DISTINCT model FROM s), p AS (SELECT c.model, tlat, tlon, y.lo AS y0, y.hi AS y1, x.lo AS x0, x.hi AS x1, (tlat - y.lo) / (y.hi - y.lo) AS wy, (tlon - x.lo) / (x.hi - x.lo) AS wx FROM c, tg
      LEFT JOIN yi y ON y.hi IS NOT NULL AND tlat >= y.lo AND (tlat < y.hi OR (tlat = y.hi AND y.hi = (SELECT max(lat) FROM s)))
      LEFT JOIN xi x ON x.hi IS NOT NULL AND tlon >= x.lo AND (tlon < x.hi OR (tlon = x.hi AND x.hi = (SELECT max(lon) FROM s))))
SELECT p.model, tlat AS lat, tlon AS lon, {r(f'CASE WHEN {sql_meets(REGION, 'tlon - 2.5', 'tlat - 2', 'tlon + 2.5', 'tlat + 2')} THEN (1 - wy) * (1 - wx) * a1.v + (1 - wy) * wx * a2.v + wy * (1 - wx) * a3.v + wy * wx * a4.v END')} AS tas FROM p
LEFT JOIN s a1 ON a1.model = p.model AND a1.lat = y0 AND a1.lon = x0 LEFT JOIN s a2 ON a2.model = p.model AND a2.lat = y0 AND a2.lon = x1
LEFT JOIN s a3 ON a3.model = p.model AND a3.lat = y1 AND a3.lon = x0 LEFT JOIN s a4 ON a4.model = p.model AND a4.lat = y1 AND a4.lon = x1"""


def target_grid(spark):
    lat = spark.createDataFrame([(x,) for x in TARGET_LAT], "lat double")
    return lat.withColumn("lon", F.explode(F.array(*[F.lit(x) for x in TARGET_LON])))


@query(f"{A}, {_REG}")
def bilinear_regrid(spark, sf_dir):
    """One source cell has no value; targets beyond the grid, next to the gap, and in cells that don't meet the polygon are NULL."""
    s = monthly(spark, sf_dir).where("source = 'gcm'").groupBy("model", "lat", "lon").agg(F.avg(F.when(F.col("cell") != 12, F.col("tas"))).alias("tas"))
    half = [F.col("lon") - 2.5, F.col("lat") - 2, F.col("lon") + 2.5, F.col("lat") + 2]
    targets = target_grid(spark).select("lat", "lon", *[c.alias(n) for c, n in zip(half, ("west", "south", "east", "north"))])
    targets = spatial.overlap(targets, [REGION]).select("lat", "lon", F.col("intersects").alias("inside"))
    return out(spatial.regrid(s, targets, ["model"], "tas", "inside"), ["model", "lat", "lon"], ["tas"])
