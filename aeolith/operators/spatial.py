"""Grids: cell edges, geodesic areas, overlap with polygons, and bilinear regridding."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.operators.geodesy import Boundary, box_areas_km2
from aeolith.scratch import exists
from aeolith.ship import ship

LEAST_AREA_KM2 = 1e-6


def axis_points(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to and with stop."""
    n = int(math.floor((stop - start) / step + 1e-9)) + 1
    return [start + k * step for k in range(n)]


def cell_edges(points: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``points`` with low and high: midpoints between neighbours; at both ends the same distance outward."""
    w = Window.partitionBy(*by).orderBy(x) if by else Window.partitionBy(F.lit(0)).orderBy(x)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    c = F.col(x)
    d = points.withColumn("__b", (c - before) / 2).withColumn("__a", (after - c) / 2)
    return d.withColumn("low", c - F.coalesce("__b", "__a")).withColumn("high", c + F.coalesce("__a", "__b")).drop("__a", "__b")


def edges(values: Sequence[float]) -> np.ndarray:
    """Edges of a monotonic axis; an error if it isn't, or has under two points."""
    v = np.asarray(values, float)
    d = np.diff(v)
    if len(v) < 2 or not ((d > 0).all() or (d < 0).all()):
        raise ValueError("an axis must be strictly monotonic")
    return np.concatenate(([v[0] - d[0] / 2], v[:-1] + d / 2, [v[-1] + d[-1] / 2]))


def cell_areas(cells: DataFrame, west: str = "west", south: str = "south", east: str = "east", north: str = "north") -> DataFrame:
    """``cells`` with area_km2, the geodesic area of each box."""
    ship(cells.sparkSession)

    @F.pandas_udf("double")
    def area(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(box_areas_km2(w, s, e, n), dtype="float64")

    return cells.withColumn("area_km2", area(west, south, east, north))


def overlap(cells: DataFrame, rings: Sequence[Sequence[tuple[float, float]]]) -> DataFrame:
    """``cells`` (west, south, east, north) with area_km2, intersection_km2, fraction, intersects and inside.

    ``rings`` is one boundary (outer rings; inner ones as negative by their turning sense),
    a fixed input of the domain, read by the driver and sent to each executor once.  All boxes of a row are
    cut together.  Run it once for each distinct grid.
    """
    ship(cells.sparkSession)
    sent = cells.sparkSession.sparkContext.broadcast(Boundary(rings))

    @F.pandas_udf("struct<area:double,cut:double>")
    def run(w: pd.Series, s: pd.Series, e: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"area": box_areas_km2(w, s, e, n), "cut": sent.value.areas_km2(w, s, e, n)})

    d = cells.withColumn("__o", run("west", "south", "east", "north"))
    hit = F.col("__o.cut") > LEAST_AREA_KM2
    d = d.withColumn("area_km2", F.col("__o.area")).withColumn("intersection_km2", F.when(hit, F.least("__o.cut", "__o.area")).otherwise(0.0))
    d = d.withColumn("fraction", F.least(F.greatest(F.col("intersection_km2") / F.col("area_km2"), F.lit(0.0)), F.lit(1.0)))
    return d.withColumn("intersects", hit).withColumn("inside", F.col("fraction") >= 1 - 1e-6).drop("__o")


def crop(df: DataFrame, inside: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """The rows in the smallest range of both axes that holds every cell for which ``inside`` is true
    (that meets a polygon); none if no cell does."""
    box = df.where(inside).agg(F.min(lat).alias("__s"), F.max(lat).alias("__n"), F.min(lon).alias("__w"), F.max(lon).alias("__e"))
    return df.join(F.broadcast(box), F.col(lat).between(F.col("__s"), F.col("__n")) & F.col(lon).between(F.col("__w"), F.col("__e"))).drop("__s", "__n", "__w", "__e")


def grid_id(cells: DataFrame) -> str:
    """A digest of a grid's boxes: what belongs to a grid is made once for each."""
    one = F.format_string("%.9f,%.9f,%.9f,%.9f", "west", "south", "east", "north")
    return cells.select(one.alias("c")).distinct().agg(F.sha2(F.array_join(F.array_sort(F.collect_list("c")), ";"), 256)).first()[0] or ""


def kept_overlap(cells: DataFrame, rings: Sequence[Sequence[tuple[float, float]]], folder: str) -> DataFrame:
    """``overlap``, kept under ``folder`` by the digests of the grid and of the boundary: read again where it
    is there.  A grid has some ten thousand boxes, so its digest is made in one task."""
    import hashlib

    spark = cells.sparkSession
    border = hashlib.sha256(repr([[(float(x), float(y)) for x, y in r] for r in rings]).encode()).hexdigest()[:16]
    path = f"{folder}/weights-{grid_id(cells)[:32]}-{border}"
    if not exists(spark, f"{path}/_SUCCESS"):
        overlap(cells, rings).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _intervals(src: DataFrame, x: str) -> DataFrame:
    """(lo, hi, last): neighbouring points of an axis."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    d = src.select(x).distinct().withColumn("hi", F.lead(x).over(w)).withColumn("last", F.lead(x, 2).over(w).isNull())
    return d.where("hi is not null").select(F.col(x).alias("lo"), "hi", "last")


def _axis_weights(src: DataFrame, targets: DataFrame, x: str) -> DataFrame:
    """(target, corner, weight): two rows for each target inside the axis.

    An axis has some hundred points, whatever the length of the data, so a range join by
    broadcast is right here; it never meets cells.
    """
    i = F.broadcast(_intervals(src, x))
    t = targets.select(F.col(x).alias("t")).distinct()
    met = t.join(i, (F.col("t") >= F.col("lo")) & ((F.col("t") < F.col("hi")) | (F.col("last") & (F.col("t") == F.col("hi")))))
    share = (F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    both = F.array(F.struct(F.col("lo").alias("c"), (1 - share).alias("w")), F.struct(F.col("hi").alias("c"), share.alias("w")))
    return met.select(F.col("t").alias(f"t_{x}"), F.explode(both).alias("e")).select(f"t_{x}", F.col("e.c").alias(x), F.col("e.w").alias(f"w_{x}"))


def regrid(src: DataFrame, targets: DataFrame, by: Sequence[str], value: str, inside: str | None = None) -> DataFrame:
    """(by, lat, lon, value) on the target points: bilinear; NULL outside the source grid, and where a corner is missing.
    ``inside`` names a column of ``targets``: where it is false (the cell doesn't meet the polygon) the value is NULL too."""
    la, lo = _axis_weights(src, targets, "lat"), _axis_weights(src, targets, "lon")
    corners = src.select(*by, "lat", "lon", value).join(F.broadcast(la), "lat").join(F.broadcast(lo), "lon")
    got = corners.groupBy(*by, "t_lat", "t_lon").agg(F.sum(F.col(value) * F.col("w_lat") * F.col("w_lon")).alias("__v"), F.count(value).alias("__n"))
    every = src.select(*by).distinct().crossJoin(F.broadcast(targets.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")))) if by else targets.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    out = every.join(got, [*by, "t_lat", "t_lon"], "left")
    if inside:
        out = out.join(F.broadcast(targets.select(F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"), F.col(inside).alias("__inside"))), ["t_lat", "t_lon"])
        out = out.withColumn("__v", F.when(F.col("__inside"), F.col("__v")))
    return out.select(*by, F.col("t_lat").alias("lat"), F.col("t_lon").alias("lon"), F.when(F.col("__n") == 4, F.col("__v")).alias(value))
