"""Cubes in long form, built from the fixture tables.

A production cube is read with ``read_cube``; the proxies give the operators the same
columns.  Values that aren't finite become NULL on the way in, so that means, quantiles
and comparisons need no special cases for NaN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolith.functions.months import month_index
from aeolith.functions.numeric import HALF_SHIFT, rounded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finite(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinities of these columns as NULL."""
    for c in columns:
        x = F.col(c)
        df = df.withColumn(c, F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))
    return df


def read_cube(spark: SparkSession, *paths: str, columns: tuple[str, ...], keys: tuple[str, ...] = ("model", "scenario", "cell", "ym")) -> DataFrame:
    """Only the keys and the wanted columns of Parquet cubes; an error if one is missing."""
    df = spark.read.parquet(*paths)
    missing = [c for c in (*keys, *columns) if c not in df.columns]
    if missing:
        raise ValueError(f"the cube has no {', '.join(missing)}")
    return finite(df.select(*keys, *columns), *columns)


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube A: (model, source, cell, lat, lon, weight, ym, year, month, days, tas, rsds, wind)."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    a = (
        line.join(supp, line["l_suppkey"] == supp["s_suppkey"])
        .groupBy(
            F.col("l_returnflag").alias("model"), F.when(F.col("l_linestatus") == "F", "gcm").otherwise("ref").alias("source"),
            F.col("s_nationkey").cast("int").alias("cell"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        )
        .agg((250 + F.avg("l_quantity")).alias("tas"), (F.avg("l_extendedprice") / 200).alias("rsds"), (F.avg("l_discount") * 100).alias("wind"))
    )
    return finite(a, "tas", "rsds", "wind").select(
        "model", "source", "cell", lat(F.col("cell")).alias("lat"), lon(F.col("cell")).alias("lon"), weight(F.col("cell")).alias("weight"),
        month_index(F.col("year"), F.col("month")).alias("ym"), "year", "month", F.day(F.last_day(F.make_date("year", "month", F.lit(1)))).alias("days"),
        *[rounded(F.col(c)).alias(c) for c in ("tas", "rsds", "wind")],
    )


def lat(cell):
    return (15 + 8 * F.floor(cell / 5)).cast("double")


def lon(cell):
    return (73 + 12 * (cell % 5)).cast("double")


def weight(cell):
    """Zero outside the area of interest."""
    return F.when(cell % 7 == 3, 0.0).otherwise(1000.0 + 37 * cell)


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube B: (cell, cycle, phase, value): 30 days of four 6-hour means for each event type."""
    e = table(spark, sf_dir, "events")
    b = e.groupBy(F.col("event_type").alias("cell"), F.day("ts").alias("cycle"), F.floor(F.hour("ts") / 6).cast("int").alias("phase")).agg(F.avg("value").alias("value"))
    return finite(b, "value").withColumn("value", rounded(F.col("value")))


_KEPT: list[DataFrame] = []


def reused(cube: DataFrame) -> DataFrame:
    """A cube that a query reads several times: kept, so its source is scanned once.  A cube is
    smaller than its source by the number of rows in a cell and month, and spills to disk.
    ``release`` lets go of it, once the query's rows have been written."""
    _KEPT.append(cube.persist())
    return cube


def release() -> None:
    """Let go of all that ``reused`` keeps."""
    while _KEPT:
        _KEPT.pop().unpersist()


def long_form(cube: DataFrame, variables: tuple[str, ...] = ("tas", "rsds", "wind")) -> DataFrame:
    """One row for each variable: (..., variable, value)."""
    keys = [c for c in cube.columns if c not in variables]
    return cube.unpivot(keys, list(variables), "variable", "value")


#: The same cubes in DuckDB SQL, as the first common table expressions of a query.
_R = lambda x: f"round({x} + {HALF_SHIFT}, 6)"
SQL_A = f"""
a0 AS (SELECT l_returnflag AS model, CASE WHEN l_linestatus = 'F' THEN 'gcm' ELSE 'ref' END AS source, s_nationkey::INT AS cell,
              year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, 250 + avg(l_quantity) AS tas, avg(l_extendedprice) / 200 AS rsds, avg(l_discount) * 100 AS wind
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
a AS (SELECT model, source, cell, (15 + 8 * (cell // 5))::DOUBLE AS lat, (73 + 12 * (cell % 5))::DOUBLE AS lon,
             CASE WHEN cell % 7 = 3 THEN 0.0::DOUBLE ELSE (1000 + 37 * cell)::DOUBLE END AS weight, year * 12 + month - 1 AS ym, year, month,
             day(last_day(make_date(year, month, 1)))::INT AS days, {_R('tas')} AS tas, {_R('rsds')} AS rsds, {_R('wind')} AS wind FROM a0),
al AS (SELECT model, source, cell, lat, lon, weight, ym, year, month, days, unnest(['tas', 'rsds', 'wind']) AS variable, unnest([tas, rsds, wind]) AS value FROM a)"""
SQL_B = f"""
b AS (SELECT event_type AS cell, day(ts)::INT AS cycle, (hour(ts) // 6)::INT AS phase, {_R('avg(value)')} AS value FROM events GROUP BY ALL)"""
