"""Sources and sinks: what is written and read again is what was there."""

from pyspark.sql import functions as F

from aeolith.plans.common import A, long_form, monthly, out, r, reused, table
from aeolith.plans.grids import boxes
from aeolith.plans.registry import query
from aeolith.scratch import new_path
from aeolith.sources import files
from aeolith.sources.cubes import read_cube


@query(f"{A} SELECT model, source, cell, ym, {r('tas')} AS tas, {r('wind')} AS wind FROM a WHERE ym BETWEEN 23940 AND 23999")
def stored_cube(spark, sf_dir):
    """A cube written in blocks of months, of which five years and two variables are read."""
    path = new_path(spark, "cube")
    files.write_cube(monthly(spark, sf_dir), path, by=("model", "source"))
    d = read_cube(spark, path, columns=("tas", "wind"), keys=("model", "source", "cell", "ym", "time_block"))
    # the block of a month lets whole folders be left out
    return out(d.where("ym between 23940 and 23999 and time_block between 199 and 199"), ["model", "source", "cell", "ym"], ["tas", "wind"])


@query(f"{A} SELECT model, cell, ym, {r('tas')} AS tas FROM a WHERE source = 'gcm'")
def joined_series(spark, sf_dir):
    """Two stretches of time, stored by themselves, as one series."""
    d = monthly(spark, sf_dir).where("source = 'gcm'").select("model", "cell", "ym", "tas")
    parts = []
    for name, cond in (("late", "ym >= 23970"), ("early", "ym < 23970")):
        path = new_path(spark, name)
        d.where(cond).write.parquet(path)
        parts.append(spark.read.parquet(path))
    return out(files.joined_in_time(parts, ["model", "cell"]), ["model", "cell", "ym"], ["tas"])


@query(f"{A} SELECT model, source, variable, year, count(value) AS n, {r('avg(value)')} AS mean FROM al GROUP BY ALL")
def csv_round_trip(spark, sf_dir):
    """A report's table as CSV, read by names and in another order of columns."""
    path = new_path(spark, "csv")
    g = long_form(monthly(spark, sf_dir)).groupBy("model", "source", "variable", "year").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    files.write_csv(g.select("n", "mean", "year", "variable", "source", "model"), path)
    d = files.read_csv(spark, path, "model string, source string, variable string, year int, n long, mean double")
    return out(d, ["model", "source", "variable", "year"], ["mean"], ["n"])


@query("SELECT l_orderkey, count(*) AS matches, string_agg(DISTINCT l_linenumber::VARCHAR || '.nc', ';' ORDER BY l_linenumber::VARCHAR || '.nc') AS files FROM lineitem GROUP BY ALL HAVING count(*) <> 1")
def files_of_a_key(spark, sf_dir):
    """Keys with several files, where one is right; lines of orders stand for files."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lit(".nc")).alias("path"))
    return files.one_match(d, ["l_orderkey"])


@query(f"{A} SELECT 'model=' || model || '/source=' || source AS key, 'COMPLETE' AS status, count(*) AS rows, count(DISTINCT cell) AS cells FROM a GROUP BY model, source")
def run_manifest(spark, sf_dir):
    """Records of runs as JSON, written and read again."""
    counts = monthly(spark, sf_dir).groupBy("model", "source").agg(F.count("*").alias("rows"), F.count_distinct("cell").alias("cells")).collect()
    records = [{"key": f"model={c.model}/source={c.source}", "status": "COMPLETE", "counts": {"rows": c.rows, "cells": c.cells}} for c in counts]
    path = new_path(spark, "manifest")
    files.write_manifest(files.manifest(spark, records), path)
    d = spark.read.schema("key string, status string, record string").json(path)
    return d.select("key", "status", *[F.get_json_object("record", f"$.counts.{n}").cast("long").alias(n) for n in ("rows", "cells")])


@query(f"""{A}, n AS (SELECT model, source, count(*) AS rows FROM a GROUP BY ALL) SELECT 'models' AS figure, 'model;source;rows' AS columns, count(*) AS rows FROM n UNION ALL SELECT 'cells', 'cell;lat;lon', count(*) FROM (SELECT DISTINCT cell, lat, lon FROM a)""")
def figure_tables(spark, sf_dir):
    """What figures are drawn from, by name."""
    d = reused(monthly(spark, sf_dir))
    return files.figure_manifest(spark, {"models": d.groupBy("model", "source").agg(F.count("*").alias("rows")), "cells": d.select("cell", "lat", "lon").distinct()})


@query(f"""{A}, n AS (SELECT model, source, count(*) AS rows FROM a GROUP BY ALL) SELECT '| ' || model || ' | ' || source || ' | ' || rows || ' |' AS line FROM n UNION ALL SELECT unnest(['# Runs', 'All of them.', '## Rows', '| model | source | rows |', '|---|---|---|'])""")
def report_lines(spark, sf_dir):
    """The lines of a report in Markdown."""
    d = monthly(spark, sf_dir).groupBy("model", "source").agg(F.count("*").alias("rows"))
    text = files.report("Runs", {"Rows": d.orderBy("model", "source")}, ["All of them."])
    return spark.createDataFrame([(x,) for x in text.split("\n") if x], "line string")


@query(f"{A}, c AS (SELECT DISTINCT cell FROM a WHERE weight > 0) SELECT {r('count(*) * 96.0')} AS area, count(*) AS cells FROM c")
def union_of_cells(spark, sf_dir):
    """The border of all cells that count, of which there are as many as a grid has, and what it holds (in square degrees)."""
    d = reused(monthly(spark, sf_dir))
    cells = boxes(d).join(d.where("weight > 0").select("cell").distinct(), "cell").collect()
    rings = files.union_of_rings([[(c.west, c.south), (c.east, c.south), (c.east, c.north), (c.west, c.north)] for c in cells])
    area = sum(a[0] * b[1] - b[0] * a[1] for x in rings for a, b in zip(x, [*x[1:], x[0]])) / 2
    return out(spark.createDataFrame([(float(area), len(cells))], "area double, cells long"), [], ["area"], ["cells"])
