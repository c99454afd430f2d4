"""Readers and writers of tables, listings and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aeolith.sources.overlay import union_of_rings  # noqa: F401


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and perhaps a byte order mark (which Spark would keep in the first name):
    columns are found by their names, in whatever order they stand; an error if one is missing."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    wanted = StructType.fromDDL(schema).fields
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


#: Rows of the largest table that is written as one file.
ONE_FILE_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV with a header, one file for tables of reports; an error if there are no rows."""
    df = df.persist()
    try:
        n = df.limit(ONE_FILE_ROWS + 1).count()
        if not n:
            raise ValueError("no rows to write")
        (df.coalesce(1) if n <= ONE_FILE_ROWS else df).write.mode("overwrite").csv(path, header=True)
    finally:
        df.unpersist()


def joined_in_time(parts: Sequence[DataFrame], keys: Sequence[str], order: str = "ym") -> DataFrame:
    """The files of one series as one, each series in one partition by time; an error if a time stands in two of them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = out.groupBy(*keys, order).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys, order).limit(5).collect()
    if twice:
        raise ValueError(f"times that stand in several files: {[tuple(r) for r in twice]}")
    return out.repartition(*keys).sortWithinPartitions(*keys, order)


def union_of_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


#: Months that lie together in a stored cube, and rows of a file at most.
TIME_BLOCK, FILE_ROWS = 120, 4_000_000


def write_cube(df: DataFrame, path: str, by: Sequence[str] = ("model", "scenario"), order: str = "ym", rows: int = FILE_ROWS) -> None:
    """A cube in Parquet, partitioned by its keys and ``time_block``, so that reads prune by keys and months: a file has a
    stretch of at most ``TIME_BLOCK`` months, in order, and at most ``rows`` rows.

    Blocks are dealt by a rebalance, which splits those that are too large for a task and joins those that are small.
    """
    d = df.withColumn("time_block", F.floor(F.col(order) / TIME_BLOCK).cast("int")).hint("rebalance", *by, "time_block")
    d = d.sortWithinPartitions(*by, "time_block", order)
    d.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy(*by, "time_block").parquet(path)


def manifest(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Nested run records (config, inputs, outputs, counts) as rows of JSON with key and status."""
    import json

    return spark.createDataFrame([(str(r["key"]), str(r.get("status", "")), json.dumps(r, sort_keys=True)) for r in rows], "key string, status string, record string")


def write_manifest(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def one_match(paths: DataFrame, key: Sequence[str], name: str = "path") -> DataFrame:
    """Keys with no or several files, which are errors: (key, matches, files)."""
    g = paths.groupBy(*key).agg(F.count(name).alias("matches"), F.array_join(F.array_sort(F.collect_set(name)), ";").alias("files"))
    return g.where("matches <> 1")


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report's table: ``limit`` rows for reading, and how many more there are."""
    rows = df.limit(limit + 1).collect()
    head = f"## {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    body = "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in rows[:limit])
    more = f"\n{df.count() - limit} more rows are not shown.\n" if len(rows) > limit else ""
    return head + body + more


def report(title: str, tables: dict[str, DataFrame], notes: Sequence[str] = ()) -> str:
    """A Markdown report: notes, then the tables by name."""
    return f"# {title}\n\n" + "".join(f"{n}\n\n" for n in notes) + "\n".join(markdown(d, name) for name, d in tables.items())


def figure_manifest(spark: SparkSession, figures: dict[str, DataFrame]) -> DataFrame:
    """(figure, columns, rows) of the tables that figures are drawn from."""
    return spark.createDataFrame([(name, ";".join(d.columns), d.count()) for name, d in figures.items()], "figure string, columns string, rows long")


def read_rings(path: str) -> list[list[tuple[float, float]]]:
    """A boundary from GeoJSON (Polygon or MultiPolygon): its rings."""
    import json

    with open(path, encoding="utf-8") as f:
        g = json.load(f)
    shapes = [x["geometry"] for x in g["features"]] if g.get("type") == "FeatureCollection" else [g.get("geometry", g)]
    rings = []
    for s in shapes:
        for polygon in [s["coordinates"]] if s["type"] == "Polygon" else s["coordinates"]:
            rings += [[(float(x), float(y)) for x, y, *_ in ring[:-1]] for ring in polygon]
    return rings


def read_shapefile(path: str) -> list[list[tuple[float, float]]]:
    """Polygon rings of a .shp file; its .shx, .dbf and .prj must lie beside it."""
    import os
    import struct

    base = path[:-4] if path.endswith(".shp") else path
    missing = [e for e in (".shp", ".shx", ".dbf", ".prj") if not os.path.exists(base + e)]
    if missing:
        raise FileNotFoundError(f"{base}: no {', '.join(missing)}")
    with open(base + ".shp", "rb") as f:
        data = f.read()
    rings, at = [], 100
    while at + 12 <= len(data):
        size = 2 * struct.unpack(">i", data[at + 4 : at + 8])[0]
        record, at = data[at + 8 : at + 8 + size], at + 8 + size
        if struct.unpack("<i", record[:4])[0] not in (5, 15, 25):
            continue
        n_parts, n_points = struct.unpack("<2i", record[36:44])
        starts = [*struct.unpack(f"<{n_parts}i", record[44 : 44 + 4 * n_parts]), n_points]
        xy = struct.unpack(f"<{2 * n_points}d", record[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        rings += [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b - 1)] for a, b in zip(starts, starts[1:])]
    return rings


def select_features(features: Sequence[dict], code: str, wanted: Sequence[str]) -> list[dict]:
    """The features with these codes; each must be there exactly once."""
    found = {w: [f for f in features if f["properties"].get(code) == w] for w in wanted}
    wrong = {w: len(f) for w, f in found.items() if len(f) != 1}
    if wrong:
        raise ValueError(f"not exactly one feature: {wrong}")
    return [f[0] for f in found.values()]


def opened(xr, path: str, names: Sequence[str]):
    """The dataset of a file, with dates of its own calendar; GRIB groups that hold ``names`` are merged."""
    if path.endswith((".grib", ".grb", ".grib2")):
        parts, missing = [], list(names)
        for ds in xr.open_datatree(path, engine="cfgrib").values() if hasattr(xr, "open_datatree") else [xr.open_dataset(path, engine="cfgrib")]:
            own = [n for n in missing if n in ds]
            if own:
                parts.append(ds[own])
                missing = [n for n in missing if n not in own]
        if missing:
            raise ValueError(f"{path} has no {', '.join(missing)}")
        return xr.merge(parts, compat="override")
    try:
        return xr.open_dataset(path, decode_times=xr.coders.CFDatetimeCoder(use_cftime=True))
    except (AttributeError, ImportError):  # no such decoder: the default dates
        return xr.open_dataset(path, decode_times=True)


def ingest_netcdf(spark: SparkSession, paths: Sequence[str], variables: Sequence[str], to: str, by: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """NetCDF or GRIB files as one long Parquet table (ym, by, variables), file by file on the executors.

    Needs xarray with a reader of the format, which is not part of this package; months are
    taken as year and month of the file's own calendar, decoded to cftime dates where there is
    such a decoder.  Of a GRIB file each variable is read from the group that holds it.
    """
    try:
        import xarray  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading NetCDF or GRIB needs xarray") from e
    names = list(variables)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xarray as xr

        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(xr, path, names) as ds:
                    t = ds["time"].dt
                    ym = (t.year * 12 + t.month - 1).values
                    for k in range(len(ym)):
                        grids = [ds[v].isel(time=k).transpose(*by).values.astype(float) for v in names]
                        axes = np.meshgrid(*[ds[b].values.astype(float) for b in by], indexing="ij")
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(grids[0].size, ym[k], np.int64)), *[pa.array(a.ravel()) for a in axes], *[pa.array(g.ravel()) for g in grids]], ["ym", *by, *names])

    schema = ", ".join(["ym bigint", *[f"{b} double" for b in by], *[f"{v} double" for v in names]])
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    listed.mapInArrow(run, schema).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)
