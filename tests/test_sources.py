"""Grid files that are made by hand, and the layout of stored cubes."""

import glob
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from aeolith.sources import files, netcdf


def classic(path, version, variables, lat, lon, time, units, calendar, record=True, single=False):
    """A file of the classic format: big-endian, names and values padded to four bytes."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    number = {"f4": 5, "f8": 6, "i2": 3, "i4": 4}

    def attribute(k, v):
        if isinstance(v, str):
            return text(k) + struct.pack(">ii", 2, len(v)) + pad(v.encode())
        a = np.asarray([v[1]], ">" + v[0])
        return text(k) + struct.pack(">ii", number[v[0]], 1) + pad(a.tobytes())

    listed = lambda tag, items: struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)
    dims = [("time", 0 if record else len(time)), ("lat", len(lat)), ("lon", len(lon))]
    kinds = [("lat", (1,), "f8", {}, np.asarray(lat)), ("lon", (2,), "f8", {}, np.asarray(lon))]
    if not single:
        kinds.append(("time", (0,), "f8", {"units": units, "calendar": calendar}, np.asarray(time, float)))
    kinds += [(n, (0, 1, 2), k, a, x) for n, k, a, x in variables]
    kinds = [(n, d, k, a, np.asarray(x).astype(">" + k)) for n, d, k, a, x in kinds]
    with_records = [x for x in kinds if record and x[1][0] == 0]

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", len(time) if record else 0)
        out += listed(10, [text(n) + struct.pack(">i", s) for n, s in dims]) + listed(12, [attribute("title", "made by hand")])
        items = []
        for (n, d, k, a, x), at in zip(kinds, begins):
            one = x.nbytes // (len(time) if record and d[0] == 0 else 1)
            items.append(text(n) + struct.pack(f">i{len(d)}i", len(d), *d) + listed(12, [attribute(*i) for i in a.items()]) + struct.pack(">ii", number[k], one + -one % 4) + struct.pack(">i" if version == 1 else ">q", at))
        return out + listed(11, items)

    at, begins, body, where = len(header([0] * len(kinds))), [], b"", {}
    for n, d, k, a, x in kinds:
        begins.append(at)
        if (n, d, k) not in [(r[0], r[1], r[2]) for r in with_records]:
            where[n] = [(at, at + x.nbytes)]
            body += pad(x.tobytes())
            at += len(pad(x.tobytes()))
        else:
            begins[-1] = None
    base, size = at, 0
    for i, (n, d, k, a, x) in enumerate(kinds):
        if begins[i] is None:
            begins[i] = base + size
            size += x[0].nbytes if len(with_records) == 1 else len(pad(x[0].tobytes()))
    for n, d, k, a, x in with_records:
        i = [q[0] for q in kinds].index(n)
        where[n] = [(begins[i] + r * size, begins[i] + r * size + x[r].nbytes) for r in range(len(time))]
    for r in range(len(time) if record else 0):
        body += b"".join(x[r : r + 1].tobytes() if len(with_records) == 1 else pad(x[r : r + 1].tobytes()) for _, _, _, _, x in with_records)
    path.write_bytes(header(begins) + body)
    return where


@pytest.mark.parametrize("version,record", [(1, True), (2, True), (2, False)])
def test_classic_files(spark, tmp_path, version, record):
    lat, lon, n = [10.0, 12.0, 14.0], [70.0, 72.5], 40
    g = np.random.default_rng(version)
    tas = g.normal(280, 5, (n, 3, 2)).astype("f4")
    tas[3, 1, 1] = 1e20
    rsds = g.integers(-100, 3000, (n, 3, 2))
    rsds[5, 0, 0] = -32768
    time = 15.0 + 30 * np.arange(n)
    variables = [("tas", "f4", {"_FillValue": ("f4", 1e20), "units": "K"}, tas), ("extra", "i2", {}, np.zeros((n, 3, 2), int)), ("rsds", "i2", {"scale_factor": ("f8", 0.1), "add_offset": ("f8", 200.0), "_FillValue": ("i2", -32768)}, rsds)]
    where = classic(tmp_path / "a.nc", version, variables, lat, lon, time, "days since 2015-01-01", "360_day", record)
    path = str(tmp_path / "a.nc")
    d = netcdf.read_netcdf(spark, [path], ["rsds", "tas"], block=7)
    assert d.columns == ["file", "ym", "lat", "lon", "rsds", "tas"] and d.rdd.getNumPartitions() == 6
    got = {(r.ym, r.lat, r.lon): (r.tas, r.rsds) for r in d.collect()}
    assert len(got) == n * 6
    for k in range(n):
        for i, y in enumerate(lat):
            for j, x in enumerate(lon):
                a, b = got[2015 * 12 + k, y, x]
                assert a == (None if (k, i, j) == (3, 1, 1) else float(tas[k, i, j])) and b == (None if (k, i, j) == (5, 0, 0) else pytest.approx(rsds[k, i, j] * 0.1 + 200))
    part = netcdf.read_netcdf(spark, [path, path], ["tas"], (2015 * 12 + 8, 2015 * 12 + 10), block=2)
    assert part.rdd.getNumPartitions() == 4 and sorted({r.ym - 2015 * 12 for r in part.collect()}) == [8, 9, 10] and part.count() == 36
    assert netcdf.read_netcdf(spark, [path], ["tas"], (0, 5)).count() == 0
    with pytest.raises(Exception, match="has no pr"):
        netcdf.read_netcdf(spark, [path], ["pr"]).count()

    class Watched:
        """Notes what is read."""

        def __init__(self, f):
            self.f, self.seen = f, []

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            self.seen.append((self.f.tell(), self.f.tell() + n))
            return self.f.read(n)

    with open(path, "rb") as f:
        h, w = netcdf.read_header(f), Watched(f)
        list(netcdf.read_block(w, h, path, 4, [1, 2], ["rsds"], "lat", "lon"))
    apart = lambda name: all(b <= x or y <= a for a, b in w.seen for x, y in where[name])
    assert apart("tas") and apart("extra") and not apart("rsds") and (not record or sum(b - a for a, b in w.seen) == 2 * 12 + 8 * 5)


def test_months_of_calendars():
    days = np.array([0.0, 30.9, 31.0, 58.5, 59.0, 59.9999999, 365.0, 366.0])
    assert (netcdf.months(days, "days since 2016-01-01 00:00:00", "noleap") - 2016 * 12).tolist() == [0, 0, 1, 1, 2, 2, 12, 12]
    assert (netcdf.months(days, "days since 2016-01-01", "standard") - 2016 * 12).tolist() == [0, 0, 1, 1, 1, 2, 11, 12]
    assert (netcdf.months(days * 24, "hours since 2016-1-1", "360_day") - 2016 * 12).tolist() == [0, 1, 1, 1, 1, 2, 12, 12]
    assert (netcdf.months([0, -1, 59], "days since 2001-01-01", "all_leap") - 2001 * 12).tolist() == [0, -1, 1]
    assert netcdf.months([12], "hours since 1999-12-31 12:00", "proleptic_gregorian").tolist() == [2000 * 12]
    for bad in (("fortnights since 2000-01-01", "standard"), ("days since 2000-01-01", "julian")):
        with pytest.raises(ValueError):
            netcdf.months([0], *bad)


def test_other_files_are_errors(tmp_path):
    (tmp_path / "x.nc").write_bytes(b"\x89HDF\r\n\x1a\n" + b"\0" * 100)
    with open(tmp_path / "x.nc", "rb") as f, pytest.raises(ValueError, match="not a classic"):
        netcdf.read_header(f)


def test_layout_of_cubes(spark, tmp_path):
    """Large combinations are split by blocks of time, each file bounded, and reads prune by month."""
    d = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("model"), F.lit("x").alias("scenario"), (F.col("id") % 600).alias("ym"), (F.col("id") % 97).alias("cell"), F.rand(1).alias("v"))
    files.write_cube(d, str(tmp_path), rows=4_000)
    assert spark.read.parquet(str(tmp_path)).count() == 60_000
    parts = {m: glob.glob(f"{tmp_path}/model={m}/scenario=x/*/*.parquet") for m in ("small", "large")}
    rows = {m: [pq.read_metadata(p).num_rows for p in ps] for m, ps in parts.items()}
    assert len(parts["large"]) >= 14 and max(rows["large"] + rows["small"]) <= 4_000
    spans = []
    for p in parts["large"]:
        at = pq.ParquetFile(p).schema.names.index("ym")
        s = [pq.ParquetFile(p).metadata.row_group(k).column(at).statistics for k in range(pq.read_metadata(p).num_row_groups)]
        spans += [(x.min, x.max) for x in s]
    assert all(b - a < files.TIME_BLOCK for a, b in spans) and sum(a <= 30 <= b for a, b in spans) <= len(spans) / 4
    plan = spark.read.parquet(str(tmp_path)).where("ym between 24 and 35 and model = 'large'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ym), GreaterThanOrEqual(ym,24), LessThanOrEqual(ym,35)]" in plan


def test_joining_in_time_sorts_no_more_than_a_series(spark):
    part = lambda a, b: spark.range(a, b).select(F.lit("m").alias("model"), F.col("id").alias("ym"))
    d = files.joined_in_time([part(5, 9), part(0, 5)], ["model"])
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "], true" not in plan and "Sort" in plan
