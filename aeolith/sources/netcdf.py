"""Classic NetCDF files (CDF-1 and CDF-2) as a Spark data source, without any library of the format.

``read_netcdf(spark, paths, variables, months)`` gives (file, ym, lat, lon, variables): a row for each month and point.  The driver
reads headers and time axes; a task reads a block of records, and of these only the bytes of the wanted variables,
wherever other variables lie between them.  Blocks outside ``months`` aren't read at all.  Months come from the file's
own calendar by arithmetic, so 360-day and no-leap years need no dates.  Fill values and values that aren't finite are NULL; scale and
offset are applied.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aeolith.ship import ship

# The format's tags and types.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Records that one task reads.
BLOCK = 24


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    kind: str
    begin: int
    size: int = 0  # of one record, or of all if it has no records


@dataclass
class Header:
    records: int
    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable] = field(default_factory=dict)
    record_size: int = 0
    record_dim: int = -1

    def has_records(self, v: Variable) -> bool:
        return bool(v.dims) and v.dims[0] == self.record_dim

    def shape(self, v: Variable) -> list[int]:
        """Of one record, or of all."""
        return [self.dims[d][1] for d in v.dims[1 if self.has_records(v) else 0 :]]


def opened(path: str):
    """A file of the local system, or of any store that Arrow knows."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(re.sub(r"^file:(//)?", "", path), "rb")


def read_header(f) -> Header:
    """The header of an open file."""
    magic = f.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a classic NetCDF file")
    number = lambda: struct.unpack(">i", f.read(4))[0]
    offset = number if magic[3] == 1 else lambda: struct.unpack(">q", f.read(8))[0]

    def padded(n: int) -> bytes:
        return f.read(n + -n % 4)[:n]

    def listed(tag: int, one) -> list:
        got, n = number(), number()
        if got not in (0, tag) or (got == 0 and n):
            raise ValueError(f"tag {got} where {tag} should be")
        return [one() for _ in range(n)]

    text = lambda: padded(number()).decode()

    def attribute():
        name, kind, n = text(), number(), number()
        raw = padded(n * np.dtype(TYPES[kind]).itemsize)
        return name, raw.decode(errors="replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()

    def variable():
        name, dims = text(), tuple(number() for _ in range(number()))
        attributes, kind, _ = dict(listed(ATTRIBUTE, attribute)), TYPES[number()], number()
        return Variable(name, dims, attributes, kind, offset())

    h = Header(number(), listed(DIMENSION, lambda: (text(), number())), dict(listed(ATTRIBUTE, attribute)))
    h.record_dim = next((i for i, (_, n) in enumerate(h.dims) if n == 0), -1)
    h.variables = {v.name: v for v in listed(VARIABLE, variable)}
    with_records = [v for v in h.variables.values() if h.has_records(v)]
    for v in h.variables.values():
        v.size = int(np.prod(h.shape(v), dtype=np.int64)) * np.dtype(v.kind).itemsize
    # records of several variables lie one after another, each at a multiple of four
    h.record_size = with_records[0].size if len(with_records) == 1 else sum(v.size + -v.size % 4 for v in with_records)
    return h


def values(f, h: Header, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
    """A variable's values, or those of some records: only these bytes are read."""
    v = h.variables[name]
    if not h.has_records(v):
        f.seek(v.begin)
        return np.frombuffer(f.read(v.size), v.kind).reshape(h.shape(v))
    rows = []
    for r in range(first, first + (h.records - first if count is None else count)):
        f.seek(v.begin + r * h.record_size)
        rows.append(np.frombuffer(f.read(v.size), v.kind))
    return np.stack(rows).reshape([len(rows), *h.shape(v)]) if rows else np.zeros([0, *h.shape(v)], v.kind)


def unpacked(raw: np.ndarray, attributes: dict) -> np.ndarray:
    """As doubles, with NaN for fill values."""
    one = lambda k: attributes[k][0] if k in attributes else None
    x = raw.astype(float)
    for k in ("_FillValue", "missing_value"):
        if one(k) is not None:
            x[raw == np.asarray(one(k), raw.dtype)] = np.nan
    x[np.abs(x) > 9e36] = np.nan  # the format's own fill value
    return x * (one("scale_factor") or 1.0) + (one("add_offset") or 0.0)


_UNIT_DAYS = {"day": 1.0, "hour": 1 / 24, "minute": 1 / 1440, "second": 1 / 86400}
_STARTS = np.cumsum([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30])


def months(time: np.ndarray, units: str, calendar: str = "standard") -> np.ndarray:
    """Months (12 * year + month - 1) of times since a date, by a calendar's own arithmetic."""
    m = re.match(r"\s*(day|hour|minute|second)s?\s+since\s+(-?\d+)-(\d+)-(\d+)(?:[T ]+(\d+)(?::(\d+))?(?::(\d+(?:\.\d+)?))?)?", units)
    if not m:
        raise ValueError(f"unknown units of time: {units}")
    year, month, day = (int(m[k]) for k in (2, 3, 4))
    part = int(m[5] or 0) / 24 + int(m[6] or 0) / 1440 + float(m[7] or 0) / 86400
    days = np.asarray(time, float) * _UNIT_DAYS[m[1]] + part
    if calendar == "360_day":
        d = np.floor(days + 1e-6).astype(np.int64) + day - 1 + 30 * (12 * year + month - 1)
        return d // 30
    if calendar in ("noleap", "365_day", "all_leap", "366_day"):
        starts = _STARTS + (np.arange(12) > 1) * (calendar in ("all_leap", "366_day"))
        length = 365 + (calendar in ("all_leap", "366_day"))
        d = np.floor(days + 1e-6).astype(np.int64) + length * year + starts[month - 1] + day - 1
        return 12 * (d // length) + np.searchsorted(starts, d % length, side="right") - 1
    if calendar not in ("standard", "gregorian", "proleptic_gregorian"):
        raise ValueError(f"unknown calendar: {calendar}")
    start = np.datetime64(f"{year:04d}-{month:02d}-{day:02d}", "D")
    return (start + np.floor(days + 1e-6).astype("timedelta64[D]")).astype("datetime64[M]").astype(np.int64) + 1970 * 12


def month_axis(f, h: Header) -> np.ndarray:
    t = h.variables["time"]
    return months(values(f, h, "time"), t.attributes["units"], t.attributes.get("calendar", "standard").lower())


@dataclass
class Block(InputPartition):
    path: str
    first: int
    months: tuple[int, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.variables = options["variables"].split(",")
        self.lat, self.lon = options.get("lat", "lat"), options.get("lon", "lon")
        self.first, self.last = (int(options[k]) if k in options else None for k in ("first", "last"))
        self.block = int(options.get("block", BLOCK))

    def partitions(self) -> list[Block]:
        out = []
        for path in self.paths:
            with opened(path) as f:
                h = read_header(f)
                missing = [v for v in (*self.variables, "time", self.lat, self.lon) if v not in h.variables]
                if missing:
                    raise ValueError(f"{path} has no {', '.join(missing)}")
                ym = month_axis(f, h)
            wanted = np.flatnonzero((ym >= (self.first if self.first is not None else ym.min(initial=0))) & (ym <= (self.last if self.last is not None else ym.max(initial=0))))
            for k in range(0, len(wanted), self.block):
                run = wanted[k : k + self.block]
                # months of a file are in order, so a block is a stretch
                for part in np.split(run, np.flatnonzero(np.diff(run) != 1) + 1):
                    out.append(Block(path, int(part[0]), tuple(int(x) for x in ym[part])))
        return out or [Block("", 0, ())]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.months:
            return
        with opened(partition.path) as f:
            h = read_header(f)
            yield from read_block(f, h, partition.path, partition.first, partition.months, self.variables, self.lat, self.lon)


def read_block(f, h: Header, path: str, first: int, ym: Sequence[int], variables: Sequence[str], lat: str, lon: str) -> Iterator[pa.RecordBatch]:
    """A batch for each month."""
    axes = [values(f, h, a).astype(float) for a in (lat, lon)]
    la, lo = (x.ravel() for x in np.meshgrid(*axes, indexing="ij"))
    names = [n for n, _ in h.dims]
    for k, month in enumerate(ym):
        columns = []
        for name in variables:
            v = h.variables[name]
            own = [names[d] for d in v.dims]
            if own not in (["time", lat, lon], ["time", lon, lat]):
                raise ValueError(f"{path}: {name} is by {', '.join(own)}")
            grid = unpacked(values(f, h, name, first + k, 1)[0] if h.has_records(v) else values(f, h, name)[first + k], v.attributes)
            x = (grid if own[1] == lat else grid.T).ravel()
            columns.append(pa.array(x, mask=~np.isfinite(x)))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(la)), pa.array(np.full(len(la), month, np.int64)), pa.array(la), pa.array(lo), *columns], ["file", "ym", "lat", "lon", *variables])


class ClassicNetcdf(DataSource):
    """``spark.read.format("classic_netcdf")`` with options paths (by line), variables (by comma), first, last, block, lat, lon."""

    @classmethod
    def name(cls) -> str:
        return "classic_netcdf"

    def schema(self) -> str:
        return "file string, ym bigint, lat double, lon double, " + ", ".join(f"`{v}` double" for v in self.options["variables"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_netcdf(spark: SparkSession, paths: Sequence[str], variables: Sequence[str], months: tuple[int, int] | None = None, block: int = BLOCK, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """(file, ym, lat, lon, variables) of classic files; ``months``: the first and the last that are wanted."""
    ship(spark)
    spark.dataSource.register(ClassicNetcdf)
    r = spark.read.format("classic_netcdf").option("paths", "\n".join(paths)).option("variables", ",".join(variables)).option("block", str(block)).option("lat", lat).option("lon", lon)
    if months:
        r = r.option("first", str(months[0])).option("last", str(months[1]))
    return r.load()
