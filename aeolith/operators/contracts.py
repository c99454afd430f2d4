"""Checks that return what is wrong as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.functions.months import month_label
from aeolith.functions.numeric import by_variable
from aeolith.functions.text import unit_allowed


def joined(names: Column) -> Column:
    """A sorted list as text; empty for none."""
    return F.array_join(F.array_sort(names), ";")


def expected_months(groups: DataFrame, first: int, last: int) -> DataFrame:
    return groups.withColumn("ym", F.explode(F.sequence(F.lit(first), F.lit(last))))


def month_issues(df: DataFrame, by: Sequence[str], first: int, last: int) -> DataFrame:
    """(by, ym, issue): missing, extra and duplicate months of each group."""
    got = df.groupBy(*by, "ym").agg(F.count("*").alias("__n"))
    want = expected_months(df.select(*by).distinct(), first, last)
    row = lambda d, issue: d.select(*by, "ym", F.lit(issue).alias("issue"))
    return row(want.join(got, [*by, "ym"], "left_anti"), "missing").unionByName(row(got.where(~F.col("ym").between(first, last)), "extra")).unionByName(row(got.where("__n > 1"), "duplicate"))


def month_coverage(df: DataFrame, by: Sequence[str], first: int, last: int) -> DataFrame:
    """(by, raw_months, unique_months, missing_months, duplicate_months, out_of_order, missing, status, status_by_count).

    ``status`` reports missing before duplicate months before a wrong number;
    ``status_by_count`` the number first, and last whether rows are in order (column ``place``).
    """
    got = df.groupBy(*by, "ym").agg(F.count("*").alias("__k"))
    want = expected_months(df.select(*by).distinct(), first, last)
    missing = want.join(got, [*by, "ym"], "left_anti").groupBy(*by).agg(F.count("*").alias("missing_months"), joined(F.collect_list(month_label(F.col("ym")))).alias("missing"))
    counts = got.groupBy(*by).agg(F.sum("__k").alias("raw_months"), F.count("*").alias("unique_months"), F.count_if(F.col("__k") > 1).alias("duplicate_months"))
    back = df.withColumn("__d", F.col("ym") - F.lag("ym").over(Window.partitionBy(*by).orderBy("place"))).groupBy(*by).agg(F.count_if(F.col("__d") < 0).alias("out_of_order"))
    d = counts.join(back, list(by)).join(missing, list(by), "left").na.fill({"missing_months": 0, "missing": ""})
    n = last - first + 1
    m, k = F.col("missing_months") > 0, F.col("duplicate_months") > 0
    wrong = F.col("raw_months") != n
    return d.withColumn("status", F.when(m, "MISSING_MONTHS").when(k, "DUPLICATE_MONTHS").when(wrong, "COUNT_MISMATCH").otherwise("OK")).withColumn(
        "status_by_count", F.when(wrong, "TIME_COUNT_MISMATCH").when(m, "MISSING_MONTHS").when(k, "DUPLICATE_MONTHS").when(F.col("out_of_order") > 0, "TIME_ORDER_MISMATCH").otherwise("OK")
    )


def first_of_month(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each month."""
    w = Window.partitionBy(*by, "ym").orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def gaps(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, consecutive, missing): whether months follow one another, and how many lie between."""
    d = df.select(*by, "ym").distinct().withColumn("__d", F.col("ym") - F.lag("ym").over(Window.partitionBy(*by).orderBy("ym")))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("__d") == 1), F.lit(True)).alias("consecutive"), F.coalesce(F.sum(F.col("__d") - 1), F.lit(0)).cast("long").alias("missing"))


def axis(df: DataFrame, by: Sequence[str], x: str, place: str) -> DataFrame:
    """(by, n, low, high, spacing, monotonic, regular) of axes as they are stored, in the order of ``place``:
    whether they strictly rise or strictly fall, the median size of a step, and whether all steps are alike."""
    d = df.select(*by, x, place).withColumn("__d", F.col(x) - F.lag(x).over(Window.partitionBy(*by).orderBy(place)))
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.percentile(F.abs("__d"), 0.5).alias("spacing"), F.min("__d").alias("__least"), F.max("__d").alias("__most"))
    one_way = F.coalesce((F.col("__least") > 0) | (F.col("__most") < 0), F.lit(True))
    alike = F.coalesce(F.abs(F.col("__most") - F.col("__least")) <= 1e-6, F.lit(True))
    return g.withColumn("monotonic", one_way).withColumn("regular", one_way & alike).drop("__least", "__most")


# Fixed values: (variable, fail below, warn below, warn above, fail above); None: no limit.
PHYSICAL_RANGE = (("tas", 150.0, 190.0, 370.0, 400.0), ("rsds", -1e-4, -1e-4, 500.0, 1000.0), ("wind", -1e-4, -1e-4, 50.0, 100.0))


def range_severity(variable: Column, low: Column, high: Column, limits=PHYSICAL_RANGE) -> Column:
    own = {}
    for v, fail_low, warn_low, warn_high, fail_high in limits:
        own[v] = F.when(low.isNull() | high.isNull() | (low < fail_low) | (high > fail_high), "FAIL").when((low < warn_low) | (high > warn_high), "WARNING").otherwise("PASS")
    return by_variable(variable, own)


def grids_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """One row: points on both sides, on one only, greatest difference, and whether the grids are equal."""
    both = a.select(*keys, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(1).alias("__a")).join(b.select(*keys, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(1).alias("__b")), list(keys), "full_outer")
    worst = F.greatest(*[F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}")) for v in values], F.lit(0.0))
    g = both.agg(F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("common"), F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("unmatched"), F.coalesce(F.max(worst), F.lit(0.0)).alias("max_difference"))
    return g.withColumn("equal", (F.col("unmatched") == 0) & (F.col("max_difference") <= tolerance))


def covers(source: DataFrame, target: DataFrame, by: Sequence[str], lat: str = "lat", lon: str = "lon", tolerance: float = 1e-8) -> DataFrame:
    """(by, covers): whether the box of the source's points holds that of the target's."""
    box = lambda d, p: d.groupBy(*by).agg(F.min(lat).alias(f"{p}s"), F.max(lat).alias(f"{p}n"), F.min(lon).alias(f"{p}w"), F.max(lon).alias(f"{p}e"))
    return box(source, "a").join(box(target, "b"), list(by)).select(*by, F.expr(f"`as` <= bs + {tolerance} and an >= bn - {tolerance} and aw <= bw + {tolerance} and ae >= be - {tolerance}").alias("covers"))


def grid_status(points: Column, is_1d: Column, failed: Column) -> Column:
    """The first of: could not be read, no coordinates, not one-dimensional, in order."""
    return F.when(failed, "FAILED").when(points.isNull() | (points == 0), "COORDINATE_MISSING").when(~is_1d, "NON_1D_GRID").otherwise("OK_1D")


def file_status(size: Column, opened: Column, variable: Column, time: Column, space: Column) -> Column:
    """A file's first fault: its size in bytes, whether it opened, and whether it has its variable and axes."""
    bad = lambda c: ~F.coalesce(c, F.lit(False))
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "ZERO_BYTE").when(bad(opened), "OPEN_FAILED").when(bad(variable), "VARIABLE_MISSING").when(bad(time), "TIME_MISSING").when(bad(space), "SPATIAL_COORD_MISSING").otherwise("OK")


def overlaps(first: Column, last: Column, a: Column | int, b: Column | int) -> Column:
    """Whether the closed periods first..last and a..b meet."""
    return (last >= a) & (first <= b)


def overlap_check(old: DataFrame, new: DataFrame, keys: Sequence[str], by: Sequence[str], x: str, limit: float = 1e-5, tiny: float = 1e-12) -> DataFrame:
    """(by, n, max_difference, changed, ok): two versions of a series where they overlap."""
    diff = F.abs(F.col(x) - F.col("__new"))
    j = old.select(*keys, x).join(new.select(*keys, F.col(x).alias("__new")), list(keys))
    return j.groupBy(*by).agg(F.count("*").alias("n"), F.max(diff).alias("max_difference"), F.count_if(diff > tiny).alias("changed"), (F.max(diff) <= limit).alias("ok"))


def exact_alignment(long: DataFrame, keys: Sequence[str], variables: Sequence[str], variable: str = "variable") -> DataFrame:
    """Keys that not every variable has exactly once: (keys, missing, repeated), lists of variables; no rows if all align."""
    n = lambda v: F.count_if(F.col(variable) == v)
    pick = lambda cond: F.array_join(F.filter(F.array(*[F.when(cond(v), v) for v in variables]), lambda x: x.isNotNull()), ";")
    g = long.groupBy(*keys).agg(pick(lambda v: n(v) == 0).alias("missing"), pick(lambda v: n(v) > 1).alias("repeated"))
    return g.where("missing <> '' or repeated <> ''")


def exact_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str], names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """(keys, only_in): keys that one side has and the other hasn't; no rows if both cover the same."""
    rows = a.select(*keys).distinct().withColumn("__a", F.lit(1)).join(b.select(*keys).distinct().withColumn("__b", F.lit(1)), list(keys), "full_outer")
    return rows.where("__a is null or __b is null").select(*keys, F.when(F.col("__b").isNull(), names[0]).otherwise(names[1]).alias("only_in"))


# Limits of sampled values.
SAMPLE_LIMITS = {"tas": (150.0, 350.0), "rsds": (-5.0, 1500.0), "wind": (0.0, 150.0)}


def _messages(found: Sequence[tuple[Column, Column | str]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(m) if isinstance(m, str) else m) for cond, m in found]), lambda x: x.isNotNull())


def _verdict(d: DataFrame, errors: Column, warnings: Column) -> DataFrame:
    """Errors beat warnings; all messages joined with a bar."""
    d = d.withColumn("__e", errors).withColumn("__w", warnings)
    status = F.when(F.size("__e") > 0, "FAILED").when(F.size("__w") > 0, "WARNING").otherwise("PASSED")
    return d.withColumn("status", status).withColumn("message", F.array_join(F.concat("__e", "__w"), " | ")).drop("__e", "__w")


def group_states(df: DataFrame, by: Sequence[str], place: str, x: str, unit: str, lat: str = "lat") -> DataFrame:
    """(by, months, units, repeated): all that an audit needs of a group of (ym, place, x, unit).

    ``months`` has a struct for each month, in order: ym, place, rows, finite, low, high.  Points of a month are added up first,
    then months, then groups, each by partial sums; a state has as many entries as a group has months.
    """
    point = [c for c in (lat, "cell", "lon") if c in df.columns and c not in by]
    one = df.groupBy(*by, "ym", *point).agg(F.count("*").alias("rows"), F.count(x).alias("finite"), F.min(place).alias("place"), F.min(x).alias("low"), F.max(x).alias("high"), F.collect_set(unit).alias("units"))
    month = one.groupBy(*by, "ym").agg(F.sum("rows").alias("rows"), F.sum("finite").alias("finite"), F.min("place").alias("place"), F.min("low").alias("low"), F.max("high").alias("high"), F.flatten(F.collect_set("units")).alias("units"), (F.max("rows") > 1).alias("repeated"))
    return month.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("ym", "place", "rows", "finite", "low", "high"))).alias("months"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("units")))).alias("units"), F.bool_or("repeated").alias("repeated"),
    )


def group_audit(df: DataFrame, by: Sequence[str], place: str, x: str, unit: str, lat: str = "lat", limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(by, time_count, first, last, units, sample_min, sample_max, finite_percent, status, message, months) of
    groups of (ym, place, x, unit); ``by`` has the column ``variable``.

    Values are looked at on the first, the middle and the last time step only.  Wrong: repeated or
    missing months, mixed or unknown units, values out of their limits, none finite.  Doubtful: months
    out of order, and less than 99 per cent finite.  All of it follows from the groups' states.
    """
    n = F.size("months")
    total = lambda xs, f: F.aggregate(xs, F.lit(0).cast("long"), lambda a, m: a + f(m))
    stored = F.array_sort(F.transform("months", lambda m: F.struct(m["place"].alias("place"), m["ym"].alias("ym"))))
    back = F.size(F.filter(F.transform("stored", lambda m, i: (i > 0) & (m["ym"] < F.get("stored", i - 1)["ym"])), lambda x: x))
    seen = F.transform(F.array_distinct(F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)), lambda i: F.get("months", i))
    d = group_states(df, by, place, x, unit, lat).withColumn("stored", stored).withColumn("seen", seen)
    first, last = F.get("months", F.lit(0))["ym"], F.get("months", n - 1)["ym"]
    d = d.select(
        *by, n.cast("long").alias("time_count"), first.alias("first"), last.alias("last"), (last - first + 1 - n).cast("long").alias("__gaps"), back.alias("__disorder"), "repeated", F.col("units").alias("__units"),
        F.array_min(F.transform("seen", lambda m: m["low"])).alias("sample_min"), F.array_max(F.transform("seen", lambda m: m["high"])).alias("sample_max"),
        (100 * total("seen", lambda m: m["finite"]) / total("seen", lambda m: m["rows"])).alias("finite_percent"), F.transform("months", lambda m: m["ym"]).alias("months"),
    )
    low = by_variable(F.col("variable"), {v: a for v, (a, _) in (limits or SAMPLE_LIMITS).items()})
    high = by_variable(F.col("variable"), {v: b for v, (_, b) in (limits or SAMPLE_LIMITS).items()})
    one = F.size("__units") == 1
    errors = _messages([
        (F.col("repeated"), "a month stands there twice"), (F.col("__gaps") > 0, F.format_string("%d months lack between the first and the last", "__gaps")),
        (~one, F.concat(F.lit("several units: "), F.array_join("__units", ", "))), (one & ~unit_allowed(F.col("variable"), F.get("__units", F.lit(0))), F.concat(F.lit("not a unit of this variable: "), F.get("__units", F.lit(0)))),
        (F.col("sample_min") < low, "sampled values under the limit"), (F.col("sample_max") > high, "sampled values over the limit"), (F.col("sample_min").isNull(), "no sampled value is finite"),
    ])
    warnings = _messages([(F.col("__disorder") > 0, "months are not stored in order"), (F.col("finite_percent") < 99, F.format_string("%.3f per cent of sampled values are finite", "finite_percent"))])
    d = _verdict(d.withColumn("units", F.array_join("__units", "; ")), errors, warnings)
    return d.select(*by, "time_count", "first", "last", "units", "sample_min", "sample_max", "finite_percent", "status", "message", "months")


def pair_audit(audits: DataFrame, rows: DataFrame, by: Sequence[str], side: str, model: str, reference: str, grid: Sequence[str] = ("lat", "lon")) -> DataFrame:
    """(by, status, message): audited groups of both sides as pairs, told apart by ``side``, given their audits and their
    rows (grid): either failed, grids that differ, reference months that the model lacks, units that differ."""
    point = F.xxhash64(*grid)
    shape = rows.where(F.col(side).isin(model, reference)).select(side, *by, *grid).distinct().groupBy(*by)
    of = lambda s: F.struct(F.count_if(F.col(side) == s).alias("n"), F.bit_xor(F.when(F.col(side) == s, point)).alias("x"), F.sum(F.when(F.col(side) == s, point.cast("decimal(20,0)"))).alias("s"))
    shape = shape.agg((of(model) != of(reference)).alias("__unlike"))
    what = F.struct("status", "units", "months")
    own = lambda s: F.max_by(what, F.when(F.col(side) == s, F.lit(1)))
    d = audits.groupBy(*by).agg(own(model).alias("m"), own(reference).alias("r"), F.count_if(F.col(side) == model).alias("__m"), F.count_if(F.col(side) == reference).alias("__r"))
    d = d.where("__m > 0 and __r > 0").join(shape, list(by)).withColumn("__absent", F.size(F.array_except("r.months", "m.months")))
    errors = _messages([
        (F.col("m.status") == "FAILED", "the model's own audit failed"), (F.col("r.status") == "FAILED", "the reference's own audit failed"), (F.col("__unlike"), "unlike grids"),
        (F.col("__absent") > 0, F.format_string("%d of the reference's months lack", "__absent")), (F.col("m.units") != F.col("r.units"), "unlike units"),
    ])
    return _verdict(d, errors, F.expr("cast(array() as array<string>)")).select(*by, "status", "message")


def holders_of_all(df: DataFrame, holder: str, item: str, items: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Relational division: the holders that have every one of ``items``."""
    need = items.select(F.countDistinct(item).alias("__need"))
    have = df.where(~F.col(holder).isin(*exclude)) if exclude else df
    return have.join(items.select(item).distinct(), item).groupBy(holder).agg(F.countDistinct(item).alias("n")).crossJoin(F.broadcast(need)).where("n = __need").drop("__need")


def replace_rows(main: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``main`` whose keys aren't in ``new``, and all of ``new``."""
    return main.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def not_done(jobs: DataFrame, manifest: DataFrame, keys: Sequence[str], status: str = "status", done: str = "COMPLETE", force: bool = False) -> DataFrame:
    """The jobs that no finished manifest row covers."""
    return jobs if force else jobs.join(manifest.where(F.col(status) == done).select(*keys), list(keys), "left_anti")
