"""Runs: what is to do, whether inputs are fit, and whether outputs are right, as rows (``batch`` runs them)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeolith.functions.months import month_label
from aeolith.functions.text import unit_allowed
from aeolith.operators.contracts import group_states, range_severity


def combinations(*parts: DataFrame) -> DataFrame:
    """All combinations of small registries (models, scenarios, variables): a few dozen rows each."""
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def download_jobs(groups: DataFrame, files: str = "matching_files", sep: str = ";") -> DataFrame:
    """One row for each file of a group's list, in order."""
    return groups.select(*[c for c in groups.columns if c != files], F.posexplode(F.split(files, sep)).alias("place", "file")).where("file <> ''")


# How files of climate data begin.
SIGNATURES = (b"CDF", b"\x89HDF", b"GRIB")


def download_state(size: Column, part: Column, wanted: Column, head: Column) -> Column:
    """What is to be done for a file, from the bytes of the file and of its unfinished part (NULL: not there), the
    bytes that it should have (NULL: not known), and its first bytes: nothing (COMPLETE), go on from the
    part (RESUME), begin again (a wrong size or beginning, or a part that is too long), or begin."""
    known = F.lit(False)
    for s in SIGNATURES:
        known = known | (F.substring(head, 1, len(s)) == F.lit(s))
    right = wanted.isNull() | (size == wanted)
    begun = F.when(part.isNull() | (part == 0), "MISSING").when(wanted.isNotNull() & (part > wanted), "RESTART").otherwise("RESUME")
    return F.when(size.isNull(), begun).when(~right, "BAD_SIZE").when(~F.coalesce(known, F.lit(False)), "BAD_SIGNATURE").otherwise("COMPLETE")


def validate(checks: dict[str, DataFrame]) -> DataFrame:
    """A dry run: (check, issues) for DataFrames of issues; nothing else is computed."""
    out = None
    for name, issues in checks.items():
        n = issues.agg(F.count("*").alias("issues")).select(F.lit(name).alias("check"), "issues")
        out = n if out is None else out.unionByName(n)
    return out


def reconstruction_issues(stored: DataFrame, keys: Sequence[str], formulas: dict[str, Column], rtol: float = 1e-5, atol: float = 1e-4) -> DataFrame:
    """(keys, variable, stored, expected) of values that their formula doesn't give."""
    pairs = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("stored"), e.cast("double").alias("expected")) for v, e in formulas.items()])
    d = stored.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    same = F.abs(F.col("stored") - F.col("expected")) <= atol + rtol * F.abs("expected")
    both_missing = F.col("stored").isNull() & F.col("expected").isNull()
    return d.where(~F.coalesce(same | both_missing, F.lit(False)))


def count_issues(df: DataFrame, by: Sequence[str], expected: int) -> DataFrame:
    """Groups whose number of rows isn't the expected one."""
    return df.groupBy(*by).agg(F.count("*").alias("rows")).where(F.col("rows") != expected).withColumn("expected", F.lit(expected))


def shared_part_issues(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys at which two outputs differ where they must be the same."""
    j = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), list(keys), "full_outer")
    return j.where(~F.coalesce(F.abs(F.col("__a") - F.col("__b")) <= tolerance, F.col("__a").isNull() & F.col("__b").isNull()))


def first_offenders(issues: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first few, for a message."""
    return issues.orderBy(*order).limit(n)


ISSUES = ("check", "severity", "item", "detail")


def issue(df: DataFrame, check: str, item: Sequence[str], detail: Column, severity: Column | str = "FAIL") -> DataFrame:
    """Rows that break a rule, as issues."""
    named = F.concat_ws("/", *[F.col(c).cast("string") for c in item])
    return df.select(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), named.alias("item"), detail.cast("string").alias("detail"))


def issues(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_corrected(three: DataFrame, by: Sequence[str], x: str = "y", months: int = 12, most_missing: float = 50.0) -> DataFrame:
    """Issues of corrected output (method, ``by``, variable, month, cell, value): physical ranges, negative
    values where there can be none, months that lack, and too many cells without a value."""
    g = ["method", *by, "variable"]
    v = F.col(x)
    d = three.groupBy(*g).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count_distinct("month").alias("months"), (100 * F.avg(v.isNull().cast("double"))).alias("missing"), F.count_if(v < 0).alias("negative"))
    severity = range_severity(F.col("variable"), F.col("low"), F.col("high"))
    can = F.col("variable").isin("rsds", "wind")
    return issues([
        issue(d.where(F.col("low").isNotNull()).withColumn("__s", severity).where("__s <> 'PASS'"), "PHYSICAL_RANGE", g, F.format_string("%.3f to %.3f", "low", "high"), F.col("__s")),
        issue(d.where(can & (F.col("negative") > 0)), "NEGATIVE_VALUES", g, F.col("negative")),
        issue(d.where(F.col("months") != months), "MONTH_COUNT", g, F.col("months")),
        issue(d.where((F.col("missing") > most_missing) | F.col("low").isNull()), "MISSING_VALUES", g, F.format_string("%.3f", "missing"), "WARNING"),
    ])


@dataclass(frozen=True)
class Expected:
    """What a run of corrections is to have given: methods, first and last month, settings by name, rows of each table for
    a combination, and the most of fallbacks and of clipped tails, in per cent, that don't call for a look."""

    methods: tuple[str, ...]
    first: int
    last: int
    settings: dict[str, str]
    table_rows: dict[str, int]
    most_fallback: float = 1.0
    most_tail: float = 50.0


def audit_production(rows: DataFrame, by: Sequence[str], expected: Expected, settings: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, x: str = "y") -> DataFrame:
    """Issues of a whole run of corrections.

    ``rows``: method, ``by``, variable, ym, cell, unit and the value; each output's checks follow from its state (``contracts.group_states``),
    which is made once.  ``settings``: (``by``, name, value) as runs have stored them.  ``tables``: what was written beside the outputs; each is
    to have ``by``, variable and its own keys, and those with shares (tail_percent, fallback_percent) are looked at.
    """
    g = ["method", *by, "variable"]
    n = F.size("months")
    total = lambda f: F.aggregate("months", F.lit(0).cast("long"), lambda a, m: a + f(m))
    d = group_states(rows, g, "ym", x, "unit", lat="cell")
    first, last = F.get("months", F.lit(0))["ym"], F.get("months", n - 1)["ym"]
    d = d.select(
        *g, "units", "repeated", n.alias("n"), first.alias("first"), last.alias("last"), (100 * total(lambda m: m["finite"]) / total(lambda m: m["rows"])).alias("finite"),
        F.array_min(F.transform("months", lambda m: m["low"])).alias("low"), F.array_max(F.transform("months", lambda m: m["high"])).alias("high"),
        F.size(F.array_distinct(F.transform("months", lambda m: m["rows"]))).alias("grids"),
    )
    d = d.withColumn("range", F.when(F.col("low").isNotNull(), range_severity(F.col("variable"), F.col("low"), F.col("high")))).withColumn("unit", F.when(F.size("units") == 1, F.get("units", F.lit(0))))
    length = expected.last - expected.first + 1
    found = [
        (F.col("n") != length, "MONTH_COUNT", "FAIL", F.format_string("%d for %d", "n", F.lit(length))),
        ((F.col("first") != expected.first) | (F.col("last") != expected.last), "MONTH_RANGE", "FAIL", F.concat(month_label(F.col("first")), F.lit(" to "), month_label(F.col("last")))),
        (F.col("repeated") | (F.col("n") != F.col("last") - F.col("first") + 1), "MONTH_SEQUENCE", "FAIL", F.lit("months that lack or stand twice")),
        (F.col("grids") > 1, "GRID_SIZE", "FAIL", F.lit("months have different numbers of cells")),
        (F.size("units") != 1, "UNIT_CONSISTENCY", "FAIL", F.array_join("units", ", ")),
        (F.col("unit").isNotNull() & ~unit_allowed(F.col("variable"), F.col("unit")), "UNIT_VALUE", "FAIL", F.col("unit")),
        (F.col("finite") < 99, "FINITE_SHARE", "FAIL", F.format_string("%.3f", "finite")),
        ((F.col("finite") >= 99) & (F.col("finite") < 100), "FINITE_SHARE", "WARNING", F.format_string("%.3f", "finite")),
        (F.col("range") != "PASS", "PHYSICAL_RANGE", F.col("range"), F.format_string("%.3f to %.3f", "low", "high")),
    ]
    one = lambda cond, check, severity, detail: F.when(cond, F.struct(F.lit(check).alias("check"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), detail.cast("string").alias("detail")))
    each = d.select(F.concat_ws("/", *g).alias("item"), F.explode(F.filter(F.array(*[one(*f) for f in found]), lambda i: i.isNotNull())).alias("i"))
    parts = [each.select("i.check", "i.severity", "item", "i.detail")]

    combos, wanted = [*by, "variable"], F.array(*[F.lit(m) for m in expected.methods])
    have = d.groupBy(*combos).agg(F.array_sort(F.collect_set("method")).alias("have"))
    have = have.withColumn("lack", F.array_join(F.array_except(wanted, "have"), ", ")).withColumn("more", F.array_join(F.array_except("have", wanted), ", "))
    parts.append(issue(have.where("lack <> ''"), "METHOD_MISSING", combos, F.col("lack")))
    parts.append(issue(have.where("more <> ''"), "METHOD_UNKNOWN", combos, F.col("more"), "WARNING"))

    if settings is not None:
        want = F.create_map(*[F.lit(v) for pair in expected.settings.items() for v in pair])
        s = settings.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("have"))
        s = s.select(*by, "have", F.explode(want).alias("name", "want")).withColumn("got", F.coalesce(F.try_element_at("have", F.col("name")), F.lit("nothing")))
        parts.append(issue(s.where("got <> want"), "SETTING", [*by, "name"], F.format_string("%s for %s", "got", "want")))

    for name, t in (tables or {}).items():
        keys = [c for c in t.columns if c not in (*combos, "value") and t.schema[c].dataType.typeName() in ("string", "integer", "long")]
        counts = d.select(*combos).distinct().join(t.groupBy(*combos).agg(F.count("*").alias("rows"), F.count_distinct(*keys).alias("kinds")) if keys else t.groupBy(*combos).agg(F.count("*").alias("rows"), F.lit(1).alias("kinds")), combos, "full_outer")
        counts = counts.withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("table", F.lit(name))
        parts.append(issue(counts.where(F.col("rows") != expected.table_rows[name]), "TABLE_ROWS", ["table", *combos], F.format_string("%d for %d", "rows", F.lit(expected.table_rows[name]))))
        parts.append(issue(counts.where("rows > 0 and kinds <> rows"), "TABLE_KEYS", ["table", *combos], F.lit("rows with equal keys")))
        parts.append(issue(t.select(*combos).distinct().join(d.select(*combos).distinct(), combos, "left_anti").withColumn("table", F.lit(name)), "TABLE_IDENTITY", ["table", *combos], F.lit("rows of no output")))
        for share, check, most in (("fallback_percent", "FALLBACK_SHARE", expected.most_fallback), ("tail_percent", "TAIL_SHARE", expected.most_tail)):
            if share in t.columns:
                parts.append(issue(t.groupBy(*combos).agg(F.max(share).alias("most")).where(F.col("most") > most).withColumn("table", F.lit(name)), check, ["table", *combos], F.format_string("%.3f", "most"), "WARNING"))
    return issues(parts)


def sampled_steps(df: DataFrame, by: Sequence[str], order: str, n: int = 8) -> DataFrame:
    """The rows of ``n`` time steps of each group, spread evenly from the first to the last."""
    steps = df.select(*by, order).distinct()
    w = Window.partitionBy(*by)
    steps = steps.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count("*").over(w))
    wanted = F.array(*[F.floor(F.lit(k) * (F.col("__n") - 1) / (n - 1)) for k in range(n)])
    return df.join(steps.where(F.array_contains(wanted, F.col("__i"))).select(*by, order), [*by, order])


def audit_energy(stored_rows: DataFrame, by: Sequence[str], order: str, formulas: dict[str, Column], rho: DataFrame, least: int, total: int) -> DataFrame:
    """Issues of energy output: values on eight sampled time steps that their formulas don't give, and rank
    correlations (``by``, cell, rho, p, n) out of their ranges."""
    g = [*by, "cell"]
    sample = sampled_steps(stored_rows, by, order)
    wrong = reconstruction_issues(sample, [*by, "cell", order], formulas)
    r, p, n = F.col("rho"), F.col("p"), F.col("n")
    return issues([
        issue(wrong, "FORMULA", [*by, "cell", order, "variable"], F.format_string("%.4f for %.4f", "stored", "expected")),
        issue(rho.where(~r.between(-1, 1)), "RHO_RANGE", g, F.round(r, 3)),
        issue(rho.where(~p.between(0, 1)), "P_RANGE", g, F.round(p, 3)),
        issue(rho.where((n < 0) | (n > total)), "VALID_COUNT", g, n),
        issue(rho.where(r.isNotNull() & (n < least)), "TOO_FEW_VALUES", g, n),
    ])
