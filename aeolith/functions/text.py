"""Unit names, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings in the order of replacement, allowed units, and kinds of evidence.
UNIT_WORDS = (
    ("watts", "w"), ("watt", "w"), ("metres", "m"), ("metre", "m"), ("meters", "m"), ("meter", "m"), ("seconds", "s"), ("second", "s"),
    ("degrees_kelvin", "kelvin"), ("degree_kelvin", "kelvin"),
)
ALLOWED_UNITS = {"tas": ("k", "kelvin"), "rsds": ("wm-2", "wm**-2", "wm^-2", "w/m2"), "wind": ("ms-1", "ms**-1", "ms^-1", "m/s")}
EVIDENCE = {
    "pvpot_2100": "reported_numeric_value", "pvpot_slope": "reported_numeric_value", "sfcwind_2100": "approximate_anchor", "sfcwind_decline": "approximate_anchor",
    "table4_z": "reported_numeric_value", "table4_dir": "reported_numeric_value", "wpd_diff": "approximate_anchor", "table5_": "reported_numeric_value", "table3_": "reported_numeric_value",
}
OTHER_EVIDENCE = "reported_numeric_value"


def normal_unit(unit: Column) -> Column:
    """Lower case, words as symbols, no white space; empty for none."""
    out = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    for a, b in UNIT_WORDS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r"\s+", "")


def unit_allowed(variable: Column, unit: Column) -> Column:
    out = F.lit(False)
    for v, units in ALLOWED_UNITS.items():
        out = F.when(variable == v, normal_unit(unit).isin(*units)).otherwise(out)
    return out


FILE_YEARS = r"_(\d{4})(\d{2})?-(\d{4})(\d{2})?\.nc$"
VARIANT = r"r(\d+)i(\d+)p(\d+)f(\d+)"
VERSION = r"^v\d{8}$"


def file_years(name: Column) -> Column:
    """(first, last) year of a file name, null if it has none."""
    part = lambda i: F.when(name.rlike(FILE_YEARS), F.regexp_extract(name, FILE_YEARS, i).cast("int"))
    return F.struct(part(1).alias("first_year"), part(3).alias("last_year"))


def variant_key(variant: Column) -> Column:
    """Numbers of a variant name, which order it (r10 after r2)."""
    return F.struct(*[F.regexp_extract(variant, VARIANT, i).cast("int").alias(c) for i, c in enumerate("ripf", 1)])


def bounds_label(low: Column, high: Column) -> Column:
    """Q02-Q98"""
    return F.format_string("Q%02d-Q%02d", F.round(low * 100).cast("int"), F.round(high * 100).cast("int"))


def first_prefix(text: Column, prefixes: dict[str, str], default: str) -> Column:
    """The value of the first prefix that fits."""
    out = None
    for p, v in prefixes.items():
        out = F.when(text.startswith(p), v) if out is None else out.when(text.startswith(p), v)
    return F.lit(default) if out is None else out.otherwise(default)


URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#;]*)"


def normal_url(url: Column) -> Column:
    """Scheme, host and path that ends in a slash; without parameters, query and fragment."""
    path = F.regexp_extract(url, URL, 3)
    path = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
    return F.when(url.rlike(URL), F.concat(F.lower(F.regexp_extract(url, URL, 1)), F.lit("://"), F.regexp_extract(url, URL, 2), path))


def url_name(url: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(F.regexp_replace(F.regexp_extract(url, URL, 3), "/+$", ""), "([^/]*)$", 1)
