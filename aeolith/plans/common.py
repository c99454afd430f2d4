"""What the queries share."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeolith.functions.numeric import HALF_SHIFT, rounded
from aeolith.sources.cubes import SQL_A, SQL_B, long_form, monthly, phases, reused, table  # noqa: F401

A = "WITH " + SQL_A.strip()
B = "WITH " + SQL_B.strip()


def r(expr: str) -> str:
    """A value as it is compared across engines."""
    return f"(round(({expr}) + {HALF_SHIFT}, 6) + 0.0)"


def out(df, keys, values, counts=()):
    """Keys, rounded values, counts as long."""
    return df.select(*keys, *[rounded(F.col(v)).alias(v) for v in values], *[F.col(c).cast("long").alias(c) for c in counts])


#: (period, first year, last year) as SQL and as a function of a year column.
SQL_PERIOD = "CASE WHEN year BETWEEN 1995 AND 1997 THEN 'fit' WHEN year BETWEEN 1998 AND 2000 THEN 'target' END"


def period(year):
    return F.when(year.between(1995, 1997), "fit").when(year.between(1998, 2000), "target")
