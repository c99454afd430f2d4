"""Guarded arithmetic, and the tail probabilities that SQL lacks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from aeolith.ship import ship


#: Means of a few short decimals often end in an exact half of the last place, which engines
#: round by the noise of their sums; results are rounded after this shift, which moves halves aside.
HALF_SHIFT = 3.1e-8


def rounded(x: Column) -> Column:
    """To six places, for comparisons across engines; no negative zero."""
    return F.round(x + HALF_SHIFT, 6) + F.lit(0.0)


def ratio(n: Column, d: Column, floor: float) -> Column:
    """n / d where abs(d) is over the floor, else NULL."""
    return F.when(F.abs(d) > floor, n / F.when(F.abs(d) > floor, d))


def percent_of(n: Column, d: Column) -> Column:
    return 100 * ratio(n, d, 1e-12)


def by_variable(variable: Column, values: dict) -> Column:
    """The value (a number or a column) of each variable; an error for one that has none."""
    out = F.raise_error(F.concat(F.lit("no setting for variable "), F.coalesce(variable, F.lit("NULL"))))
    for k, v in values.items():
        out = F.when(variable == k, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def change(variable: Column, future: Column, base: Column, floors: dict[str, float], additive: tuple[str, ...]) -> Column:
    """A difference for additive variables, else per cent of the base."""
    return by_variable(variable, {v: future - base if v in additive else (ratio(future, base, floor) - 1) * 100 for v, floor in floors.items()})


def clamp(x: Column) -> Column:
    """Not below zero; NULL stays NULL (greatest would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def same_direction(x: Column, y: Column) -> Column:
    """Whether signs agree; zero counts as positive."""
    return (x >= 0) == (y >= 0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + up * d, 1 + up / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def correlation_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom."""
    ship(SparkSession.active())

    @F.pandas_udf("double")
    def p(r: pd.Series, k: pd.Series) -> pd.Series:
        def one(x, m):
            if pd.isna(x) or pd.isna(m) or m < 3:
                return None
            return 0.0 if abs(x) >= 1 else student_two_sided(x * math.sqrt((m - 2) / (1 - x * x)), m - 2)

        return pd.Series([one(x, m) for x, m in zip(r, k)], dtype="float64")

    return p(rho, n)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value."""

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2))).astype("float64")

    return p(z)
