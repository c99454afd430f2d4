"""Month keys: sources with different calendars are aligned by them, never by timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(year: Column, month: Column) -> Column:
    """Consecutive months differ by one."""
    return year * 12 + month - 1


def month_label(ym: Column) -> Column:
    """yyyy-mm"""
    return F.format_string("%04d-%02d", F.floor(ym / 12).cast("int"), (ym % 12 + 1).cast("int"))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def season_year(year: Column, month: Column) -> Column:
    """December belongs to the winter of the next year."""
    return year + F.when(month == 12, 1).otherwise(0)


def wrap_longitude(lon: Column) -> Column:
    """-180 (included) to 180; the remainder must not keep the sign of its dividend."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def wrap_axis(df, by, lon: str):
    """``df`` with ``lon`` wrapped in the groups that go beyond 180 degrees; others keep it, 180 itself included."""
    from pyspark.sql import Window

    beyond = F.max(lon).over(Window.partitionBy(*by)) > 180
    return df.withColumn(lon, F.when(beyond, wrap_longitude(F.col(lon))).otherwise(F.col(lon)))
