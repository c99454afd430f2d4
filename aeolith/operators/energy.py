"""Solar and wind power from monthly weather: narrow expressions, one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeolith.config import DEFAULT, EngineConfig


def celsius(tas: Column) -> Column:
    return tas - 273.15


def cell_temperature(tas_c: Column, rsds: Column, wind: Column, config: EngineConfig = DEFAULT) -> Column:
    a, b, c, d = config.cell_temperature
    return a + b * tas_c + c * rsds + d * wind


def performance_ratio(tcell: Column, config: EngineConfig = DEFAULT) -> Column:
    return 1 + config.performance_slope * (tcell - config.reference_temperature)


def roughness_exponent(wind: Column, config: EngineConfig = DEFAULT) -> Column:
    """NULL without wind."""
    a, b = config.roughness
    return F.when(wind > 0, a - b * F.ln(F.when(wind > 0, wind)))


def hub_wind(wind: Column, height: Column | float, config: EngineConfig = DEFAULT) -> Column:
    """By the power law; 0 where there is no wind, or none is known."""
    h = height if isinstance(height, Column) else F.lit(float(height))
    return F.when(wind > 0, wind * F.pow(h / config.anemometer_height, roughness_exponent(wind, config))).otherwise(0.0)


#: Winds below this are errors, not noise around zero.
LEAST_WIND = -1e-6


def wind_issues(df: DataFrame, by: Sequence[str], wind: str = "wind") -> DataFrame:
    """(by, issue, n): groups with negative wind, and groups without any finite wind; extrapolation is
    not to be done for them."""
    g = df.groupBy(*by).agg(F.count_if(F.col(wind) < LEAST_WIND).alias("__negative"), F.count(wind).alias("__finite"), F.count("*").alias("__rows"))
    issue = F.when(F.col("__finite") == 0, F.struct(F.lit("NO_FINITE_WIND").alias("issue"), F.col("__rows").alias("n"))).when(F.col("__negative") > 0, F.struct(F.lit("NEGATIVE_WIND").alias("issue"), F.col("__negative").alias("n")))
    return g.withColumn("__i", issue).where("__i is not null").select(*by, "__i.issue", "__i.n")


def wind_power_density(hub: Column, config: EngineConfig = DEFAULT) -> Column:
    return 0.5 * config.air_density * hub * hub * hub


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def daily_flux(joules: Column) -> Column:
    """J per day and area as W."""
    return joules / 86400


def energy_chain(cube: DataFrame, height: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """``cube`` (tas, rsds, wind) with tas_c, tcell, performance_ratio, pvpot, roughness_exponent, wind_hub and wpd."""
    d = cube.withColumn("tas_c", celsius(F.col("tas")))
    d = d.withColumn("tcell", cell_temperature(F.col("tas_c"), F.col("rsds"), F.col("wind"), config))
    d = d.withColumn("performance_ratio", performance_ratio(F.col("tcell"), config))
    d = d.withColumn("pvpot", F.col("performance_ratio") * F.col("rsds"))
    d = d.withColumn("roughness_exponent", roughness_exponent(F.col("wind"), config))
    d = d.withColumn("wind_hub", hub_wind(F.col("wind"), config.hub_height if height is None else height, config))
    return d.withColumn("wpd", wind_power_density(F.col("wind_hub"), config))


def by_method(raw: DataFrame, qm: str = "qm", qdm: str = "qdm") -> DataFrame:
    """Long rows (variable, qm, qdm) as two methods: ``paper_qm`` takes QM for each variable,
    ``optimized`` QDM for all but radiation."""
    d = raw.withColumn("method", F.explode(F.array(F.lit("paper_qm"), F.lit("optimized"))))
    return d.withColumn("corrected", F.when((F.col("method") == "paper_qm") | (F.col("variable") == "rsds"), F.col(qm)).otherwise(F.col(qdm)))
