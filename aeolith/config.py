"""Periods, thresholds and physical constants.  Fixed values are listed once, here."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a run; the defaults are those of monthly climate cubes."""

    variables: tuple[str, ...] = ("tas", "rsds", "wind")
    # correction
    low: float = 0.02
    high: float = 0.98
    nodes: int = 99
    window: int = 30
    floors: dict[str, float] = field(default_factory=lambda: {"tas": 1.0, "rsds": 1.0, "wind": 0.1})
    non_negative: tuple[str, ...] = ("rsds", "wind")
    additive: tuple[str, ...] = ("tas",)
    # photovoltaic cell temperature: constant, air temperature, radiation, wind
    cell_temperature: tuple[float, float, float, float] = (4.3, 0.943, 0.028, -1.528)
    performance_slope: float = -0.005
    reference_temperature: float = 25.0
    # wind at hub height
    roughness: tuple[float, float] = (0.37, 0.0881)
    anemometer_height: float = 10.0
    hub_height: float = 100.0
    hub_heights: tuple[float, ...] = (80.0, 100.0, 120.0)
    air_density: float = 1.225
    # ensembles
    least_share: float = 0.8
    z_limit: float = 3.0
    complementarity_edges: tuple[float, ...] = (-0.9, -0.6, -0.3, 0.0, 0.3, 0.6, 0.9)

    @property
    def node_points(self) -> list[float]:
        step = (self.high - self.low) / (self.nodes - 1)
        return [self.low + k * step for k in range(self.nodes)]

    def method(self, variable: str) -> str:
        return "additive" if variable in self.additive else "ratio"


DEFAULT = EngineConfig()
#: Periods of the proxy cube: fit, target.
FIT, TARGET = (1995, 1997), (1998, 2000)
PERIODS = (("fit", *FIT), ("target", *TARGET))
