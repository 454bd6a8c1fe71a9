"""Parameters of the stages: domains, TOML files, and the whole steps that exports hold."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass

#: Fixed values: (default, least, most, quantum) of each number, by stage.
TERRAIN = {
    "features_across": (1.5, 0.5, 8.0, 0.01),
    "land_ratio": (0.3, 0.05, 0.95, 0.01),
    "island_density": (0.5, 0.0, 3.0, 0.01),
    "land_hypsometry": (1.0, 1.0, 4.0, 0.01),
    "warp_strength": (0.0, 0.0, 0.3, 0.01),
    "warp_features": (6.0, 1.0, 12.0, 0.01),
    "ridge_strength": (0.0, 0.0, 1.0, 0.01),
    "ridge_features": (5.0, 1.0, 12.0, 0.01),
    "droplets_per_hundred_cells": (100.0, 1.0, 1000.0, 0.01),
    "power": (0.02, 0.005, 0.2, 0.01),
    "talus_m": (120.0, 10.0, 500.0, 1.0),
}
CLIMATE = {
    "temperature_offset_c": (0.0, -10.0, 10.0, 0.1),
    "polar_amplification": (1.0, 0.0, 3.0, 0.01),
    "latitude_exponent": (1.0, 0.5, 2.0, 0.01),
    "humidity_offset": (0.3, -0.4, 0.4, 0.01),
}
HYDROLOGY = {"river_land_share_percent": (0.12, 0.01, 10.0, 0.01)}
STAGES = {"terrain": TERRAIN, "climate": CLIMATE, "hydrology": HYDROLOGY}
#: Settings that are not numbers with a quantum: default, and the domain of whole ones.
EXTRA = {"terrain": {"erosion_enabled": (True, None), "min_feature_cells": (8, (1, 256))}}


class ParameterError(ValueError):
    """A setting that is unknown, not finite, or out of its domain."""


def quantize(value: float, quantum: float, bits: int = 16) -> int:
    """Whole steps, half to even; values that are not finite or don't fit are errors, never clamped."""
    if not math.isfinite(value):
        raise ParameterError(f"{value} is not finite")
    steps = round(value / quantum)
    if not -(1 << (bits - 1)) <= steps < 1 << (bits - 1):
        raise ParameterError(f"{value} is out of range")
    return steps


@dataclass(frozen=True)
class Parameters:
    stage: str
    values: dict[str, float | bool | int]

    def steps(self) -> dict[str, int]:
        """The numbers in whole steps. Erosion's numbers are left out where it is off."""
        out = {}
        for name, (*_, quantum) in STAGES[self.stage].items():
            if self.stage == "terrain" and name in ("droplets_per_hundred_cells", "power", "talus_m") and not self.values["erosion_enabled"]:
                continue
            out[name] = quantize(self.values[name], quantum, 32 if name == "talus_m" else 16)
        return out


def parameters(stage: str, settings: dict | None = None) -> Parameters:
    """Checked settings of a stage over its defaults."""
    numbers, extra = STAGES[stage], EXTRA.get(stage, {})
    values = {n: d for n, (d, *_) in numbers.items()} | {n: d for n, (d, _) in extra.items()}
    for name, value in (settings or {}).items():
        if name not in values:
            raise ParameterError(f"unknown setting {name}")
        if name in extra:
            kind, domain = type(extra[name][0]), extra[name][1]
            if type(value) is not kind or domain and not domain[0] <= value <= domain[1]:
                raise ParameterError(f"{name}: {value!r}")
        else:
            if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
                raise ParameterError(f"{name}: {value!r}")
            _, least, most, _ = numbers[name]
            if not least <= value <= most:
                raise ParameterError(f"{name}: {value} is not within {least} and {most}")
        values[name] = value
    return Parameters(stage, values)


def from_toml(stage: str, text: str) -> Parameters:
    return parameters(stage, tomllib.loads(text))


def params_version(terrain: bool, hydrology: bool, climate: bool) -> int:
    """The version of a parameter block by the stages that have put theirs in."""
    return 6 if terrain else 3 if hydrology else 1 if climate else 0
