"""Whole steps of physical quantities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quantum and the bits of each quantity's whole steps.
LATTICES = {
    "height_m": (1.0, 32),
    "temperature_dc": (0.1, 16),
    "humidity_dp": (0.1, 16),
    "precipitation_mm": (1.0, 32),
    "potential": (0.001, 16),
    "centi": (0.01, 16),
    "weight": (0.001, 16),
}


def quantized(value: Column, lattice: str) -> Column:
    """Whole steps, half to even; a value that is not finite or doesn't fit is an error, never clamped. Null stays null."""
    quantum, bits = LATTICES[lattice]
    steps = F.rint(value / F.lit(quantum))
    limit = float(1 << (bits - 1))
    wrong = F.isnan(steps) | (steps < -limit) | (steps >= limit)
    return F.when(wrong, F.raise_error(F.concat(F.lit(f"{lattice}: no whole steps for "), value.cast("string")))).otherwise(steps.cast("int"))


def valued(steps: Column, lattice: str) -> Column:
    return steps * F.lit(LATTICES[lattice][0])
