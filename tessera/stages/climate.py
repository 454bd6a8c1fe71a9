"""The climate stage: temperature by latitude, noise and height; humidity and rain by moisture carried along rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions.lattice import quantized
from tessera.functions.noise import Noise, on_cylinder
from tessera.functions.params import Parameters, parameters
from tessera.operators.stencil import Air, box_blur, clamped, moisture_along_rows
from tessera.session import ship
from tessera.stages.world import GridWorld, field, setting

#: Fixed values of the stage.
FREQUENCY = 0.005
EQUATOR_C, POLE_C, NOISE_SHARE, COLDEST_C, HOTTEST_C = 27.0, -25.0, 0.2, -90.0, 60.0
LAPSE, SEA_COOLING_C, SEA_DEPTH_M = 0.0065, 5.0, 1000.0
EVAPORATION, EVAPORATION_BY_OFFSET, LEAST_EVAPORATION = 0.15, 0.1, 0.05
DRIZZLE, SLOPE, GAIN, RISE_M, RAIN_MM, RADIUS = 0.02, 8.0, 20.0, 4000.0, 3000.0, 3


def plain_noise(seed: int, name: str, width: int):
    noise = Noise.named(seed, name, FREQUENCY)
    return lambda x, y: on_cylinder(noise, width, x, y.astype(np.float32) + np.float32(0.5))


def climate(world: GridWorld, params: Parameters | None = None) -> GridWorld:
    """temperature, humidity (tenths) and precipitation (mm a year) of every cell."""
    p = params or parameters("climate")
    world.need("height_m", "is_water")
    ship(world.spark)
    width, height = world.width, world.height
    offset, humid = setting(p, "temperature_offset_c"), setting(p, "humidity_offset")
    amplification, exponent = setting(p, "polar_amplification"), setting(p, "latitude_exponent")
    noise = field(world.spark, plain_noise(world.seed, "climate.temperature", width))
    lat = F.abs((F.col("y") + F.lit(0.5)) / F.lit(float(height)) - F.lit(0.5)) * F.lit(2.0)
    h = F.col("height_m").cast("double")
    value = F.lit(EQUATOR_C) + F.lit(POLE_C - EQUATOR_C) * F.pow(lat, F.lit(exponent)) + F.lit(NOISE_SHARE * (EQUATOR_C - POLE_C)) * noise
    value = value + F.lit(offset) * (F.lit(1.0) + lat * F.lit(amplification))
    value = value - F.when(F.col("is_water"), F.lit(SEA_COOLING_C) * F.least(F.greatest(-h, F.lit(0.0)) / F.lit(SEA_DEPTH_M), F.lit(1.0))).otherwise(F.lit(LAPSE) * F.greatest(h, F.lit(0.0)))
    value = F.least(F.greatest(value, F.lit(COLDEST_C)), F.lit(HOTTEST_C))
    base = world.cells.drop("temperature", "humidity", "precipitation")
    warm = base.withColumn("temperature", quantized(value, "temperature_dc"))
    evaporation = max(EVAPORATION + EVAPORATION_BY_OFFSET * humid, LEAST_EVAPORATION)

    wet = moisture_along_rows(world.cells, width, height, Air(evaporation, humid, DRIZZLE, SLOPE, GAIN, RISE_M))
    wet = wet.selectExpr("cell_id", f"CAST(cell_id % {width} AS INT) AS x", f"CAST(cell_id div {width} AS INT) AS y", "rain", "humidity")
    smooth = box_blur(wet, width, RADIUS, "humidity", wrap=False)
    moist = smooth.select(
        "cell_id",
        quantized(clamped(F.col("humidity")) * F.lit(100.0), "humidity_dp").alias("humidity"),
        quantized(F.greatest(F.col("rain") * F.lit(RAIN_MM), F.lit(0.0)), "precipitation_mm").alias("precipitation"),
    )
    return world.with_cells(warm.join(moist, "cell_id"), climate=p)
