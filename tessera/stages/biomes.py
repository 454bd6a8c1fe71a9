"""The biome stage: the ordered rules of biomes, whose bounds waver with a noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.biomes import case_sql
from tessera.stages.climate import plain_noise
from tessera.stages.world import GridWorld, field

#: How far the bounds waver, in degrees and percent.
WAVER_C, WAVER_PERCENT = 2.0, 5.0


def biomes(world: GridWorld) -> GridWorld:
    """biome of every cell, from its height, temperature and humidity."""
    world.need("temperature", "humidity")
    noise = field(world.spark, plain_noise(world.seed, "biome.boundary", world.width))
    waver = lambda reach: F.rint(F.col("_n") * F.lit(reach) / F.lit(0.1)).cast("int")
    cells = world.cells.drop("biome").withColumn("_n", noise)
    # A bound that moves up by an offset is a value that moves down by it.
    cells = cells.withColumn("_t", F.col("temperature") - waver(WAVER_C)).withColumn("_h", F.col("humidity") - waver(WAVER_PERCENT))
    return world.with_cells(cells.withColumn("biome", F.expr(case_sql("is_water", "height_m", "temperature", "_t", "_h")).cast("int")).drop("_n", "_t", "_h"))
