"""A whole world from a seed."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.params import Parameters
from tessera.stages.biomes import biomes
from tessera.stages.climate import climate
from tessera.stages.facts import enrich
from tessera.stages.hydrology import hydrology
from tessera.stages.partition import WaterSplit, regions, territories
from tessera.stages.relief import relief
from tessera.stages.world import GridWorld, skeleton

#: The size and the territories of the small default world.
WIDTH, HEIGHT, LAND, WATER = 48, 32, 12, 8


def build_world(
    spark: SparkSession,
    seed: int,
    width: int = WIDTH,
    height: int = HEIGHT,
    land: int = LAND,
    water: int | WaterSplit = WATER,
    terrain_params: Parameters | None = None,
    climate_params: Parameters | None = None,
    hydrology_params: Parameters | None = None,
    with_climate: bool = True,
) -> GridWorld:
    """Relief, then (with climate) climate, biomes, hydrology, territories, regions and their potential."""
    world = relief(skeleton(spark, width, height, seed), terrain_params)
    if not with_climate:
        return world
    world = hydrology(biomes(climate(world, climate_params)), hydrology_params)
    return enrich(regions(territories(world, land, water)))
