"""Facts of territories, and the natural potential that they are enriched with."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.biomes import REGISTRY
from tessera.functions.dialect import SPARK
from tessera.functions.lattice import quantized
from tessera.operators import grid
from tessera.plans.scalar import SCORE
from tessera.session import cut
from tessera.stages.world import TERRITORIES, GridWorld

MOUNTAINS = [i for i, _, category, *_ in REGISTRY if category == "Mountain"]


def facts(world: GridWorld) -> DataFrame:
    """(territory, natural_potential, is_coastal, is_mountainous, river_mouths) of every territory.

    Water territories have no potential and no flags. A river's mouth belongs to the first water body
    beside it (W, E, N, S); mouths at lakes are left out.
    """
    world.need("temperature", "humidity", "biome", "territory", "water_body")
    cells = world.cells
    land = cells.where("NOT is_water AND territory IS NOT NULL")
    coast = grid.shores(cells.selectExpr("cell_id", "is_water AS wet", "coalesce(territory, -1) AS owner"), world.width).select(F.col("owner").alias("pos"), F.lit(True).alias("coast"))
    score = SCORE.replace("temperature_dc", "temperature").replace("humidity_dp", "humidity")
    own = land.groupBy(F.col("territory").cast("long").alias("pos"))
    flags = own.agg(quantized(F.expr(SPARK.exact_mean(score)), "potential").alias("potential"), F.bool_or(F.col("biome").isin(MOUNTAINS)).alias("high"))
    mouths = world.rivers.select(F.col("pos").alias("river"), (F.col("mouth_y") * world.width + F.col("mouth_x")).alias("cell_id"), "mouth_x", "mouth_y")
    bodies = cells.where("water_body IS NOT NULL").select(F.col("cell_id").alias("nid"), F.col("water_body").cast("long").alias("body"))
    found = grid.neighbours(mouths, world.width, grid.FOUR, "river", "mouth_x", "mouth_y").join(bodies, "nid")
    first = found.groupBy("river", "cell_id", "mouth_x", "mouth_y").agg(F.min_by("body", "ord").alias("pos"))
    open_ = first.join(world.water_bodies.where("kind IN (0, 1)").select("pos"), "pos", "left_semi").join(cells.select("cell_id", F.col("territory").cast("long").alias("t")), "cell_id")
    listed = open_.groupBy(F.col("t").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("river", F.col("mouth_x").alias("x"), F.col("mouth_y").alias("y")))).alias("mouths"))
    every = world.territories.select("pos", "is_water").join(flags, "pos", "left").join(coast, "pos", "left").join(listed, "pos", "left")
    none = F.lit(False)
    return every.select(
        F.col("pos").alias("territory"),
        F.when(F.col("is_water"), 0).otherwise(F.coalesce("potential", F.lit(0))).alias("natural_potential"),
        F.when(F.col("is_water"), none).otherwise(F.coalesce("coast", none)).alias("is_coastal"),
        F.coalesce("high", none).alias("is_mountainous"),
        F.coalesce(F.transform("mouths", lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"))), F.array().cast("array<struct<x: bigint, y: bigint>>")).alias("river_mouths"),
    )


def enrich(world: GridWorld) -> GridWorld:
    """The world with the natural potential of its land territories; a second time changes nothing."""
    known = facts(world).select(F.col("territory").alias("pos"), F.col("natural_potential").alias("p"))
    table = world.territories.join(known, "pos").withColumn("natural_potential", F.when(F.col("is_water"), F.col("natural_potential")).otherwise(F.col("p")))
    return replace(world, territories=cut(table.select(*(c.split()[0] for c in TERRITORIES.split(", ")))))
