"""The hydrology stage: water bodies, flow, rivers from source to mouth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.biomes import REGISTRY
from tessera.functions.params import Parameters, parameters
from tessera.operators import grid
from tessera.operators.order import ranked
from tessera.session import cut
from tessera.stages.ids import identified
from tessera.stages.world import RIVERS, WATER_BODIES, GridWorld, setting

#: Cells from which enclosed water is a sea, and the least flow of a river.
SEA_CELLS, LEAST_FLOW = 200, 8.0
ICE, DESERT = (next(i for i, name, *_ in REGISTRY if name == n) for n in ("Ice", "Desert"))


def hydrology(world: GridWorld, params: Parameters | None = None) -> GridWorld:
    """water_body of every water cell, the water bodies, and the rivers."""
    p = params or parameters("hydrology")
    world.need("height_m", "is_water", "biome")
    bodies, body_of = water_bodies(world)
    cells = world.cells.drop("water_body").join(body_of, "cell_id", "left")
    return world.with_cells(cells, water_bodies=bodies, rivers=rivers(world, p), hydrology=p)


def rivers(world: GridWorld, params: Parameters | None = None) -> DataFrame:
    """The rivers alone: they come from heights, water and biomes, not from the water bodies."""
    p = params or parameters("hydrology")
    world.need("height_m", "is_water", "biome")
    return named_rivers(river_paths(world, setting(p, "river_land_share_percent") / 100.0), world.width)


def kind_of(cells: str, touches_pole: str) -> str:
    """0 ocean (at either pole), 1 sea, 2 lake."""
    return f"CASE WHEN {touches_pole} THEN 0 WHEN {cells} >= {SEA_CELLS} THEN 1 ELSE 2 END"


def water_bodies(world: GridWorld) -> tuple[DataFrame, DataFrame]:
    """The bodies by (anchor's y, x), and (cell_id, water_body)."""
    x, y = f"cell_id % {world.width}", f"cell_id div {world.width}"
    member = cut(grid.components(world.cells.where("is_water").select("cell_id"), world.width).selectExpr("cell_id", "component", f"{x} AS x", f"{y} AS y"))
    pole = f"bool_or(y = 0 OR y = {world.height - 1})"
    body = member.groupBy("component").agg(F.expr("sum(x) div count(*)").alias("anchor_x"), F.expr("sum(y) div count(*)").alias("anchor_y"), F.expr(f"CAST({kind_of('count(*)', pole)} AS INT)").alias("kind"))
    body = cut(identified(ranked(body, F.col("anchor_y"), F.col("anchor_x"), F.col("component"), name="pos"), "water_body"))
    table = body.select(*(c.split()[0] for c in WATER_BODIES.split(", ")))
    return table, cut(member.join(body.select("component", F.col("pos").cast("int").alias("water_body")), "component").select("cell_id", "water_body"))


def river_paths(world: GridWorld, share: float) -> DataFrame:
    """(start, ord, cell_id): land cells from each source down to its mouth; ways that end in a pit are left out."""
    base = world.cells.select("cell_id", "height_m", "is_water", (F.col("biome") == ICE).alias("ice"), (F.col("biome") == DESERT).alias("desert"))
    drained = cut(grid.drained(base, world.width, "ice", "desert"))
    targets = drained.where("target >= 0 AND NOT ice").select("cell_id", "target")
    strong = cut(grid.accumulated(drained, world.width).where(F.col("flow") >= LEAST_FLOW))  # no river has less
    land = base.where("NOT is_water").select("cell_id")
    member = cut(grid.components(land, world.width))
    least = member.groupBy("component").agg(F.greatest(F.lit(share) * F.count("*"), F.lit(LEAST_FLOW)).alias("least"))
    river = cut(member.join(strong, "cell_id").join(least, "component").where("flow >= least").select("cell_id"))
    fed = targets.join(river, "cell_id").select(F.col("target").alias("cell_id"))
    way = grid.walks(river.join(fed, "cell_id", "left_anti"), targets, world.width).join(base.select("cell_id", "is_water"), "cell_id")
    end = way.where("is_water").groupBy("start").agg(F.min("ord").alias("end"))
    return cut(way.join(end, "start").where("ord < end").select("start", "ord", "cell_id"))


def named_rivers(paths: DataFrame, width: int) -> DataFrame:
    """Rivers by (mouth's y, x), those of one mouth by their sources. A path is one way down, so it is bounded by the grid's relief."""
    whole = paths.groupBy("start").agg(F.max_by("cell_id", "ord").alias("mouth"), F.array_sort(F.collect_list(F.struct("ord", "cell_id"))).alias("way"))
    rows = whole.select("start", (F.col("mouth") % width).alias("anchor_x"), F.expr(f"mouth div {width}").alias("anchor_y"), F.col("way.cell_id").alias("path"))
    named = identified(ranked(rows, F.col("anchor_y"), F.col("anchor_x"), F.col("start"), name="pos"), "river")
    return cut(named.withColumnsRenamed({"anchor_x": "mouth_x", "anchor_y": "mouth_y"}).select(*(c.split()[0] for c in RIVERS.split(", "))))
