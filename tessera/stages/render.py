"""Pictures of a world: one raster of red, green and blue a cell for each layer, and the files of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.biomes import REGISTRY
from tessera.plans.scalar import (
    HUMIDITY_STOPS,
    LAND_COLOR,
    NO_TERRITORY_COLOR,
    POTENTIAL_STOPS,
    PRECIPITATION_STOPS,
    RIVER_COLOR,
    RIVERS_WATER_COLOR,
    TEMPERATURE_STOPS,
    WATER_COLORS,
    categorical,
    gradient,
)
from tessera.sources.png import write_png
from tessera.stages.world import GridWorld

LAYERS = ("height", "water", "temperature", "humidity", "precipitation", "biome", "territory", "rivers", "regions", "potential")
#: The greys of the lowest and the highest cell.
GREYS = (40, 235)


def _plain(*cases: tuple[str | None, tuple[int, int, int]]) -> str:
    """Colours by conditions, the first that holds; the last has none."""
    arms = lambda k: " ".join(f"WHEN {c} THEN {rgb[k]}" for c, rgb in cases if c)
    return ", ".join(f"CAST(CASE {arms(k)} ELSE {cases[-1][1][k]} END AS INT) AS {n}" for k, n in enumerate("rgb"))


def _or(colour: str, condition: str, other: tuple[int, int, int]) -> list[str]:
    """The columns of a colour, or of another one where the condition doesn't hold."""
    parts = [p.rsplit(" AS ", 1) for p in colour.replace(" AS r, ", " AS r\0").replace(" AS g, ", " AS g\0").split("\0")]
    return [f"CASE WHEN {condition} THEN {e} ELSE {other[k]} END AS {n}" for k, (e, n) in enumerate(parts)]


def layer(world: GridWorld, name: str) -> DataFrame | None:
    """(cell_id, r, g, b) of a layer, or None where the world hasn't got it yet."""
    cells, have = world.cells, set(world.cells.columns)
    if name not in LAYERS:
        raise ValueError(f"no layer {name}")
    if name == "height":
        low, high = cells.agg(F.min("height_m"), F.max("height_m")).first()
        if low == high:
            return cells.selectExpr("cell_id", *(f"{GREYS[0]} AS {n}" for n in "rgb"))
        return cells.selectExpr("cell_id", *_columns(gradient("(height_m * 1E0)", [(float(low), (GREYS[0],) * 3), (float(high), (GREYS[1],) * 3)])))
    if name in ("temperature", "humidity", "precipitation"):
        if name not in have:
            return None
        stops = {"temperature": TEMPERATURE_STOPS, "humidity": HUMIDITY_STOPS, "precipitation": PRECIPITATION_STOPS}[name]
        return cells.selectExpr("cell_id", *_columns(gradient(f"({name} * {'1E0' if name == 'precipitation' else '1E-1'})", stops)))
    if name == "biome":
        if "biome" not in have:
            return None
        known = world.spark.createDataFrame([(i, r, g, b) for i, _, _, r, g, b in REGISTRY], "biome int, kr int, kg int, kb int")
        other = cells.select("cell_id", "biome").join(F.broadcast(known), "biome", "left").selectExpr("cell_id", "kr", "kg", "kb", *_columns(categorical("biome")))
        return other.selectExpr("cell_id", *(f"coalesce(k{n}, {n}) AS {n}" for n in "rgb"))
    if name == "water":
        if "water_body" not in have:
            return cells.selectExpr("cell_id", *_columns(_plain(("is_water", WATER_COLORS["ocean"]), (None, LAND_COLOR))))
        kinds = world.water_bodies.selectExpr("CAST(pos AS INT) AS water_body", "kind")
        return cells.join(kinds, "water_body", "left").selectExpr("cell_id", *_columns(_plain(("NOT is_water", LAND_COLOR), ("kind = 1", WATER_COLORS["sea"]), ("kind = 2", WATER_COLORS["lake"]), (None, WATER_COLORS["ocean"]))))
    if name == "rivers":
        river = world.rivers.select(F.explode("path").alias("cell_id")).distinct().withColumn("river", F.lit(True))
        return cells.join(river, "cell_id", "left").selectExpr("cell_id", *_columns(_plain(("river", RIVER_COLOR), ("is_water", RIVERS_WATER_COLOR), (None, LAND_COLOR))))
    if "territory" not in have:
        return cells.selectExpr("cell_id", *_columns(_plain(("is_water", RIVERS_WATER_COLOR), (None, NO_TERRITORY_COLOR)) if name == "potential" else _plain((None, NO_TERRITORY_COLOR))))
    if name == "territory":
        return cells.selectExpr("cell_id", *_or(categorical("territory"), "territory IS NOT NULL", NO_TERRITORY_COLOR))
    owners = world.territories.selectExpr("CAST(pos AS INT) AS territory", "region", "natural_potential")
    if name == "regions":
        places = world.regions.selectExpr("id AS region", "pos AS place")
        owners = owners.join(places, "region", "left").select("territory", "place")
        return cells.select("cell_id", "territory").join(owners, "territory", "left").selectExpr("cell_id", *_or(categorical("place"), "place IS NOT NULL", NO_TERRITORY_COLOR))
    shown = cells.select("cell_id", "territory", "is_water").join(owners, "territory", "left")
    shown = shown.selectExpr("cell_id", "is_water", *_or(gradient("(natural_potential * 1E0)", POTENTIAL_STOPS), "natural_potential IS NOT NULL", NO_TERRITORY_COLOR))
    return shown.selectExpr("cell_id", *(f"CASE WHEN is_water THEN {RIVERS_WATER_COLOR[k]} ELSE {n} END AS {n}" for k, n in enumerate("rgb")))


def _columns(colour: str) -> list[str]:
    return [p for p in colour.replace(" AS r, ", " AS r\0").replace(" AS g, ", " AS g\0").split("\0")]


def render(world: GridWorld, out: str, zoom: int = 1) -> list[str]:
    """One picture {out}.{layer}.png for each layer that the world has; the names of the layers."""
    written = []
    for name in LAYERS:
        raster = layer(world, name)
        if raster is not None:
            write_png(raster, world.width, f"{out}.{name}.png", zoom)
            written.append(name)
    return written
