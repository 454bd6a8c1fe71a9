"""Worlds as DataFrames: cells by number, and small tables of entities by position."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.params import STAGES, Parameters, params_version
from tessera.session import cut, ship
from tessera.sources.world_file import World

CELLS = "cell_id long, x int, y int, height_m int, is_water boolean"
TERRITORIES = "pos long, id long, is_water boolean, anchor_x long, anchor_y long, cell_count long, natural_potential int, region long"
REGIONS = "pos long, id long"
WATER_BODIES = "pos long, id long, kind int, anchor_x long, anchor_y long"
RIVERS = "pos long, id long, mouth_x long, mouth_y long, path array<long>"
SECTIONS = ("temperature", "humidity", "precipitation", "biome")


class StageError(ValueError):
    """A stage whose input is missing or doesn't fit."""


@dataclass(frozen=True)
class GridWorld:
    """cells has CELLS, and from the stages that ran: territory and water_body (positions), and SECTIONS in whole steps."""

    seed: int
    width: int
    height: int
    cells: DataFrame
    territories: DataFrame
    regions: DataFrame
    water_bodies: DataFrame
    rivers: DataFrame
    terrain: Parameters | None = None
    climate: Parameters | None = None
    hydrology: Parameters | None = None

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def with_cells(self, cells: DataFrame, **others) -> GridWorld:
        return replace(self, cells=cut(cells), **others)

    def need(self, *columns: str) -> None:
        missing = [c for c in columns if c not in self.cells.columns]
        if missing or self.width <= 0 or self.height <= 0:
            raise StageError(f"this stage needs {', '.join(missing) or 'a grid that is not empty'}")


def skeleton(spark: SparkSession, width: int, height: int, seed: int) -> GridWorld:
    """A flat world at sea level that no stage has touched."""
    if width <= 0 or height <= 0:
        raise StageError("a grid has at least one cell")
    ids = spark.range(width * height).withColumnRenamed("id", "cell_id")
    cells = ids.selectExpr("cell_id", f"CAST(cell_id % {width} AS INT) AS x", f"CAST(cell_id div {width} AS INT) AS y", "0 AS height_m", "false AS is_water")
    empty = lambda schema: spark.createDataFrame([], schema)
    return GridWorld(seed, width, height, cells, empty(TERRITORIES), empty(REGIONS), empty(WATER_BODIES), empty(RIVERS))


def from_world(spark: SparkSession, w: World) -> GridWorld:
    """A decoded file's world."""
    n, at = len(w.cells), np.arange(len(w.cells))
    h, water, t, b = zip(*w.cells, strict=True) if n else ((), (), (), ())
    i32 = pa.int32()
    table = {"cell_id": pa.array(at, pa.int64()), "x": pa.array(at % max(1, w.width), i32), "y": pa.array(at // max(1, w.width), i32), "height_m": pa.array(h, i32), "is_water": pa.array(water, pa.bool_()), "territory": pa.array(t, i32), "water_body": pa.array(b, i32)}
    for name, values in (("temperature", w.temperature), ("humidity", w.humidity), ("precipitation", w.precipitation), ("biome", w.biomes)):
        if values is not None:
            table[name] = pa.array(values, i32)
    rows = lambda items, schema: spark.createDataFrame([(k, *i) for k, i in enumerate(items)], schema)
    known = {}
    if w.climate is not None:
        known["climate"] = _from_steps("climate", w.climate)
    if w.hydrology is not None:
        known["hydrology"] = _from_steps("hydrology", (w.hydrology,))
    if w.terrain is not None:
        erosion, features, least, *rest = w.terrain
        known["terrain"] = _from_steps("terrain", (features, *rest, *(erosion or ())), min_feature_cells=least, erosion_enabled=erosion is not None)
    return GridWorld(
        w.seed,
        w.width,
        w.height,
        spark.createDataFrame(pa.table(table)),
        rows([(i, s, x, y, n, p, r) for i, s, x, y, n, p, r in w.territories], TERRITORIES),
        rows([(i,) for i in w.regions], REGIONS),
        rows(w.water_bodies, WATER_BODIES),
        rows(w.rivers, RIVERS),
        **known,
    )


def _from_steps(stage: str, steps: tuple, **extra) -> Parameters:
    names = STAGES[stage]
    values = {n: d for n, (d, *_) in names.items()} | {n: s * names[n][3] for n, s in zip(names, steps, strict=False)}
    return Parameters(stage, values | extra)


def to_world(g: GridWorld) -> World:
    """The world as whole lists on the driver, cells in order: for small ones (tessera.stages.export writes any)."""
    frame = g.cells.orderBy("cell_id").toPandas()

    def column(name: str) -> list[int | None]:
        if name not in frame:
            return [None] * len(frame)
        return [None if pd.isna(v) else int(v) for v in frame[name]]

    sections = {n: [int(v) for v in frame[n]] if n in frame else None for n in SECTIONS}
    sections["biomes"] = sections.pop("biome")
    cells = list(zip(column("height_m"), [bool(v) for v in frame["is_water"]], column("territory"), column("water_body"), strict=True))
    return replace(without_cells(g), cells=cells, **sections)


def without_cells(g: GridWorld) -> World:
    """The world's parameters and tables of entities in the form of a file."""
    entities = {n: [tuple(r)[1:] for r in getattr(g, n).orderBy("pos").collect()] for n in ("territories", "regions", "water_bodies", "rivers")}
    terrain = None
    if g.terrain is not None:
        s = g.terrain.steps()
        erosion = (s["droplets_per_hundred_cells"], s["power"], s["talus_m"]) if g.terrain.values["erosion_enabled"] else None
        others = ("land_ratio", "island_density", "land_hypsometry", "warp_strength", "warp_features", "ridge_strength", "ridge_features")
        terrain = (erosion, s["features_across"], g.terrain.values["min_feature_cells"], *(s[n] for n in others))
    return World(
        g.seed,
        g.width,
        g.height,
        [],
        entities["territories"],
        [i for (i,) in entities["regions"]],
        entities["water_bodies"],
        [(i, x, y, list(p)) for i, x, y, p in entities["rivers"]],
        params_version=params_version(g.terrain is not None, g.hydrology is not None, g.climate is not None),
        climate=tuple(g.climate.steps().values()) if g.climate else None,
        terrain=terrain,
        hydrology=next(iter(g.hydrology.steps().values())) if g.hydrology else None,
    )


def setting(p: Parameters, name: str) -> float:
    """A number as exports have it: whole steps times the quantum."""
    return p.steps()[name] * STAGES[p.stage][name][3]


def field(spark: SparkSession, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """A column of doubles from whole arrays of the cells' x and y."""
    ship(spark)

    @F.pandas_udf("double")
    def values(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(), y.to_numpy()).astype(np.float64))

    return values("x", "y")
