"""Stencils over a grid of cells (cell_id, x, y and values): blurs, slumping, marches along rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.operators import tiles
from tessera.operators.tiles import Laid, across, tiled
from tessera.session import cut

#: Offsets (dy, dx) of slumping, in the order that decides ties: E, S, W, N.
SLUMP = ((0, 1), (1, 0), (0, -1), (-1, 0))


def box_blur(cells: DataFrame, width: int, radius: int, value: str, wrap: bool, of: Callable[[str], Column] = F.avg) -> DataFrame:
    """cells with value averaged over 2 radius + 1 cells of its row, then over as many rows; rows end at the poles.

    In x the window wraps (a row not wider than it is averaged whole) or ends at the edges. Sums go from
    the west and from the north. With of=F.sum whole numbers are summed instead. Windows are over the parts
    of rows and columns that lie in a tile, with the halo that they need.
    """
    rest = [c for c in cells.columns if c != value]
    if wrap and 2 * radius + 1 >= width:
        flat = cells.withColumn(value, of(value).over(W.Window.partitionBy("y").orderBy("x").rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)))
    else:
        breadth = max(tiles.BREADTH, radius)
        part = lambda x: F.expr(f"least(greatest({x}, 0) div {breadth}, {max(1, width // breadth) - 1})")
        frame = W.Window.partitionBy("y", "_part").orderBy("_x").rowsBetween(-radius, radius)
        copies = [F.col("x").cast("int")]
        if wrap:
            copies += [F.when(F.col("x") < radius, F.col("x").cast("int") + width), F.when(F.col("x") >= width - radius, F.col("x").cast("int") - width)]
        padded = cells.withColumn("_x", F.explode(F.array_compact(F.array(*copies))))
        padded = padded.withColumn("_part", F.explode(F.array_distinct(F.array(*(part(f"_x + {k}") for k in (-radius, 0, radius))))))
        flat = padded.withColumn(value, of(value).over(frame)).where((F.col("_x") == F.col("x")) & (F.col("_part") == part("x"))).drop("_x", "_part")
    band = max(tiles.BAND, radius)
    frame = W.Window.partitionBy("x", "_band").orderBy("y").rowsBetween(-radius, radius)
    bands = flat.withColumn("_band", F.explode(F.array_distinct(F.array(*(F.expr(f"greatest(y + {k}, 0) div {band}") for k in (-radius, 0, radius))))))
    return bands.withColumn(value, of(value).over(frame)).where(f"_band = y div {band}").select(*rest, value)


def steepest(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each cell of rows stands over its lowest neighbour (0 if over none), and which one that is (its place in SLUMP, the first of equal ones)."""
    above, way = np.zeros(h.shape, h.dtype), np.full(h.shape, -1, np.int8)
    for k, (dy, dx) in enumerate(SLUMP):
        near = np.roll(h, -dx, 1) if dx else None
        here = h if dx else h[max(0, -dy) : len(h) - max(0, dy)]
        diff = here - (near if dx else h[max(0, dy) : len(h) - max(0, -dy)])
        at = slice(None) if dx else slice(max(0, -dy), len(h) - max(0, dy))
        more = diff > above[at]
        above[at][more], way[at][more] = diff[more], k
    return above, way


def settled(h: np.ndarray, moved: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Rows after what each cell moves to the neighbour its way leads to; a cell's changes are added in the order of the cells they come from."""
    east, south, west, north = (np.where(way == k, moved, 0) for k in range(4))
    none = np.zeros((1, h.shape[1]), moved.dtype)
    from_north, from_south = np.concatenate([none, south[:-1]]), np.concatenate([north[1:], none])
    from_west, from_east = np.roll(east, 1, 1), np.roll(west, -1, 1)
    out = h + from_north
    mid = np.ones(h.shape[1], bool)
    mid[[0, -1]] = h.shape[1] == 1
    # Around the seam the neighbour in the west or the east comes later or earlier.
    orders = [(mid, (from_west, -moved, from_east)), (np.arange(h.shape[1]) == h.shape[1] - 1, (from_east, from_west, -moved)), (np.arange(h.shape[1]) == 0, (-moved, from_east, from_west))]
    for columns, parts in orders[: 3 if h.shape[1] > 1 else 1]:
        for part in parts:
            out[:, columns] = out[:, columns] + part[:, columns]
    return out + from_south


def slump(cells: DataFrame, width: int, value: str, passes: int, step: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """cells (cell_id, value) of whole rows after passes of step(rows, pass), which looks two cells far at most.

    A tile with two more cells a pass on every side goes through all passes inside a task. step may take
    the first and last column for neighbours: they are, around the seam, or else belong to the halo.
    """

    def apply(tile: pd.DataFrame) -> pd.DataFrame:
        own, laid = tile["own"].to_numpy(), Laid(tile["cell_id"].to_numpy(), width)
        h = laid.matrix(tile[value].to_numpy(), 0)
        for k in range(passes):
            h = step(h, k)
        return pd.DataFrame({"cell_id": tile["cell_id"], value: laid.back(h)})[own]

    kind = cells.schema[value].dataType.simpleString()
    return tiled(cells.select("cell_id", value), width, 2 * passes).groupBy("tile").applyInPandas(apply, f"cell_id long, {value} {kind}")


#: The latitudes between which wind blows east.
WIND_FROM, WIND_TO = 0.3, 0.7


def latitude(y, height: int):
    """0 in the middle, 1 at the poles, by the middles of rows."""
    return abs((y + 0.5) / height - 0.5) * 2.0


def eastward(lat):
    """Whether wind blows east: strictly between the two latitudes."""
    return (lat > WIND_FROM) & (lat < WIND_TO)


@dataclass(frozen=True)
class Air:
    """How moisture fills over the sea and falls over land, and how humidity follows from the rain; heights are divided by rise."""

    evaporation: float
    offset: float
    drizzle: float = 0.02
    slope: float = 8.0
    gain: float = 20.0
    rise: float = 4000.0


def with_wind(east: np.ndarray):
    """Turns rows (matrices) so that their wind blows from the first column on, and back."""
    return lambda m: np.where(east[:, None], m, m[:, ::-1])


def march(height_norm: np.ndarray, water: np.ndarray, east: np.ndarray, evaporation: float, offset: float, drizzle: float, slope: float, gain: float, moisture: np.ndarray | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Humidity and rain of rows (matrices), as moisture is carried along each row, east or west.

    The sea fills the moisture and is saturated; land takes rain by drizzle and by the rise of the ground,
    and its humidity is that rain's times gain, plus offset. moisture and before (the ground that the wind
    comes from) are what a row starts with: none, and the ground of its own first cell.
    """
    turn = with_wind(east)
    h, sea = turn(height_norm), turn(water)
    humidity, rain = np.zeros(h.shape), np.zeros(h.shape)
    moisture, before = np.zeros(len(h)) if moisture is None else moisture, h[:, 0] if before is None else before
    for x in range(h.shape[1]):
        rise = np.maximum(h[:, x] - before, 0.0)
        fall = np.minimum(moisture * (drizzle + slope * rise), moisture)
        wet = sea[:, x]
        rain[:, x] = np.where(wet, 0.0, fall)
        humidity[:, x] = np.where(wet, 1.0, np.maximum(fall * gain + offset, 0.0))
        moisture = np.where(wet, np.minimum(moisture + evaporation, 1.0), moisture - fall)
        before = h[:, x]
    return turn(humidity), turn(rain)


def passage(height_norm: np.ndarray, water: np.ndarray, east: np.ndarray, air: Air, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a stretch of rows does to the moisture m that comes in: it leaves as min(top, share m + more).

    The sea takes min(1, m + evaporation), land leaves a share of m; such maps, one after another, are one map of the kind.
    """
    turn = with_wind(east)
    h, sea = turn(height_norm), turn(water)
    share, more, top = np.ones(len(h)), np.zeros(len(h)), np.full(len(h), np.inf)
    for x in range(h.shape[1]):
        keep = 1.0 - np.minimum(air.drizzle + air.slope * np.maximum(h[:, x] - before, 0.0), 1.0)
        wet = sea[:, x]
        top = np.where(wet, np.minimum(top + air.evaporation, 1.0), np.where(keep > 0, top, 0.0) * keep)
        share, more = np.where(wet, share, share * keep), np.where(wet, more + air.evaporation, more * keep)
        before = h[:, x]
    return share, more, top


def moisture_along_rows(cells: DataFrame, width: int, height: int, air: Air) -> DataFrame:
    """(cell_id, humidity, rain) of whole rows of cells (cell_id, height_m, is_water), as moisture is carried along each, east or west by its latitude.

    A tile tells what it does to the moisture that comes in, three numbers a row; the tiles of a row are strung
    together by those, and then each is marched with what comes in. Rows that lie in one tile are marched at
    once; in wider ones moisture may differ from a march in one go by its last bits.
    """
    n, schema = across(width), "cell_id long, humidity double, rain double"
    rates = air.evaporation, air.offset, air.drizzle, air.slope, air.gain

    def laid_out(tile: pd.DataFrame):
        """Rows, whether their wind blows east, their ground with the ground beside them, their sea, and the places of own cells."""
        y, x = np.divmod(tile["cell_id"].to_numpy(), width)
        own, low = tile["own"].to_numpy(), y.min()
        first, last = x[own].min(), x[own].max()
        ground, sea = np.zeros((y.max() - low + 1, last - first + 3)), np.zeros((y.max() - low + 1, last - first + 3), bool)
        at = x - first + 1
        here = (at >= 0) & (at < ground.shape[1])  # what lies around the seam isn't where a row's wind comes from
        ground[(y - low)[here], at[here]] = tile["height_m"].to_numpy()[here] / air.rise
        sea[(y - low)[here], at[here]] = tile["is_water"].to_numpy()[here]
        if first == 0:
            ground[:, 0] = ground[:, 1]
        if last == width - 1:
            ground[:, -1] = ground[:, -2]
        rows = np.arange(low, y.max() + 1)
        east = eastward(latitude(rows, height))
        return rows, east, ground[:, 1:-1], sea[:, 1:-1], np.where(east, ground[:, 0], ground[:, -1]), (own, (y - low)[own], (at - 1)[own])

    def tell(tile: pd.DataFrame) -> pd.DataFrame:
        rows, east, ground, sea, before, _ = laid_out(tile)
        share, more, top = passage(ground, sea, east, air, before)
        number = int(tile["tile"].iloc[0])
        return pd.DataFrame({"y": rows, "tile": number, "place": np.where(east, number % n, n - 1 - number % n), "share": share, "more": more, "top": top})

    def string(told: pd.DataFrame) -> pd.DataFrame:
        told = told.sort_values(["y", "place"])
        share, more, top = (told[c].to_numpy().reshape(-1, n) for c in ("share", "more", "top"))
        moisture = np.zeros(share.shape)
        for k in range(1, n):
            moisture[:, k] = np.minimum(top[:, k - 1], share[:, k - 1] * moisture[:, k - 1] + more[:, k - 1])
        return pd.DataFrame({"tile": told["tile"], "y": told["y"], "moisture": moisture.ravel()})

    def went(tile: pd.DataFrame, come: pd.DataFrame | None = None) -> pd.DataFrame:
        _, east, ground, sea, before, (own, row, column) = laid_out(tile)
        moisture = None if come is None else come.sort_values("y")["moisture"].to_numpy()
        humidity, rain = march(ground, sea, east, *rates, moisture, before)
        return pd.DataFrame({"cell_id": tile["cell_id"].to_numpy()[own], "humidity": humidity[row, column], "rain": rain[row, column]})

    def at_once(tile: pd.DataFrame) -> pd.DataFrame:
        return went(tile)

    dealt = tiled(cells.select("cell_id", "height_m", "is_water"), width, 1, rows=False)
    if n == 1:
        return dealt.groupBy("tile").applyInPandas(at_once, schema)
    dealt = cut(dealt)
    told = dealt.groupBy("tile").applyInPandas(tell, "y long, tile long, place long, share double, more double, top double")
    come = told.groupBy(F.expr(f"tile div {n}").alias("band")).applyInPandas(string, "tile long, y long, moisture double")
    return dealt.groupBy("tile").cogroup(come.groupBy("tile")).applyInPandas(went, schema)


def count_over(cells: DataFrame, value: str, offsets: list[float], level: float) -> list[int]:
    """How many cells are over a level after each offset is added: one pass, one sum an offset."""
    over = [F.count_if(F.col(value) + F.lit(o) > F.lit(level)).alias(f"c{k}") for k, o in enumerate(offsets)]
    return list(cells.agg(*over).first())


def clamped(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
