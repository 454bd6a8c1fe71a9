"""Tiles of a grid: what one task takes together, with the cells beside it that it needs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a tile of a wide grid, and the columns that it has at least (at most one less than twice as many).
BAND, BREADTH = 64, 1024


def band(width: int) -> int:
    """Rows of a tile: more where the grid is narrow, so that a tile has half the cells of a wide one or more."""
    return max(BAND, BAND * BREADTH // 2 // width)


def across(width: int) -> int:
    """How many tiles lie side by side; the last one also takes what is left of a row."""
    return max(1, width // BREADTH)


def margin(width: int) -> int:
    """Rows and columns around a tile in which most of what grows into it starts."""
    return max(1, min(band(width), BREADTH) // 5)


def tile_sql(width: int, cell: str = "cell_id") -> str:
    """The number of a cell's tile."""
    n = across(width)
    row = f"{cell} div {width * band(width)}"
    return row if n == 1 else f"({row} * {n} + least({cell} % {width} div {BREADTH}, {n - 1}))"


def tile_of(width: int):
    """The same for arrays of cells, to be used inside tasks."""
    n, rows, breadth = across(width), band(width), BREADTH
    return lambda cells: cells // (width * rows) * n + np.minimum(cells % width // breadth, n - 1)


def edge_sql(width: int, cell: str = "cell_id") -> str:
    """Whether a cell may touch another tile (all that do, and few others)."""
    y = f"{cell} div {width} % {band(width)} IN (0, {band(width) - 1})"
    if across(width) == 1:
        return y
    x = f"{cell} % {width}"
    return f"({y} OR {x} % {BREADTH} IN (0, {BREADTH - 1}) OR {x} = {width - 1})"


def tiled(cells: DataFrame, width: int, halo: int, rows: bool = True) -> DataFrame:
    """cells (with cell_id) in their tile, and in those on any side that need them within halo cells (own is false there).

    x wraps. rows=False leaves out what lies over and under a tile.
    """
    high = band(width)
    if halo > high or across(width) > 1 and 2 * halo > BREADTH:
        raise ValueError(f"a halo of {halo} cells doesn't fit tiles of {high} rows and {BREADTH} columns")
    n, y, x = across(width), f"cell_id div {width}", f"cell_id % {width}"
    b, c = f"{y} div {high}", f"least({x} div {BREADTH}, {n - 1})"
    up = f"CASE WHEN {y} % {high} < {halo} AND {y} >= {high} THEN -1 END"
    down = f"CASE WHEN {y} % {high} >= {high - halo} THEN 1 END"
    west = f"CASE WHEN {x} - {c} * {BREADTH} < {halo} THEN -1 END"
    east = f"CASE WHEN {x} >= CASE WHEN {c} = {n - 1} THEN {width} ELSE ({c} + 1) * {BREADTH} END - {halo} THEN 1 END"
    every = cells.withColumn("_down", F.expr(f"explode(array_compact(array({up}, 0, {down})))" if rows else "0"))
    every = every.withColumn("_east", F.expr(f"explode(array_compact(array({west}, 0, {east})))" if n > 1 else "0"))
    tile = f"({b} + _down) * {n} + pmod({c} + _east, {n})"
    return every.withColumns({"tile": F.expr(tile), "own": F.expr("_down = 0 AND _east = 0")}).drop("_down", "_east")


class Laid:
    """A tile's cells as a matrix: a column for each x among them, and an empty one wherever the next x isn't beside it, around the seam too.

    So rolling a matrix by one column meets a neighbour or an empty column.
    """

    def __init__(self, cells: np.ndarray, width: int) -> None:
        self.y, self.x = np.divmod(cells, width)
        xs, at = np.unique(self.x, return_inverse=True)
        gap = np.diff(xs, append=xs[0] + width) != 1
        place = np.arange(len(xs)) + np.concatenate([[0], np.cumsum(gap)[:-1]])
        low = self.y.min()
        self.shape = int(self.y.max() - low + 1), int(len(xs) + gap.sum())
        self.at = (self.y - low) * self.shape[1] + place[at]

    def matrix(self, values: np.ndarray, empty) -> np.ndarray:
        out = np.full(self.shape[0] * self.shape[1], empty, values.dtype)
        out[self.at] = values
        return out.reshape(self.shape)

    def back(self, matrix: np.ndarray) -> np.ndarray:
        """A matrix's values in the order of the cells."""
        return matrix.ravel()[self.at]
