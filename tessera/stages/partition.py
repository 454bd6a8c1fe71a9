"""The territory stage: land and water split into territories that grow from seeds; and the regions they form."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions.lattice import quantized
from tessera.operators import grid, tiles
from tessera.operators.graph import connected_components
from tessera.operators.order import apportioned, even_positions, ranked, running
from tessera.operators.stencil import clamped
from tessera.session import cut, drop_cut
from tessera.stages.ids import identified
from tessera.stages.world import REGIONS, TERRITORIES, GridWorld, StageError

LLOYD = 2

#: Rows around a band in which its cells first look for means.
REACH = 64


@dataclass(frozen=True)
class WaterSplit:
    """Water territories by their count, or by about how many cells one has."""

    count: int | None = None
    cells: int | None = None


def territories(world: GridWorld, land_count: int, water: int | WaterSplit) -> GridWorld:
    """territory of every cell, and the territories: land ones in the order of their seeds, then water ones by anchor.

    A split into no territories leaves its surface without any.
    """
    split = WaterSplit(count=water) if isinstance(water, int) else water
    parts = []
    if land_count > 0:
        parts.append(land_territories(world, land_count))
    water_of = water_territories(world, split)
    if water_of is not None:
        parts.append(water_of)
    cells = world.cells.drop("territory")
    if not parts:
        empty = world.spark.createDataFrame([], TERRITORIES)
        return world.with_cells(cells.withColumn("territory", F.lit(None).cast("int")), territories=empty)
    tables, owners, before = [], [], 0
    for k, own in enumerate(parts):  # own: cell_id, pos
        wet = own is water_of
        tables.append(_anchors(own, world.width).withColumn("pos", F.col("pos") + before).withColumn("is_water", F.lit(wet)))
        owners.append(own.withColumn("pos", F.col("pos") + before))
        if k == 0 and len(parts) > 1:
            before = land_count
    table = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    named = identified(cut(table.withColumn("wet", F.col("is_water").cast("int"))), "territory", ("wet",))
    named = named.withColumn("natural_potential", F.lit(0)).withColumn("region", F.lit(None).cast("long")).select(*(c.split()[0] for c in TERRITORIES.split(", ")))
    owner = owners[0] if len(owners) == 1 else owners[0].unionByName(owners[1])
    cells = cells.join(owner.select("cell_id", F.col("pos").cast("int").alias("territory")), "cell_id", "left")
    return world.with_cells(cells, territories=cut(named))


def _anchors(own: DataFrame, width: int) -> DataFrame:
    x, y = F.col("cell_id") % width, F.expr(f"cell_id div {width}")
    return own.groupBy("pos").agg(F.expr(f"sum(cell_id % {width}) div count(*)").alias("anchor_x"), F.expr(f"sum(cell_id div {width}) div count(*)").alias("anchor_y"), F.count("*").alias("cell_count"))


def attractiveness():
    """Weight of a land cell in thousandths, from its temperature, humidity and height."""
    warm = clamped((F.col("temperature") * F.lit(0.1) + F.lit(25.0)) / F.lit(52.0))
    wet = clamped(F.col("humidity") * F.lit(0.1) / F.lit(100.0))
    low = clamped(F.lit(1.0) - F.abs(F.col("height_m").cast("double")) / F.lit(6000.0))
    return quantized(warm * wet * low, "weight")


def land_territories(world: GridWorld, count: int) -> DataFrame:
    """(cell_id, pos): land by seeds at even steps of its cells by weight; land that no seed reaches goes to the nearest running centroid."""
    world.need("temperature", "humidity")
    land = cut(world.cells.where("NOT is_water").select("cell_id", attractiveness().alias("weight")))
    n = land.count()
    if count > n:
        raise StageError(f"{count} land territories asked for, {n} land cells")
    order = ranked(land, F.desc("weight"), F.col("cell_id"))
    seeds = order.where(even_positions(F.lit(n), F.lit(count), F.col("rank"))).select("cell_id", "rank")
    seeds = cut(ranked(seeds, F.col("rank"), name="seed").select("cell_id", "seed"))
    own = cut(grid.grow(land, seeds, world.width).select("cell_id", F.col("seed").alias("pos")))
    rest = land.select("cell_id").join(own, "cell_id", "left_anti")
    if rest.isEmpty():
        return own
    return cut(own.unionByName(fill(own, rest, world.width)))


def fill(own: DataFrame, rest: DataFrame, width: int) -> DataFrame:
    """(cell_id, pos) for cells that no seed reached, in their order: each goes to the nearest mean, which then takes it in.

    Every choice moves a mean that the next ones see. A task makes the choices of a band of rows over the means that lie within
    some rows of it, from what the bands before left them with; all bands run at once, in rounds, until what the bands before
    leave doesn't change any choice: then each band has chosen as in the sequence, by induction from the first. A band with a
    cell that a mean further off could win looks twice as far in the next round.
    """
    high = tiles.band(width)
    band = F.expr(f"cell_id div {high * width}")
    rest = cut(rest.select("cell_id", band.alias("band")))
    sums = cut(own.groupBy("pos").agg(F.sum(F.expr(f"cell_id % {width}")).alias("sx"), F.sum(F.expr(f"cell_id div {width}")).alias("sy"), F.count("*").alias("n")))
    sums = sums.select("pos", F.lit(-1).cast("long").alias("band"), "sx", "sy", "n")

    def choose(key, cells: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        reach = wide.get(int(key[0]), REACH)
        means = means.sort_values("pos")
        sx, sy, n = (means[c].to_numpy().astype(np.int64) for c in ("sx", "sy", "n"))
        pos, ids = means["pos"].to_numpy(), np.sort(cells["cell_id"].to_numpy())
        owner, far = np.full(len(ids), -1, np.int64), not len(pos) and len(ids) > 0
        cx, cy = sx // n, sy // n
        for k, (y, x) in enumerate(zip(*np.divmod(ids, width), strict=True) if len(pos) else ()):
            away = (x - cx) ** 2 + (y - cy) ** 2
            at = int(away.argmin())
            far = far or away[at] > reach * reach
            owner[k] = pos[at]
            sx[at], sy[at], n[at] = sx[at] + x, sy[at] + y, n[at] + 1
            cx[at], cy[at] = sx[at] // n[at], sy[at] // n[at]
        return pd.DataFrame({"cell_id": ids, "pos": owner, "band": int(key[0]), "far": far})

    wide: dict[int, int] = {}  # bands that look further than REACH, and how far
    before = W.Window.partitionBy("pos").orderBy("band")
    made = None
    while True:
        steps = sums
        if made is not None:
            moved = made.where("pos >= 0").groupBy("pos", "band").agg(F.sum(F.expr(f"cell_id % {width}")).alias("sx"), F.sum(F.expr(f"cell_id div {width}")).alias("sy"), F.count("*").alias("n"))
            steps = sums.unionByName(moved)
        # What a mean is from one band that moves it to the next; band is the last one that has moved it.
        states = steps.select("pos", "band", *(F.sum(c).over(before).alias(c) for c in ("sx", "sy", "n")), F.lead("band").over(before).alias("until"))
        states = states.withColumns({"low": F.greatest(F.col("band") + 1, F.lit(0)), "high": F.coalesce("until", F.lit(1 << 40)), "cy": F.expr("sy div n")})
        seen = states.withColumn("key", F.explode(F.expr(f"sequence(greatest(cy - {REACH}, 0) div {high}, (cy + {REACH}) div {high})"))).where("key BETWEEN low AND high")
        if wide:
            asks = sums.sparkSession.createDataFrame(sorted(wide.items()), "key long, reach long")
            more = states.join(F.broadcast(asks), F.expr(f"key BETWEEN low AND high AND cy >= key * {high} - reach AND cy < (key + 1) * {high} + reach"))
            seen = seen.join(F.broadcast(asks), "key", "left_anti").unionByName(more.drop("reach"))
        old, made = made, cut(rest.groupBy("band").cogroup(seen.select("key", "pos", "sx", "sy", "n").groupBy("key")).applyInPandas(choose, "cell_id long, pos long, band long, far boolean"))
        far = [r.band for r in made.where("far").select("band").distinct().collect()]  # a row a band
        if far and sums.isEmpty():
            raise StageError("no territory has a cell")
        wide.update({b: 2 * wide.get(b, REACH) for b in far})
        same = old is not None and not far and made.join(old, ["cell_id", "pos"], "left_anti").isEmpty()
        if old is not None:
            drop_cut(old)
        if same:
            return made.select("cell_id", "pos")


def water_territories(world: GridWorld, split: WaterSplit) -> DataFrame | None:
    """(cell_id, pos): each connected water by its share of the territories, seeds at even steps of its cells.

    A split by count takes cells in their order; one by size takes them along a curve that keeps
    neighbours together, and moves the seeds twice to the middles of what they grew.
    """
    if split.cells is not None and split.cells < 1:
        raise StageError("a water territory has at least one cell")
    if split.cells is None and not split.count:
        return None
    width = world.width
    water = world.cells.where("is_water").select("cell_id")
    member = cut(grid.components(water, width).selectExpr("cell_id", "component", f"cell_id % {width} AS x", f"cell_id div {width} AS y"))
    areas = member.groupBy("component").agg(F.count("*").alias("area")).withColumnRenamed("component", "pos")
    bodies, n = areas.agg(F.count("*"), F.coalesce(F.sum("area"), F.lit(0))).first()
    count = split.count if split.cells is None else min(max((n + split.cells // 2) // split.cells, bodies), n)
    if count == 0:
        return None
    if not bodies <= count <= n:
        raise StageError(f"{count} water territories asked for, {bodies} to {n} can be")
    shares = running(apportioned(areas, count), F.col("seats"), F.col("pos"), name="first").withColumnRenamed("pos", "_component")
    morton = " | ".join(f"shiftleft(shiftright(CAST({v} AS BIGINT), {b}) & 1, {2 * b + k})" for b in range(31) for k, v in enumerate("xy"))
    listed = member.withColumn("z", F.expr(morton) if split.cells is not None else F.lit(0))
    order = ranked(listed, F.col("component"), F.col("z"), F.col("cell_id"), within="component").join(shares, F.col("component") == F.col("_component"))
    picked = order.where(even_positions(F.col("area"), F.col("seats"), F.col("rank")))
    step = F.when(F.col("area") == F.col("seats"), F.lit(1)).otherwise(F.floor((F.col("area") - 1) / F.col("seats")))
    seeds = cut(picked.select("cell_id", (F.col("first") + F.floor(F.col("rank") / step)).cast("long").alias("seed")))
    for _ in range(LLOYD if split.cells is not None else 0):
        seeds = middles(grid.grow(water, seeds, width), seeds, width)
    own = cut(grid.grow(water, seeds, width).select("cell_id", "seed"))
    anchors = _anchors(own.withColumnRenamed("seed", "pos"), width).withColumnRenamed("pos", "seed")
    place = ranked(anchors, F.col("anchor_y"), F.col("anchor_x"), F.col("seed"), name="pos").select("seed", "pos")
    return cut(own.join(place, "seed").select("cell_id", "pos"))


def middles(own: DataFrame, seeds: DataFrame, width: int) -> DataFrame:
    """(cell_id, seed): the member next to each territory's mean, x taken as the shortest way from its seed; ties to the lower cell."""
    at = seeds.select("seed", (F.col("cell_id") % width).alias("fx"))
    own = own.select("cell_id", "seed").join(at, "seed").selectExpr("cell_id", "seed", f"pmod(cell_id % {width} - fx + {width // 2}, {width}) - {width // 2} AS rx", f"cell_id div {width} AS y")
    own = cut(own)
    mean = own.groupBy("seed").agg(F.expr("sum(rx) div count(*)").alias("mx"), F.expr("sum(y) div count(*)").alias("my"))
    near = F.expr("min_by(cell_id, struct((rx - mx) * (rx - mx) + (y - my) * (y - my), cell_id))")
    return cut(own.join(mean, "seed").groupBy("seed").agg(near.alias("cell_id")).select("cell_id", "seed"))


def touching(world: GridWorld) -> DataFrame:
    """(a, b): pairs of territories of one surface with cells that touch by an edge."""
    return grid.touching(world.cells.where("territory IS NOT NULL").selectExpr("cell_id", "is_water AS surface", "territory AS owner"), world.width)


def regions(world: GridWorld) -> GridWorld:
    """Territories that touch, land or water, form regions; a region's identifier comes from its least anchor."""
    world.need("territory")
    found = connected_components(touching(world)).selectExpr("node AS pos", "component")
    member = cut(world.territories.join(found, "pos", "left").withColumn("component", F.coalesce("component", "pos")))
    least = member.groupBy("component").agg(F.min(F.struct("anchor_y", "anchor_x")).alias("m")).select("component", F.col("m.anchor_x").alias("anchor_x"), F.col("m.anchor_y").alias("anchor_y"))
    named = cut(identified(ranked(least, F.col("anchor_y"), F.col("anchor_x"), F.col("component"), name="pos"), "region"))
    table = member.drop("region").join(named.select("component", F.col("id").alias("region")), "component").select(*(c.split()[0] for c in TERRITORIES.split(", ")))
    return replace(world, territories=cut(table), regions=named.select(*(c.split()[0] for c in REGIONS.split(", "))))


def land_components(world: GridWorld) -> DataFrame:
    """(component, territories): how many land territories each connected land has."""
    land = world.territories.where("NOT is_water").select("pos")
    found = connected_components(touching(world)).selectExpr("node AS pos", "component")
    return land.join(found, "pos", "left").groupBy(F.coalesce("component", "pos").alias("component")).agg(F.count("*").alias("territories"))
