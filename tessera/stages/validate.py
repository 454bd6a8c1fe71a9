"""The rules that a world keeps, checked over its DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.stages.world import SECTIONS, GridWorld, StageError

#: The groups of rules in their order; within a group rows come in their order, and the rules of a row in theirs.
GROUPS = ("grid", "territory", "region", "water body", "river", "cell", "member", "section")

VIOLATIONS = "group int, ord int, rule string, section string, n long, first long"


def _found(rows: DataFrame, group: str, at: Column, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Of each rule the rows that break it, and the first of them, in one pass over rows."""
    columns = []
    for k, (_, _, bad) in enumerate(rules):
        broken = F.coalesce(bad, F.lit(False))
        columns += [F.count_if(broken).alias(f"n{k}"), F.min(F.when(broken, at)).cast("long").alias(f"at{k}")]
    each = [F.struct(F.lit(GROUPS.index(group)).alias("group"), F.lit(k).alias("ord"), F.lit(rule).alias("rule"), F.lit(section).alias("section"), F.col(f"n{k}").alias("n"), F.col(f"at{k}").alias("first")) for k, (rule, section, _) in enumerate(rules)]
    return rows.agg(*columns).select(F.inline(F.array(*each))).where("n > 0")


def _entities(world: GridWorld, table: DataFrame, group: str, x: str | None, y: str | None, more: list[tuple[str, str, Column]]) -> DataFrame:
    """Rules of a table of entities by pos: an id of its own that is not 0, an anchor in the grid, and more."""
    again = F.row_number().over(W.Window.partitionBy("id").orderBy("pos")) > 1
    rules = [("ReservedId", group, F.col("id") == 0), ("DuplicateId", group, F.col("_again") & (F.col("id") != 0))]
    if x:
        inside = (F.col(x) >= 0) & (F.col(x) < world.width) & (F.col(y) >= 0) & (F.col(y) < world.height)
        rules.append(("AnchorOutOfBounds", group, ~inside))
    return _found(table.withColumn("_again", again), group, F.col("pos"), rules + more)


def violations(world: GridWorld) -> DataFrame:
    """(group, ord, rule, section, n, first) of each broken rule: how many rows break it, and the first (a position or a cell).

    A pass over each table, with an anti join for references and a count of members a territory; nothing
    but the numbers of territories and water bodies comes to the driver.
    """
    cells, n = world.cells, world.width * world.height
    sizes = {t: getattr(world, t).count() for t in ("territories", "water_bodies")}
    regions = world.regions.select(F.col("id").alias("region")).distinct().withColumn("_known", F.lit(True))
    territories = world.territories.join(regions, "region", "left")
    unknown = [("UnknownRegion", "territory", F.col("region").isNotNull() & F.col("_known").isNull())]
    empty = F.coalesce(F.size("path"), F.lit(0)) <= 0
    paths = [("InvalidRiverPath", "river", empty | F.exists("path", lambda c: c.isNull() | (c < 0) | (c >= n)))]
    out = [
        cells.agg(F.count("*").alias("_n"), F.count_if((F.col("cell_id") < 0) | (F.col("cell_id") >= n)).alias("_out"))
        .where(F.lit(n) != F.col("_n") - F.col("_out"))
        .select(F.lit(0).alias("group"), F.lit(0).alias("ord"), F.lit("CellCountMismatch").alias("rule"), F.lit("grid").alias("section"), F.col("_n").alias("n"), F.lit(0).cast("long").alias("first")),
        _entities(world, territories, "territory", "anchor_x", "anchor_y", unknown),
        _entities(world, world.regions, "region", None, None, []),
        _entities(world, world.water_bodies, "water body", "anchor_x", "anchor_y", []),
        _entities(world, world.rivers, "river", "mouth_x", "mouth_y", paths),
    ]
    outside = lambda c, size: (F.col(c) < 0) | (F.col(c) >= size)
    rules = []
    if "territory" in cells.columns:
        rules.append(("TerritoryIndexOutOfRange", "cell", outside("territory", sizes["territories"])))
    if "water_body" in cells.columns:
        rules += [("WaterBodyIndexOutOfRange", "cell", outside("water_body", sizes["water_bodies"])), ("LandCellInWaterBody", "cell", F.col("water_body").isNotNull() & ~F.col("is_water"))]
    if rules:
        out.append(_found(cells, "cell", F.col("cell_id"), rules))
    have = cells.where("territory IS NOT NULL").groupBy(F.col("territory").cast("long").alias("pos")).agg(F.count("*").alias("_have")) if "territory" in cells.columns else None
    counted = world.territories.join(have, "pos", "left") if have is not None else world.territories.withColumn("_have", F.lit(0))
    out.append(_found(counted, "member", F.col("pos"), [("MemberCountMismatch", "territory", F.col("cell_count") != F.coalesce("_have", F.lit(0)))]))
    sections = [("SectionLengthMismatch", s, F.col(s).isNull()) for s in SECTIONS if s in cells.columns]
    if sections:
        out.append(_found(cells, "section", F.lit(0), sections))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def validate(world: GridWorld) -> None:
    """Raise the first broken rule, as a reader that goes through the tables in order finds it."""
    first = violations(world).orderBy("group", "first", "ord").limit(1).collect()
    if first:
        raise StageError(f"{first[0].rule}: {first[0].section} at {first[0].first} ({first[0].n} in all)")
