"""Rules over worlds of DataFrames, each against a world that breaks it."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.sources.world_file import World, WorldError, validate as validate_file
from tessera.stages.validate import validate, violations
from tessera.stages.world import StageError, from_world


def small():
    w = World(1, 4, 3, [(5, k % 4 == 3, 1 if k % 4 == 3 else 0, 0 if k % 4 == 3 else None) for k in range(12)])
    w.territories = [(11, False, 1, 1, 9, 0, 31), (12, True, 3, 1, 3, 0, None)]
    w.regions, w.water_bodies, w.rivers = [31, 32], [(21, 0, 3, 1)], [(41, 2, 1, [5, 6])]
    w.temperature, w.humidity, w.precipitation, w.biomes = ([k] * 12 for k in (1, 2, 3, 4))
    return w


def broken(name):
    w = small()
    t, c = w.territories, w.cells
    change = {
        "ReservedId": lambda: t.__setitem__(1, (0, *t[1][1:])),
        "DuplicateId": lambda: w.water_bodies.append((21, 2, 0, 0)),
        "AnchorOutOfBounds": lambda: w.rivers.__setitem__(0, (41, 4, 1, [5])),
        "UnknownRegion": lambda: t.__setitem__(0, (*t[0][:6], 99)),
        "InvalidRiverPath": lambda: w.rivers.append((42, 1, 1, [])),
        "TerritoryIndexOutOfRange": lambda: c.__setitem__(4, (5, False, 2, None)),
        "WaterBodyIndexOutOfRange": lambda: c.__setitem__(3, (5, True, 1, 1)),
        "LandCellInWaterBody": lambda: c.__setitem__(0, (5, False, 0, 0)),
        "MemberCountMismatch": lambda: t.__setitem__(0, (*t[0][:4], 8, 0, 31)),
    }
    change[name]()
    return w


RULES = "ReservedId DuplicateId AnchorOutOfBounds UnknownRegion InvalidRiverPath TerritoryIndexOutOfRange WaterBodyIndexOutOfRange LandCellInWaterBody MemberCountMismatch".split()


@pytest.mark.parametrize("name", RULES)
def test_each_rule(spark, name):
    w = broken(name)
    with pytest.raises(WorldError, match=name):
        validate_file(w)
    world = from_world(spark, w)
    with pytest.raises(StageError, match=f"^{name}"):
        validate(world)
    assert [(r.rule, r.n) for r in violations(world).collect() if r.rule == name] == [(name, 1)]


def test_whole_worlds_and_missing_cells(spark):
    world = from_world(spark, small())
    validate(world)
    with pytest.raises(StageError, match="^CellCountMismatch"):
        validate(replace(world, cells=world.cells.where("cell_id <> 7")))
    with pytest.raises(StageError, match="^SectionLengthMismatch: humidity"):
        validate(replace(world, cells=world.cells.withColumn("humidity", F.when(F.col("cell_id") != 7, F.col("humidity")))))
    late = replace(world, rivers=spark.createDataFrame([(0, 41, 2, 1, [5, 99]), (1, 41, 9, 1, [5])], "pos long, id long, mouth_x long, mouth_y long, path array<long>"))
    with pytest.raises(StageError, match="^InvalidRiverPath: river at 0"):
        validate(late)
    assert {r.rule for r in violations(late).collect()} == {"InvalidRiverPath", "DuplicateId", "AnchorOutOfBounds"}
