"""Cells of world files by ranges of bytes, against whole files decoded at once."""

from dataclasses import replace

import pytest

from tessera.sources.world_file import World, from_bytes, stored_hash, to_bytes
from tessera.sources.world_source import WorldSource


def world(width, height, sections=True, rivers=3):
    n = width * height
    w = World(5, width, height, [(k % 999 - 400, k % 3 == 0, None if k % 3 == 0 else k % 2, 0 if k % 3 == 0 else None) for k in range(n)])
    counts = [sum(c[2] == t for c in w.cells) for t in (0, 1)]
    w.territories = [(11, False, 0, 0, counts[0], 7, 31), (12, False, 1, 0, counts[1], 8, None)]
    w.regions, w.water_bodies = [31], [(21, 0, 0, 0)]
    w.rivers = [(41 + k, 0, 0, list(range(k + 1))) for k in range(rivers)]
    if sections:
        w.temperature, w.humidity, w.precipitation, w.biomes = [k % 500 - 200 for k in range(n)], [k % 1000 for k in range(n)], [k * 3 for k in range(n)], [1 + k % 16 for k in range(n)]
    return w


def plain(w):
    sections = [v or [None] * len(w.cells) for v in (w.temperature, w.humidity, w.precipitation, w.biomes)]
    return [(k, k % w.width, k // w.width, *c, *s) for k, (c, *s) in enumerate(zip(w.cells, *sections, strict=True))]


@pytest.mark.parametrize(("sections", "rivers"), [(True, 3), (False, 0)])
def test_ranges_of_a_file(spark, tmp_path, sections, rivers):
    spark.dataSource.register(WorldSource)
    w = world(50, 41, sections, rivers)
    (tmp_path / "w.gwb").write_bytes(to_bytes(w))
    assert from_bytes(to_bytes(w)).cells == w.cells
    df = spark.read.format("world").option("cellsPerTask", 300).load(str(tmp_path / "w.gwb"))
    assert df.rdd.getNumPartitions() == 7
    assert sorted(tuple(r)[1:] for r in df.collect()) == plain(w)
    assert df.where("is_water").count() == sum(c[1] for c in w.cells)


def test_folders_and_damage(spark, tmp_path):
    spark.dataSource.register(WorldSource)
    for k in (3, 4):
        (tmp_path / f"{k}.gwb").write_bytes(to_bytes(world(k, k)))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    df = spark.read.format("world").load(str(tmp_path))
    assert sorted(r["count"] for r in df.groupBy("world").count().collect()) == [9, 16]
    data = to_bytes(world(6, 6))
    for bad in (data[:-60], b"XXXX" + data[4:], b""):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match="UnexpectedEnd|InvalidMagic"):
            spark.read.format("world").load(str(tmp_path / "bad")).count()


def test_writing_in_packs(spark, tmp_path):
    from tessera.stages.export import write_world
    from tessera.stages.world import from_world

    for k, w in enumerate((world(50, 41), world(7, 9, False, 0))):
        g = from_world(spark, w)
        at = tmp_path / f"{k}.gwb"
        check = write_world(g, str(at))
        assert at.read_bytes() == to_bytes(w) and stored_hash(at.read_bytes()) == check
    with pytest.raises(Exception, match="CellCountMismatch"):
        write_world(replace(g, cells=g.cells.where("cell_id <> 5")), str(tmp_path / "x.gwb"))
    assert not (tmp_path / "x.gwb").exists()
