"""World files: golden hashes, round trips, and a broken file for each rule."""

import copy
import struct

import pytest

from tessera.functions.rng import fnv1a64
from tessera.sources import world_file as f

#: The hashes of the synthetic worlds of these seeds.
GOLDEN = {0: 0x7F78487DEC4C1360, 42: 0xC8B0BC78C1179F1B, 0xDEADBEEF: 0x9019728548FADFE0, 0x5EED5EED5EED5EED: 0x74316597008FA09E, (1 << 64) - 1: 0x20230F4244DF993D}


def test_fnv_vectors():
    assert [fnv1a64(x) for x in (b"", b"a", b"foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


@pytest.mark.parametrize("seed", GOLDEN)
def test_golden_worlds(spark, seed):
    data = f.to_bytes(f.synthetic_world(spark, seed))
    assert f.stored_hash(data) == GOLDEN[seed]
    assert f.from_bytes(data) == f.synthetic_world(spark, seed)


@pytest.fixture(scope="module")
def world(spark):
    return f.synthetic_world(spark, 42)


def test_sections_and_params_round_trip(world):
    w = copy.deepcopy(world)
    n = w.width * w.height
    w.temperature, w.humidity, w.precipitation, w.biomes = [-5] * n, [3] * n, [100] * n, [9] * n
    w.params_version, w.climate, w.terrain, w.hydrology = 6, (1, 2, 3, 4), ((100, 2, 120), 150, 8, 30, 50, 100, 0, 600, 0, 500), 12
    assert f.from_bytes(f.to_bytes(w)) == w


def change(**kw):
    def apply(w):
        for k, v in kw.items():
            setattr(w, k, v(w) if callable(v) else v)

    return apply


BROKEN = [
    ("DuplicateId", change(territories=lambda w: [w.territories[0], (w.territories[0][0], *w.territories[1][1:])])),
    ("ReservedId", change(regions=[0], territories=lambda w: [(*t[:6], None) for t in w.territories])),
    ("AnchorOutOfBounds", change(water_bodies=lambda w: [(*w.water_bodies[0][:2], 99, 0)])),
    ("UnknownRegion", change(regions=[5])),
    ("InvalidRiverPath", change(rivers=lambda w: [(*w.rivers[0][:3], [])])),
    ("InvalidRiverPath", change(rivers=lambda w: [(*w.rivers[0][:3], [10**6])])),
    ("MemberCountMismatch", change(territories=lambda w: [(*w.territories[0][:4], 1, *w.territories[0][5:]), w.territories[1]])),
    ("LandCellInWaterBody", change(cells=lambda w: [(h, False, t, b) for h, _, t, b in w.cells])),
    ("TerritoryIndexOutOfRange", change(cells=lambda w: [(h, x, 9, b) for h, x, _, b in w.cells])),
    ("WaterBodyIndexOutOfRange", change(cells=lambda w: [(h, x, t, 7) for h, x, t, _ in w.cells])),
    ("SectionLengthMismatch", change(biomes=[1, 2])),
]


@pytest.mark.parametrize(("rule", "apply"), BROKEN)
def test_rules(world, rule, apply):
    w = copy.deepcopy(world)
    apply(w)
    with pytest.raises(f.WorldError) as e:
        f.from_bytes(f.to_bytes(w))
    assert e.value.rule == rule


@pytest.mark.parametrize(("rule", "at", "value"), [("InvalidMagic", 0, b"X"), ("UnsupportedSchema", 4, b"\x09"), ("StringTooLong", 8, b"\xff"), ("UnsupportedIdStrategy", 10, b"X")])
def test_headers(world, rule, at, value):
    body = bytearray(f.to_bytes(world)[:-8])
    body[at : at + 1] = value
    with pytest.raises(f.WorldError) as e:
        f.from_bytes(bytes(body) + struct.pack("<Q", fnv1a64(bytes(body))))
    assert e.value.rule == rule


def test_damage_is_noticed(world):
    data = bytearray(f.to_bytes(world))
    data[100] ^= 1
    with pytest.raises(f.WorldError, match="HashMismatch"):
        f.from_bytes(bytes(data))


def test_files_are_read_as_cells(spark, world, tmp_path):
    (tmp_path / "a.vgw").write_bytes(f.to_bytes(world))
    df = f.read_cells(spark, f"file://{tmp_path}/*.vgw")
    assert df.count() == 1536 and df.where("is_water").count() == sum(c[1] for c in world.cells)
    assert {r.territory for r in df.select("territory").distinct().collect()} == {0, 1, None}


def test_tables_of_files(spark, tmp_path):
    w = f.minimal_world(spark)
    assert w.seed == 0
    w.temperature = list(range(48 * 32))
    (tmp_path / "a.gwb").write_bytes(f.to_bytes(w))
    (tmp_path / "b.gwb").write_bytes(f.to_bytes(w))
    for table in f.TABLES:
        rows = [tuple(r)[2:] for r in f.read_table(spark, str(tmp_path), table).orderBy("world", "pos").collect()]
        want = [i if isinstance(i, tuple) else (i,) for i in getattr(w, table)]
        assert [tuple(r) for r in rows] == want * 2, table
    sections = f.read_table(spark, str(tmp_path), "sections")
    assert sections.count() == 2 * 48 * 32 and sections.where("temperature = cell_id AND humidity IS NULL").count() == 2 * 48 * 32
