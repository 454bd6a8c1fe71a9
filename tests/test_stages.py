"""Stages against published hashes of whole worlds, and against plain loops."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.functions.lattice import quantized, valued
from tessera.functions.noise import Noise, octave_budget, on_cylinder, sine_cosine
from tessera.functions.params import parameters
from tessera.functions.rng import stream_bytes
from tessera.operators import tiles
from tessera.operators.order import apportioned, even_positions, ranked, running
from tessera.operators.stencil import box_blur, march, settled, slump, steepest
from tessera.plans import catalog
from tessera.sources.world_file import stored_hash, synthetic_world, to_bytes
from tessera.stages import partition, pipeline
from tessera.stages import relief as relief_stage
from tessera.stages.biomes import biomes
from tessera.stages.climate import climate
from tessera.stages.facts import enrich, facts
from tessera.stages.hydrology import hydrology
from tessera.stages.partition import WaterSplit, fill, land_components, regions, territories
from tessera.stages.relief import relief
from tessera.stages.render import LAYERS, layer
from tessera.stages.world import StageError, from_world, skeleton, to_world

#: The published seeds, and the published hashes of worlds after each stage in the order of the seeds.
SEEDS = (0, 42, 0xDEADBEEF, 0x5EED5EED5EED5EED, (1 << 64) - 1)
PUBLISHED = {
    "climate": (0x29766B381FBFE0D7, 0x2D8E7CFE16B3BA08, 0x638B51C9D3660DC8, 0x6B51458A5A4CF50F, 0x10FDFFB7B2E21358),
    "biomes": (0xD4EE39687E208473, 0x9778DB8ADFCECCB6, 0x4AE5D8BDECAF0CC0, 0x307029E826E443CC, 0xE3F2E3D8CF118344),
    "hydrology": (0xD67C157E8E065B1A, 0x59DF12C795F54DED, 0x90E5F33408297566, 0xC252E8D3FAABEA78, 0x41AB384B9E1F2215),
    "eroded": (0x8503757A93B0C67F, 0xBC2D6A69C3F54163, 0x4F80D42296E24D45, 0xC96DDDBB5702699F, 0x4D9DFA8E939B2CA7),
    "plain": (0x0969360FC6A7AE4D, 0x720481EAC0CE6D2F, 0xA82BCE8D2567352F, 0x8821A7349AD6808C, 0x940F5E1BB2411AB9),
    "regions": (0x72B6401FF1F48D1B, 0xCB734B4D73AF031B, 0x1D13980B86E95710, 0xAE88FE2903B80E2D, 0x7C0F4BE7F925B39B),
    "enriched": (0x80A99D8DA47FE716, 0x03AEF60521E7CBD1, 0x7646ACA8F81C7684, 0x77AFBF47290DC008, 0x33CAAC499669C622),
}
WHOLE = {seed: {k: v[i] for k, v in PUBLISHED.items()} for i, seed in enumerate(SEEDS)}


def digest(world):
    return stored_hash(to_bytes(to_world(world)))


@pytest.mark.parametrize("seed", SEEDS)
def test_climate_biomes_and_hydrology_of_the_synthetic_worlds(spark, seed):
    world = from_world(spark, synthetic_world(spark, seed))
    for stage in (climate, biomes, hydrology):
        world = stage(world)
        assert digest(world) == WHOLE[seed][stage.__name__], stage.__name__


def physical_world(spark, seed, **settings):
    return hydrology(biomes(climate(relief(skeleton(spark, 48, 32, seed), parameters("terrain", settings)))))


@pytest.fixture(scope="module")
def physical(spark):
    return physical_world(spark, 42)


@pytest.fixture(scope="module")
def whole(physical):
    return regions(territories(physical, 12, 8))


@pytest.mark.parametrize("seed", SEEDS)
def test_relief_without_erosion(spark, seed):
    assert digest(physical_world(spark, seed, erosion_enabled=False)) == WHOLE[seed]["plain"]


@pytest.mark.parametrize("seed", SEEDS)
def test_whole_worlds(spark, seed):
    world = physical_world(spark, seed)
    assert digest(world) == WHOLE[seed]["eroded"]
    world = regions(territories(world, 12, 8))
    assert digest(world) == WHOLE[seed]["regions"]
    assert digest(enrich(world)) == WHOLE[seed]["enriched"]


def test_facts_of_territories(whole):
    rich = enrich(whole)
    known = {r.territory: r for r in facts(rich).collect()}
    assert len(known) == 20 and all(r.natural_potential == 0 and not r.is_coastal for p, r in known.items() if p >= 12)
    assert sum(r.territories for r in land_components(rich).collect()) == 12


def test_single_precision_sines():
    import ctypes.util

    name = ctypes.util.find_library("m")
    if not name:
        pytest.skip("no C library to compare with")
    library = ctypes.CDLL(name)
    angles = np.random.default_rng(2).uniform(-7, 14, 3000).astype(np.float32)
    for got, f in zip(sine_cosine(angles), (library.sinf, library.cosf), strict=True):
        f.restype, f.argtypes = ctypes.c_float, [ctypes.c_float]
        assert got.tolist() == [f(float(a)) for a in angles]


def test_layers(whole):
    for name in LAYERS:
        rows = layer(whole, name).collect()
        assert len({r.cell_id for r in rows}) == len(rows) == 48 * 32
        assert all(0 <= v <= 255 for r in rows for v in (r.r, r.g, r.b)), name
    assert layer(skeleton(whole.spark, 3, 2, 1), "biome") is None


def test_water_by_size(physical):
    split = territories(physical, 0, WaterSplit(cells=40))
    sizes = [r.cell_count for r in split.territories.collect()]
    water = physical.cells.where("is_water").count()
    assert sum(sizes) == water and abs(len(sizes) - water / 40) < 3
    assert np.std(sizes) / np.mean(sizes) < 0.6
    with pytest.raises(StageError):
        territories(physical, 0, WaterSplit(cells=0))
    with pytest.raises(StageError):
        territories(physical, 100_000, 0)


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "w.gwb"
    assert cli.main(["dump", "--seed", "42", "--out", str(out)], spark) == 0
    assert stored_hash(out.read_bytes()) == WHOLE[42]["enriched"]
    assert cli.main(["validate", "--input", str(out)], spark) == 0
    shown = capsys.readouterr().out
    assert "48×32 cells, 20 territories" in shown and "land component(s)" in shown
    assert cli.main(["render", "--input", str(out), "--out", str(tmp_path / "m"), "--zoom", "2"], spark) == 0
    assert len(list(tmp_path.glob("m.*.png"))) == 10
    out.write_bytes(out.read_bytes()[:-1] + b"\0")
    assert cli.main(["validate", "--input", str(out)], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["render", "--out", "x"], spark)


def test_warp_and_ridges_change_the_relief(spark):
    digests = set()
    for extra in ({}, {"warp_strength": 0.15}, {"ridge_strength": 0.5}, {"land_hypsometry": 3.0}):
        p = parameters("terrain", {"erosion_enabled": False, "min_feature_cells": 2} | extra)
        cells = relief(skeleton(spark, 40, 20, 7), p).cells
        share = cells.agg(F.avg(F.when(F.col("is_water"), 0.0).otherwise(1.0))).first()[0]
        assert abs(share - 0.3) <= 0.015
        digests.add(tuple(r.height_m for r in cells.orderBy("cell_id").collect()))
    assert len(digests) == 4


def test_noise_has_no_seam_and_stays_in_range():
    noise = Noise.named(7, "heightmap", 0.05, 4)
    y = np.linspace(0, 50, 200)
    assert np.abs(on_cylinder(noise, 200, np.full(200, 199.5), y) - on_cylinder(noise, 200, np.full(200, -0.5), y)).max() < 5e-3
    values = noise.at(*np.random.default_rng(1).uniform(-900, 900, (3, 20000)))
    assert -1 <= values.min() < -0.4 and 0.4 < values.max() <= 1 and abs(values.mean()) < 0.05
    assert [octave_budget(8, w, 8) for w in (1024.0, 50.0, 24.0)] == [8, 3, 2] and octave_budget(5, 0.0, 8) == 5


def one_by_one(areas, total):
    """Seats by a loop over the rows in the order of their remainders."""
    whole = sum(areas)
    seats = [max(a * total // whole, 1) for a in areas]
    missing = total - sum(seats)
    for _, _, k in sorted(((-1 if missing > 0 else 1) * (a * total % whole), -a, k) for k, a in enumerate(areas)):
        change = min(areas[k] - seats[k], missing) if missing > 0 else -min(seats[k] - 1, -missing)
        seats[k] += change
        missing -= change
    return seats


@pytest.mark.parametrize(("areas", "total"), [([76, 9, 4], 4), ([10, 10, 10], 6), ([1, 1, 9], 5), ([10, 10, 10], 5), ([100, 1, 1, 1], 6), ([100, 1, 1, 1], 4), ([3, 1, 4, 1, 5, 9, 2, 6] * 9, 150), ([2] * 40, 41), ([1] * 7, 7), ([10**12, 10**11], 9 * 10**5)])
def test_apportionment(spark, areas, total):
    rows = spark.createDataFrame(list(enumerate(areas)), "pos long, area long").repartition(3)
    got = [r.seats for r in apportioned(rows, total).orderBy("pos").collect()]
    assert got == one_by_one(areas, total) and sum(got) == total
    assert total != 4 or areas != [76, 9, 4] or got == [2, 1, 1]


def test_running_sums(spark):
    rows = [(k, (k * 37) % 11 - 3) for k in range(200)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    got = {r.k: r.before for r in running(df, F.col("v"), F.desc("k"), name="before").collect()}
    assert got == {k: sum(v for j, v in rows if j > k) for k, _ in rows}
    assert running(df.limit(0), F.col("v"), F.col("k"), name="before").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_by_bands_is_the_sequence(spark, monkeypatch, seed):
    """Against a loop, over many bands: means that move across them, ties, and a stretch of rows without any mean."""
    monkeypatch.setattr(tiles, "BAND", 3)
    monkeypatch.setattr(tiles, "BREADTH", 4)
    monkeypatch.setattr(partition, "REACH", 2)
    rng = np.random.default_rng(seed)
    width = 6
    ids = np.concatenate([np.arange(60 * width), np.arange(100 * width, 110 * width)])
    own = {int(c): int(p) for c, p in zip(rng.choice(60 * width, 40, replace=False), rng.integers(0, 12, 40), strict=True)}
    rest = [int(c) for c in ids if int(c) not in own and rng.random() < 0.5]
    sums = {}
    for c, p in own.items():
        s = sums.setdefault(p, [0, 0, 0])
        s[0], s[1], s[2] = s[0] + c % width, s[1] + c // width, s[2] + 1
    want = {}
    for c in sorted(rest):
        x, y = c % width, c // width
        p = min(sums, key=lambda p: ((x - sums[p][0] // sums[p][2]) ** 2 + (y - sums[p][1] // sums[p][2]) ** 2, p))
        want[c] = p
        sums[p] = [sums[p][0] + x, sums[p][1] + y, sums[p][2] + 1]
    seen = []
    write = partition.cut
    monkeypatch.setattr(partition, "cut", lambda d: (lambda t: seen.append(t) or t)(write(d)))
    monkeypatch.setattr(partition, "drop_cut", lambda d: None)
    found = fill(spark.createDataFrame(list(own.items()), "cell_id long, pos long"), spark.createDataFrame([(c,) for c in rest], "cell_id long"), width)
    assert {r.cell_id: r.pos for r in found.collect()} == want
    assert seen[-1].select("band").distinct().count() > 10


def test_fill_moves_the_means(spark):
    own = spark.createDataFrame([(0, 0), (1, 0), (9, 1)], "cell_id long, pos long")
    rest = spark.createDataFrame([(k,) for k in (4, 5, 6, 7)], "cell_id long")
    # Means 0 and 9: 4 goes to 0, whose mean is then 1 (5 / 3); 5 is as far from 1 as from 9, and the first takes it.
    got = {r.cell_id: r.pos for r in fill(own, rest, 10).collect()}
    assert got == {4: 0, 5: 0, 6: 1, 7: 1}


def test_ranks_and_even_samples(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "(id * 7919) % 1009 AS v").repartition(5)
    rows = ranked(df, F.desc("v"), F.col("id")).collect()
    assert [r.id for r in sorted(rows, key=lambda r: r["rank"])] == [r.id for r in sorted(rows, key=lambda r: (-r.v, r.id))]
    assert sorted(r["rank"] for r in rows) == list(range(1000))
    within = ranked(df, F.col("g"), F.col("v"), F.col("id"), within="g").collect()
    for g in range(7):
        assert [r["rank"] for r in sorted((r for r in within if r.g == g), key=lambda r: (r.v, r.id))] == list(range(sum(r.g == g for r in within)))
    for n, k in ((10, 10), (11, 10), (100, 7), (5, 1)):
        got = spark.range(n).where(even_positions(F.lit(n), F.lit(k), F.col("id"))).collect()
        step = 1 if n == k else (n - 1) // k
        assert sorted(r.id for r in got) == [i * step for i in range(k)]


@pytest.mark.parametrize(("wrap", "width"), [(True, 9), (True, 4), (False, 9)])
def test_blur_against_loops(spark, wrap, width):
    rng, height, r = np.random.default_rng(2), 140, 2
    h = rng.random((height, width))
    cells = spark.createDataFrame([(y * width + x, x, y, float(h[y, x])) for y in range(height) for x in range(width)], "cell_id long, x int, y int, v double")
    got = np.array([q.v for q in box_blur(cells, width, r, "v", wrap).orderBy("cell_id").collect()]).reshape(height, width)
    cols = lambda x: (range(width) if width <= 2 * r + 1 else [(x + k) % width for k in range(-r, r + 1)]) if wrap else range(max(0, x - r), min(width, x + r + 1))
    flat = np.stack([h[:, list(cols(x))].mean(1) for x in range(width)], 1)
    want = np.stack([flat[max(0, y - r) : y + r + 1].mean(0) for y in range(height)])
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize(("width", "height"), [(7, 6), (2, 5), (1, 4), (5, 150)])
def test_slump_against_loops(spark, width, height):
    rng = np.random.default_rng(3)
    h = np.round(rng.random(width * height), 1)

    def slide(rows, _):
        above, way = steepest(rows)
        return settled(rows, np.where(above > 0.25, (above - 0.25) * 0.3, 0.0), way)

    cells = spark.createDataFrame([(i, float(v)) for i, v in enumerate(h)], "cell_id long, h double")
    want = h.copy()
    for _ in range(3):
        old = want.copy()
        for i in range(width * height):
            y, x = divmod(i, width)
            best, to = 0.0, i
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= y + dy < height:
                    n = (y + dy) * width + (x + dx) % width
                    if old[i] - old[n] > best:
                        best, to = old[i] - old[n], n
            if best > 0.25:
                want[i] -= (best - 0.25) * 0.3
                want[to] += (best - 0.25) * 0.3
    got = [r.h for r in slump(cells, width, "h", 3, slide).orderBy("cell_id").collect()]
    assert got == want.tolist()


def test_march_goes_with_the_wind():
    h, sea = np.array([[0.0, 0.1, 0.3]] * 2), np.array([[True, False, False]] * 2)
    humidity, rain = march(h, sea, np.array([True, False]), 0.2, 0.3, 0.02, 8.0, 20.0)
    assert rain[0, 1] == pytest.approx(0.2 * (0.02 + 0.8)) and rain[1].sum() == 0 and humidity[1].tolist() == [1.0, 0.3, 0.3]


def test_default_sizes():
    assert (pipeline.WIDTH, pipeline.HEIGHT, pipeline.LAND, pipeline.WATER) == (48, 32, 12, 8)


def test_stage_queries(spark):
    known, data = catalog.queries(), "/root/testdata/sf0.001"
    cells = spark.read.parquet(f"{data}/orders.parquet").count()
    for name in ("noise_field", "relief_stage", "climate_stage", "biome_stage"):
        df = known[name](spark, data)
        assert df.select("cell_id").distinct().count() == cells and not df.where(" OR ".join(f"{c} IS NULL" for c in df.columns)).count()
    found = known["territory_stage"](spark, data).collect()
    assert sum(r.cell_count for r in found) == cells and len({r.id for r in found}) == len(found) and all(r.region for r in found)


def test_lattices_refuse_what_does_not_fit(spark):
    value = lambda v, lattice="temperature_dc": spark.range(1).select(quantized(F.lit(v).cast("double"), lattice).alias("q")).first().q
    assert [value(v) for v in (0.25, 0.35, -1.0, 3276.7, None)] == [2, 3, -10, 32767, None]
    assert value(2.5, "height_m") == 2 and spark.range(1).select(valued(F.lit(7), "weight").alias("v")).first().v == 0.007
    for wrong in (float("nan"), float("inf"), -float("inf"), 3277.0, -3277.0):
        with pytest.raises(Exception, match="no whole steps"):
            value(wrong)


def test_rain_by_bands(spark, monkeypatch):
    monkeypatch.setattr(relief_stage, "RAIN_CELLS", 1)  # bands of 124 rows
    monkeypatch.setattr(relief_stage, "STREAM_BLOCKS", 7)
    width, height, seed = 9, 700, 5
    p = parameters("terrain", {"droplets_per_hundred_cells": 300.0})
    h = np.random.default_rng(1).random(width * height).tolist()
    cells = spark.createDataFrame(list(enumerate(h)), "cell_id long, h double").repartition(3)
    got = relief_stage.droplets(cells, p, seed, width, height).orderBy("cell_id").collect()
    drops = width * height * 3 // 100
    for first, second in struct.iter_unpack("<QQ", stream_bytes(seed, "terrain.erosion", 16 * drops)):
        relief_stage.rain(h, first % width, second % height, width, height, relief_stage.setting(p, "power"))
    assert [r.cell_id for r in got] == list(range(width * height)) and [r.h for r in got] == h
