"""Operators over many tiles, which wrap around the seam, against the same over one tile."""

import numpy as np
import pytest

from tessera.operators import grid, stencil, tiles
from tessera.plans import graphs

WIDTH, HEIGHT = 23, 11
SIZES = [(4, 6), (3, 8), (64, 6), (4, 64)]


@pytest.fixture
def rows():
    rng = np.random.default_rng(5)
    # Half steps, so that ties occur everywhere.
    return [(c, int(h) * 50 - 600, bool(w)) for c, (h, w) in enumerate(zip(rng.integers(0, 40, WIDTH * HEIGHT), rng.random(WIDTH * HEIGHT) < 0.6, strict=True))]


def small(monkeypatch, band, breadth):
    monkeypatch.setattr(tiles, "BAND", band)
    monkeypatch.setattr(tiles, "BREADTH", breadth)


def both(spark, monkeypatch, rows, band, breadth, f):
    df = spark.createDataFrame(rows, "cell_id long, height_m int, keep boolean").repartition(5)
    one = sorted(map(tuple, f(df).collect()))
    small(monkeypatch, band, breadth)
    return one, sorted(map(tuple, f(df).collect()))


@pytest.mark.parametrize(("band", "breadth"), SIZES)
@pytest.mark.parametrize("halo", [0, 1, 3])
def test_each_tile_has_its_cells_and_those_beside(spark, monkeypatch, band, breadth, halo):
    small(monkeypatch, band, breadth)
    df = spark.range(WIDTH * HEIGHT).toDF("cell_id")
    got = {}
    for r in tiles.tiled(df, WIDTH, halo).collect():
        got.setdefault(r.tile, {}).setdefault(r.cell_id, []).append(r.own)
    number = tiles.tile_of(WIDTH)(np.arange(WIDTH * HEIGHT))
    got = {tile: held for tile, held in got.items() if any(map(any, held.values()))}  # the last rows also go to tiles of none
    assert {r.t for r in df.selectExpr(f"{tiles.tile_sql(WIDTH)} AS t").collect()} == set(number.tolist()) == set(got)
    for tile, held in got.items():
        own = np.flatnonzero(number == tile)
        y, x = np.divmod(own, WIDTH)
        want = {(b * WIDTH + (a % WIDTH)) for v, u in zip(y, x, strict=True) for b in range(v - halo, v + halo + 1) for a in range(u - halo, u + halo + 1) if 0 <= b < HEIGHT}
        assert set(held) == want and all(held[c] == [c in set(own.tolist())] for c in held)


def test_halos_that_do_not_fit_are_refused(spark, monkeypatch):
    small(monkeypatch, 4, 6)
    with pytest.raises(ValueError, match="halo"):
        tiles.tiled(spark.range(9).toDF("cell_id"), 23, 4)


def test_edges_are_all_cells_that_touch_another_tile(spark, monkeypatch):
    small(monkeypatch, 4, 6)
    number = tiles.tile_of(WIDTH)(np.arange(WIDTH * HEIGHT)).reshape(HEIGHT, WIDTH)
    touch = np.zeros(number.shape, bool)
    for dx in (-1, 0, 1):
        side = np.roll(number, dx, 1)
        touch |= side != number
        touch[1:] |= side[:-1] != number[1:]
        touch[:-1] |= side[1:] != number[:-1]
    edge = {r.cell_id for r in spark.range(WIDTH * HEIGHT).toDF("cell_id").where(tiles.edge_sql(WIDTH)).collect()}
    assert set(np.flatnonzero(touch.ravel()).tolist()) <= edge and len(edge) < 0.9 * WIDTH * HEIGHT


@pytest.mark.parametrize(("band", "breadth"), SIZES)
def test_components_growth_and_targets(spark, monkeypatch, rows, band, breadth):
    def f(df):
        land = df.where("keep")
        seeds = land.where("cell_id % 31 = 0").selectExpr("cell_id", "cell_id div 31 AS seed")
        a = grid.components(land.select("cell_id"), WIDTH).selectExpr("'c' AS kind", "cell_id", "component AS a", "0L AS b")
        b = grid.grow(land, seeds, WIDTH).selectExpr("'g'", "cell_id", "CAST(dist AS LONG)", "seed")
        c = grid.flow_targets(df, WIDTH).selectExpr("'t'", "cell_id", "target", "0L")
        return a.union(b).union(c)

    one, many = both(spark, monkeypatch, rows, band, breadth, f)
    assert one == many and len(one) > 2 * WIDTH * HEIGHT * 0.6


def test_a_long_way_in_one_wide_row(spark, monkeypatch):
    small(monkeypatch, 64, 5)
    df = spark.range(40).toDF("cell_id")
    got = {r.cell_id: r.dist for r in grid.grow(df, spark.createDataFrame([(3, 0)], "cell_id long, seed long"), 40).collect()}
    assert got == {c: min((c - 3) % 40, (3 - c) % 40) for c in range(40)}
    assert {r.component for r in grid.components(df, 40).collect()} == {0}


@pytest.mark.parametrize(("band", "breadth"), [(4, 6), (3, 7), (64, 6)])
def test_slumping(spark, monkeypatch, rows, band, breadth):
    """One pass (a halo of two), with sums of doubles that depend on the order of the seam."""

    def slide(h, _):
        above, way = stencil.steepest(h)
        return stencil.settled(h, np.where(above > 75.0, (above - 75.0) * 0.3, 0.0), way)

    one, many = both(spark, monkeypatch, rows, band, breadth, lambda df: stencil.slump(df.selectExpr("cell_id", "height_m * 1.1D AS h"), WIDTH, "h", 1, slide))
    assert one == many


@pytest.mark.parametrize("wrap", [True, False])
@pytest.mark.parametrize(("band", "breadth"), [(4, 6), (2, 2), (1, 64)])
def test_blurs(spark, monkeypatch, rows, band, breadth, wrap):
    """A radius over the size of tiles takes wider ones."""
    one, many = both(spark, monkeypatch, rows, band, breadth, lambda df: stencil.box_blur(df.selectExpr("cell_id", f"CAST(cell_id % {WIDTH} AS INT) AS x", f"CAST(cell_id div {WIDTH} AS INT) AS y", "height_m * 1.1D AS v"), WIDTH, 3, "v", wrap))
    assert one == many


@pytest.mark.parametrize(("band", "breadth"), SIZES)
def test_moisture_over_tiles(spark, monkeypatch, rows, band, breadth):
    air = stencil.Air(0.18, 0.3)
    one, many = both(spark, monkeypatch, rows, band, breadth, lambda df: stencil.moisture_along_rows(df.selectExpr("cell_id", "height_m", "NOT keep AS is_water"), WIDTH, HEIGHT, air))
    one, many = np.array(one), np.array(many)
    assert one.shape == many.shape and np.abs(one - many).max() < 1e-12
    east = stencil.eastward(stencil.latitude(np.arange(HEIGHT), HEIGHT))
    assert 0 < east.sum() < HEIGHT
    h, sea = (np.array([r[k] for r in rows]).reshape(HEIGHT, WIDTH) for k in (1, 2))
    humidity, rain = stencil.march(h / 4000.0, ~sea, east, 0.18, 0.3, 0.02, 8.0, 20.0)
    assert one[:, 1].tolist() == humidity.ravel().tolist() and one[:, 2].tolist() == rain.ravel().tolist()


def test_moisture_by_tiles_gives_the_same_whole_steps(spark, monkeypatch, sf_dir="/root/testdata/sf0.001"):
    one = sorted(map(tuple, graphs.moisture_march(spark, sf_dir).collect()))
    small(monkeypatch, 16, 7)
    assert sorted(map(tuple, graphs.moisture_march(spark, sf_dir).collect())) == one


def test_growth_grows_only_tiles_with_offers_again(spark, monkeypatch):
    """A flood down one of many tiles' columns: the other tiles are grown once."""
    small(monkeypatch, 3, 6)
    df = spark.range(600).toDF("cell_id").where("cell_id % 6 <> 5 OR cell_id < 30")
    seeds = spark.createDataFrame([(0, 1), (300, 0)] + [(c * 6, c) for c in range(60, 100)], "cell_id long, seed long")
    sizes, write = [], grid.cut
    monkeypatch.setattr(grid, "cut", lambda d: (lambda t: sizes.append(t.count()) or t)(write(d)))
    got = {r.cell_id: (r.dist, r.seed) for r in grid.grow(df, seeds, 6).collect()}
    held = {c for c in range(600) if c % 6 != 5 or c < 30}
    want, front = {}, sorted((s, c) for c, s in ((r.cell_id, r.seed) for r in seeds.collect()))
    dist = 0
    while front:
        nxt = {}
        for s, c in front:
            if c not in want:
                want[c] = (dist, s)
        for s, c in front:
            if want[c] == (dist, s):
                y, x = divmod(c, 6)
                for n in ((y - 1) * 6 + x, (y + 1) * 6 + x, y * 6 + (x - 1) % 6, y * 6 + (x + 1) % 6):
                    if n in held and n not in want:
                        nxt[n] = min(s, nxt.get(n, s))
        front, dist = sorted((s, c) for c, s in nxt.items()), dist + 1
    assert got == want
    assert len(sizes) > 12 and sum(n == len(held) for n in sizes) == 2  # many rounds, but all cells are written at the start and at the end


def sides(cell):
    y, x = divmod(cell, WIDTH)
    return [n for n in ((y - 1) * WIDTH + x, (y + 1) * WIDTH + x, y * WIDTH + (x - 1) % WIDTH, y * WIDTH + (x + 1) % WIDTH) if 0 <= n < WIDTH * HEIGHT]


@pytest.mark.parametrize(("band", "breadth"), SIZES)
def test_touching_owners_by_tiles(spark, monkeypatch, rows, band, breadth):
    small(monkeypatch, band, breadth)
    own = {c: (w, h % 17) for c, h, w in rows if c % 7}
    df = spark.createDataFrame([(c, w, o) for c, (w, o) in own.items()], "cell_id long, surface boolean, owner int")
    want = {(own[c][1], own[n][1]) for c in own for n in sides(c) if n in own and own[n][0] == own[c][0] and own[c][1] < own[n][1]}
    got = [tuple(r) for r in grid.touching(df, WIDTH).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


@pytest.mark.parametrize(("band", "breadth"), SIZES)
def test_shores_by_tiles(spark, monkeypatch, rows, band, breadth):
    small(monkeypatch, band, breadth)
    own = {c: (w, h % 97 if h % 3 else -1) for c, h, w in rows if c % 7}
    df = spark.createDataFrame([(c, w, o) for c, (w, o) in own.items()], "cell_id long, wet boolean, owner int")
    want = {o for c, (w, o) in own.items() if not w and o >= 0 and any(own.get(n, (False, 0))[0] for n in sides(c))}
    got = [r.owner for r in grid.shores(df, WIDTH).collect()]
    assert sorted(got) == sorted(want) and 5 < len(want)
