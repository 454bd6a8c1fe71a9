"""Grid operators on small grids drawn by hand."""

import random
from collections import deque

import numpy as np
import pytest

from tessera.functions import biomes
from tessera.operators import grid, tiles
from tessera.operators.graph import connected_components
from tessera.plans import graphs


def cells(spark, rows, want="~"):
    width = len(rows[0])
    data = [(y * width + x,) for y, r in enumerate(rows) for x, c in enumerate(r) if c == want]
    return spark.createDataFrame(data, "cell_id long"), width


@pytest.mark.parametrize(("rows", "sizes"), [(["~~~~", "....", "~~~~"], [4, 4]), (["....", "~..~", "...."], [2]), (["....", ".~~.", "...."], [2])])
def test_components_wrap_in_x_only(spark, rows, sizes):
    df, width = cells(spark, rows)
    got = {}
    for r in grid.components(df, width).collect():
        got.setdefault(r.component, []).append(r.cell_id)
    assert sorted(map(len, got.values())) == sizes and all(min(v) == k for k, v in got.items())


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(root)}


def test_growth_equals_a_queue(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice("~~~.") for _ in range(9)) for _ in range(7)]
    df, width = cells(spark, rows)
    ids = [r.cell_id for r in df.collect()]
    seeds = rng.sample(ids, 5)
    owner, queue = {c: k for k, c in enumerate(seeds)}, deque(seeds)
    while queue:
        c = queue.popleft()
        y, x = divmod(c, width)
        for dy, dx in grid.FOUR:
            n = (y + dy) * width + (x + dx) % width
            if 0 <= y + dy < len(rows) and n in ids and n not in owner:
                owner[n] = owner[c]
                queue.append(n)
    got = grid.grow(df, spark.createDataFrame([(c, k) for k, c in enumerate(seeds)], "cell_id long, seed int"), width)
    assert {r.cell_id: r.seed for r in got.collect()} == owner


@pytest.mark.parametrize(("band", "breadth"), [(1, 64), (3, 64), (64, 64), (3, 2), (64, 3)])
def test_flow_and_walks_over_many_tiles(spark, monkeypatch, band, breadth):
    monkeypatch.setattr(tiles, "BAND", band)
    monkeypatch.setattr(tiles, "BREADTH", breadth)
    rng, width, height = np.random.default_rng(band), 7, 20
    tall = rng.permutation(width * height) // 2 + 40 * (np.arange(width * height) // width % 9)
    rows = [(c, int(h), bool(rng.random() < 0.05), bool(rng.random() < 0.3)) for c, h in enumerate(tall)]
    df = spark.createDataFrame(rows, "cell_id long, height_m int, ice boolean, desert boolean")
    targets = grid.flow_targets(df, width).cache()
    t = {r.cell_id: r.target for r in targets.collect()}
    flow = {c: 1.0 for c, *_ in rows}
    for c, _, ice, desert in sorted(rows, key=lambda r: (-r[1], r[0])):
        if ice:
            flow[c] = 0.0
        elif c in t:
            flow[t[c]] += flow[c] * (0.5 if desert else 1.0)
    assert {r.cell_id: r.flow for r in grid.accumulate(df, targets, width).collect()} == flow
    want = []
    for start in range(0, width * height, 3):
        c, k = start, 0
        want.append((start, k, c))
        while c in t:
            c, k = t[c], k + 1
            want.append((start, k, c))
    assert sorted(map(tuple, grid.walks(df.where("cell_id % 3 = 0").select("cell_id"), targets, width).collect())) == want


def test_flow_and_walks(spark):
    heights = [[9, 8, 7, 9], [9, 9, 6, 9], [9, 9, 5, 9], [9, 9, 9, 9]]
    rows = [(y * 4 + x, h, x == 1 and y == 0, False) for y, r in enumerate(heights) for x, h in enumerate(r)]
    df = spark.createDataFrame(rows, "cell_id long, height_m int, ice boolean, desert boolean")
    targets = grid.flow_targets(df, 4)
    t = {r.cell_id: r.target for r in targets.collect()}
    flow = {c: 0.0 if ice else 1.0 for c, _, ice, _ in rows}
    for c, _, ice, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if ice:
            flow[c] = 0.0
        elif c in t:
            flow[t[c]] += flow[c]
    assert {r.cell_id: r.flow for r in grid.accumulate(df, targets, 4).collect()} == flow
    way = {r.ord: r.cell_id for r in grid.walks(df.where("cell_id = 0").select("cell_id"), targets, 4).collect()}
    want, c = [0], 0
    while c in t:
        c = t[c]
        want.append(c)
    assert [way[k] for k in range(len(way))] == want


def test_equal_neighbours_go_by_order(spark):
    df = spark.createDataFrame([(k, 9 if k == 5 else 4) for k in range(16)], "cell_id long, height_m int")
    assert {r.cell_id: r.target for r in grid.flow_targets(df, 4).collect()} == {5: 0}


@pytest.mark.parametrize(
    ("t", "h", "biome"),
    [(-100, -10, 4), (-51, -10, 4), (-49, -10, 3), (49, -10, 3), (51, -2000, 2), (51, -10, 1), (100, 4000, 15), (30, 4000, 16), (-10, 3000, 16), (100, 3000, 15)],
)
def test_biome_cases(spark, t, h, biome):
    assert spark.range(1).selectExpr(f"{biomes.case_sql(str(h < 0), str(h), str(t), str(t), '500')} AS b").first().b == biome


def test_dithered_biomes(spark):
    case = lambda t, h: spark.range(1).selectExpr(f"{biomes.case_sql('false', '100', '0', str(t), str(h))} AS b").first().b
    assert [case(-1, 500), case(19, 500), case(-1, 410), case(-1, 390)] == [7, 8, 7, 6]


def test_lloyd_passes_reach_all_land_from_a_seed(spark, monkeypatch):
    surface = spark.createDataFrame([(k, k % 100, 0, 1) for k in range(37)], "cell_id long, x long, y long, height_m int")
    monkeypatch.setattr(graphs, "land", lambda *_: surface)  # one seed, at 0
    got = {r.cell_id: (r.dist, r.seed) for r in graphs.lloyd_two_pass(spark, "").collect()}
    assert got == {k: (abs(k - 18), 0) for k in range(37)}


@pytest.mark.parametrize("breadth", [1024, 4])
def test_around(spark, monkeypatch, breadth):
    monkeypatch.setattr(tiles, "BREADTH", breadth)
    monkeypatch.setattr(tiles, "BAND", 3)
    rng, width = random.Random(6), 9
    h = {k: rng.randint(-50, 50) for k in range(9 * 11 - 4) if k not in (20, 21, 40)}
    want = []
    for k in h:
        y, x = divmod(k, width)
        near = [(place, h[n]) for place, (dy, dx) in enumerate(grid.EIGHT, 1) if y + dy >= 0 and (n := (y + dy) * width + (x + dx) % width) in h]
        want.append((k, len(near), sum(place * v for place, v in near), min(v for _, v in near)))
    df = grid.around(spark.createDataFrame(list(h.items()), "cell_id long, height_m int"), width)
    assert sorted(map(tuple, df.collect())) == want
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rivers_come_without_the_water_bodies(spark, monkeypatch):
    """The query of rivers writes the smoothed grid once and labels land alone."""
    from tessera.plans import worlds
    from tessera.stages import hydrology

    world = worlds.smoothed_world(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, hydrology.hydrology(world).rivers.collect()))
    labelled = []
    label = grid.components
    monkeypatch.setattr(grid, "components", lambda cells, width: labelled.append(cells.count()) or label(cells, width))
    assert sorted(map(tuple, hydrology.rivers(world).collect())) == whole
    assert labelled == [world.cells.where("NOT is_water").count()]


def test_targets_with_columns_kept_are_those_by_a_join(spark):
    rng = np.random.default_rng(3)
    rows = [(c, int(h), bool(i), bool(d)) for c, (h, i, d) in enumerate(zip(rng.integers(0, 9, 1500), rng.random(1500) < 0.1, rng.random(1500) < 0.2, strict=True)) if c % 13]
    df = spark.createDataFrame(rows, "cell_id long, height_m int, ice boolean, desert boolean")
    got = grid.drained(df, 20, "ice", "desert")
    assert sorted(r.cell_id for r in got.collect()) == [r[0] for r in rows]
    targets = grid.flow_targets(df, 20)
    assert sorted(map(tuple, got.where("target >= 0").select("cell_id", "target").collect())) == sorted(map(tuple, targets.collect()))
    flow = sorted(map(tuple, grid.accumulate(df, targets, 20).collect()))
    assert sorted(map(tuple, grid.accumulated(got, 20).collect())) == flow
