"""Queries that iterate over the grid, with recursive oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.anchors import anchored_id
from tessera.operators import grid
from tessera.operators.graph import connected_components
from tessera.operators.order import apportioned, even_positions, ranked
from tessera.operators.stencil import Air, box_blur, moisture_along_rows, settled, slump, steepest
from tessera.plans.relational import ORACLE_ONLY, edges, flow_sql, territories, water_bodies
from tessera.plans.scalar import LAND_COLOR, RIVER_COLOR, RIVERS_WATER_COLOR, weight_of
from tessera.plans.sql import ORACLE, SPARK, Dialect, cells, run, smooth, stencil4
from tessera.session import cut

WIDTH = 100
QUERIES = {}
ORACLES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def oracle(f):
    ORACLES[f.__name__] = f
    return f


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return cut(run(spark, sf_dir, text))


def stable_ids_text(d: Dialect) -> str:
    probe = "(row_number() OVER (PARTITION BY ax, ay ORDER BY pos) - 1)"
    return f"WITH {cells(d)}, {territories(d)}, p AS (SELECT pos, ax, ay, {probe} AS probe FROM terr) SELECT pos, {anchored_id(d, 1, 'ax', 'ay', ['0'], 'probe')} AS id FROM p"


@query
def stable_ids(spark, sf_dir):
    return run(spark, sf_dir, stable_ids_text(SPARK))


ORACLES["stable_ids"] = stable_ids_text

# Components


def land(spark, sf_dir, where="NOT is_water"):
    return sql(spark, sf_dir, f"WITH {cells(SPARK)} SELECT cell_id, x, y, height_m FROM cells WHERE {where}")


def least_labels(start: str, edges: str) -> str:
    """For the oracle: each node's least reachable node, over edges (a, b) in both directions."""
    return f"""r(cell_id, lab) USING KEY (cell_id) AS ({start} UNION
      SELECT e.b, min(r.lab) FROM r JOIN {edges} e ON e.a = r.cell_id JOIN recurring.r q ON q.cell_id = e.b WHERE r.lab < q.lab GROUP BY e.b),
    comp AS (SELECT cell_id, lab AS component FROM r)"""


def closure(where: str, source: str = "cells") -> str:
    d = ORACLE
    return f"""s AS (SELECT cell_id, x, y FROM {source} WHERE {where}), {stencil4(d, 's')}, e AS (SELECT st4.cell_id AS a, st4.nid AS b FROM st4 JOIN s ON s.cell_id = st4.nid),
    {least_labels('SELECT cell_id, cell_id FROM s', 'e')}"""


@query
def cell_components(spark, sf_dir):
    return grid.components(land(spark, sf_dir), WIDTH)


ORACLES["cell_components"] = lambda d: f"WITH RECURSIVE {cells(d)}, {closure('NOT is_water')} SELECT cell_id, component FROM comp"


def water_rows(spark, sf_dir) -> int:
    """The number of the last row."""
    return run(spark, sf_dir, f"WITH {cells(SPARK)} SELECT max(y) FROM cells").first()[0] or 0


@query
def water_body_kind(spark, sf_dir):
    """Water bodies with size, anchor and kind: ocean at either pole's row, sea from 200 cells, else lake."""
    water = land(spark, sf_dir, "is_water")
    last = water_rows(spark, sf_dir)
    return (
        water.join(grid.components(water, WIDTH), "cell_id")
        .groupBy("component")
        .agg(F.count("*").alias("n"), F.expr("sum(x) div count(*)").alias("anchor_x"), F.expr("sum(y) div count(*)").alias("anchor_y"), F.expr(f"CASE WHEN bool_or(y = 0 OR y = {last}) THEN 0 WHEN count(*) >= 200 THEN 1 ELSE 2 END").alias("kind"))
    )


ORACLES["water_body_kind"] = lambda d: f"""WITH RECURSIVE {cells(d)}, {closure('is_water')} SELECT component, count(*) AS n, CAST(sum(x) // count(*) AS BIGINT) AS anchor_x, CAST(sum(y) // count(*) AS BIGINT) AS anchor_y,
  CASE WHEN bool_or(y = 0 OR y = (SELECT max(y) FROM cells)) THEN 0 WHEN count(*) >= 200 THEN 1 ELSE 2 END AS kind FROM comp JOIN cells USING (cell_id) GROUP BY component"""


def territory_components(spark, sf_dir) -> DataFrame:
    e = sql(spark, sf_dir, f"WITH {cells(SPARK)}, {edges(SPARK)} SELECT a, b FROM edges")
    t = sql(spark, sf_dir, f"WITH {cells(SPARK)}, {territories(SPARK)} SELECT pos, ax, ay FROM terr")
    found = connected_components(e).withColumnRenamed("node", "pos")
    return t.join(found, "pos", "left").withColumn("component", F.coalesce("component", "pos"))


TERRITORY_CLOSURE = f"""{cells(ORACLE)}, {edges(ORACLE)}, {territories(ORACLE)}, ee AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
  r(pos, lab) AS (SELECT pos, pos FROM terr UNION SELECT ee.b, r.lab FROM r JOIN ee ON ee.a = r.pos WHERE r.lab < ee.b), comp AS (SELECT pos, min(lab) AS component FROM r GROUP BY pos)"""


@query
def land_components(spark, sf_dir):
    """Sizes of land components in territories."""
    return territory_components(spark, sf_dir).groupBy("component").agg(F.count("*").alias("territories"))


ORACLES["land_components"] = lambda d: f"WITH RECURSIVE {TERRITORY_CLOSURE} SELECT component, count(*) AS territories FROM comp GROUP BY component"


@query
def regions(spark, sf_dir):
    """The region of each territory, by the smallest member anchor."""
    t = territory_components(spark, sf_dir)
    least = t.groupBy("component").agg(F.min(F.struct("ay", "ax")).alias("m"))
    named = least.select("component", F.expr(anchored_id(SPARK, 4, "m.ax", "m.ay", [], "0")).alias("region"))
    return t.join(named, "component").select("pos", "region")


ORACLES["regions"] = lambda d: f"""WITH RECURSIVE {TERRITORY_CLOSURE}, m AS (SELECT component, min(ay) AS my, arg_min(ax, (ay, ax)) AS mx FROM comp JOIN terr USING (pos) GROUP BY component)
  SELECT pos, {anchored_id(d, 4, 'mx', 'my', [], '0')} AS region FROM comp JOIN m USING (component)"""

# Growth

@query
def bfs_territories(spark, sf_dir):
    """Land that seeds (every 37th cell) reach, each cell to the nearest."""
    surface = land(spark, sf_dir)
    seeds = surface.where("cell_id % 37 = 0").select("cell_id", F.expr("cell_id div 37").alias("seed"))
    return grid.grow(surface, seeds, WIDTH).select("cell_id", F.col("dist").cast("long").alias("dist"), "seed")


ORACLES["bfs_territories"] = lambda d: f"""WITH RECURSIVE {cells(d)}, s AS (SELECT cell_id, x, y FROM cells WHERE NOT is_water), {stencil4(d, 's')}, e AS (SELECT st4.cell_id AS a, st4.nid AS b FROM st4 JOIN s ON s.cell_id = st4.nid),
  r(cell_id, dist, seed) USING KEY (cell_id) AS (SELECT cell_id, 0, cell_id // 37 FROM s WHERE cell_id % 37 = 0 UNION
    SELECT e.b, min(r.dist) + 1, min(r.seed) FROM r JOIN e ON e.a = r.cell_id LEFT JOIN recurring.r q ON q.cell_id = e.b WHERE q.cell_id IS NULL GROUP BY e.b)
  SELECT cell_id, CAST(dist AS BIGINT) AS dist, seed FROM r"""


@query
def lloyd_two_pass(spark, sf_dir):
    """Seeds, then twice: grow, and move each seed to the member next to its territory's seam-aware mean."""
    surface = land(spark, sf_dir)
    seeds = surface.where("cell_id % 37 = 0").select("cell_id", F.expr("cell_id div 37").alias("seed"))
    for _ in range(2):
        own = grid.grow(surface, seeds, WIDTH).join(surface.select("cell_id", "x", "y"), "cell_id")
        at = seeds.select("seed", (F.col("cell_id") % WIDTH).alias("fx"))
        own = cut(own.join(at, "seed").withColumn("rx", F.expr("pmod(x - fx + 50, 100) - 50")))
        mean = own.groupBy("seed").agg(F.expr("sum(rx) div count(*)").alias("mx"), F.expr("sum(y) div count(*)").alias("my"))
        near = own.join(mean, "seed").groupBy("seed").agg(F.expr("min_by(cell_id, struct((rx - mx) * (rx - mx) + (y - my) * (y - my), cell_id))").alias("cell_id"))
        seeds = cut(near.select("cell_id", "seed"))
    return grid.grow(surface, seeds, WIDTH).select("cell_id", F.col("dist").cast("long").alias("dist"), "seed")


# Flow, over heights summed in 5 x 5 windows

ICE, DESERT = "cell_id % 97 = 5", "cell_id % 11 = 3"
#: Share of a land component's cells whose flow makes a river, and the least flow of one.
SHARE, LEAST = "1.2E-3", "8E0"


def smooth_cells(spark, sf_dir) -> DataFrame:
    """Heights summed over 5 x 5 windows, by bands of rows."""
    return cut(summed_cells(spark, sf_dir, f"WITH {cells(SPARK)} SELECT cell_id, x, y, height_m FROM cells").drop("x", "y"))


def summed_cells(spark, sf_dir, text: str) -> DataFrame:
    """The same with the other columns of a text that has cell_id, x, y and height_m; not written yet."""
    summed = box_blur(run(spark, sf_dir, text), WIDTH, 2, "height_m", True, F.sum)
    return summed.selectExpr("*", "height_m <= 0 AS is_water", f"{ICE} AS ice", f"{DESERT} AS desert")


def flowing(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, targets (ice has none) and flow."""
    base = smooth_cells(spark, sf_dir)
    targets = cut(grid.flow_targets(base, WIDTH).join(base.where("NOT ice").select("cell_id"), "cell_id"))
    return base, targets, grid.accumulate(base, targets, WIDTH)


def flow_oracle(d: Dialect) -> str:
    """RECURSIVE: tgt without ice, and every way down with what is left of a unit."""
    return f"""{cells(d)}, {smooth(d)}, {flow_sql(d)}, tgt AS (SELECT cell_id, target FROM target WHERE NOT ({ICE})),
    way(src, cell_id, amount) AS (SELECT cell_id, cell_id, CASE WHEN {ICE} THEN 0E0 ELSE 1E0 END FROM smooth
      UNION ALL SELECT w.src, t.target, w.amount * CASE WHEN w.cell_id % 11 = 3 THEN 5E-1 ELSE 1E0 END FROM way w JOIN tgt t ON t.cell_id = w.cell_id),
    flow AS (SELECT cell_id, CASE WHEN {ICE} THEN 0E0 ELSE sum(amount) END AS flow FROM way GROUP BY cell_id),
    {closure('height_m > 0', 'smooth')}, least AS (SELECT component, greatest({SHARE} * count(*), {LEAST}) AS least FROM comp GROUP BY component),
    river AS (SELECT f.cell_id, f.flow FROM flow f JOIN comp USING (cell_id) JOIN least USING (component) WHERE f.flow >= least),
    source AS (SELECT cell_id FROM river WHERE cell_id NOT IN (SELECT t.target FROM tgt t JOIN river r ON r.cell_id = t.cell_id)),
    steps(start, ord, cell_id) AS (SELECT cell_id, 0, cell_id FROM source UNION ALL
      SELECT s.start, s.ord + 1, t.target FROM steps s JOIN tgt t ON t.cell_id = s.cell_id JOIN smooth h ON h.cell_id = s.cell_id WHERE h.height_m > 0),
    ended AS (SELECT s.start, s.ord FROM steps s JOIN smooth h ON h.cell_id = s.cell_id WHERE h.height_m <= 0),
    path AS (SELECT s.start, s.ord, s.cell_id FROM steps s JOIN ended e ON e.start = s.start AND s.ord < e.ord),
    mouth AS (SELECT start, arg_max(cell_id, ord) AS mouth, count(*) AS n FROM path GROUP BY start)"""


@query
def stencil8(spark, sf_dir):
    """Of the eight neighbours: how many there are, heights weighted by their order, the lowest."""
    return grid.around(run(spark, sf_dir, f"WITH {cells(SPARK)} SELECT cell_id, height_m FROM cells"), WIDTH)


@query
def flow_target(spark, sf_dir):
    """The lowest of the neighbours that are lower; ties go to the first in order."""
    return grid.flow_targets(land(spark, sf_dir, "true"), WIDTH)


@query
def smooth_flow_target(spark, sf_dir):
    return grid.flow_targets(smooth_cells(spark, sf_dir), WIDTH)


def blurred(spark, sf_dir, value: str, radius: int, wrap: bool, name: str) -> DataFrame:
    base = run(spark, sf_dir, f"WITH {cells(SPARK)} SELECT cell_id, x, y, CAST({value} AS DOUBLE) AS v FROM cells")
    return box_blur(base, WIDTH, radius, "v", wrap).select("cell_id", F.expr(SPARK.whole("v * 1E3")).alias(name))


@query
def box_blur_wrap(spark, sf_dir):
    """Means over 5 cells that wrap in x, then over at most 5 rows."""
    return blurred(spark, sf_dir, "height_m", 2, True, "blur_mm")


@query
def box_blur_clamp(spark, sf_dir):
    """Means over at most 7 cells, then over at most 7 rows."""
    return blurred(spark, sf_dir, "humidity_dp", 3, False, "blur_milli")


@query
def thermal_erosion(spark, sf_dir):
    """Three passes of slumping: what a slope has over the talus moves, 3 in 10, to the lowest neighbour; each pass adds a decimal place."""

    def slide(h, k):
        above, way = steepest(h)
        return settled(h * 10, np.where(above > 120 * 10**k, (above - 120 * 10**k) * 3, 0), way)

    base = run(spark, sf_dir, f"WITH {cells(SPARK)} SELECT cell_id, CAST(height_m AS BIGINT) AS height_mm FROM cells")
    return slump(base, WIDTH, "height_mm", 3, slide)


@query
def apportion(spark, sf_dir):
    """A fifth of all land cells as seats for the square territories, by their areas."""
    areas = sql(spark, sf_dir, f"WITH {cells(SPARK)} SELECT territory AS pos, count(*) AS area FROM cells WHERE territory IS NOT NULL GROUP BY territory")
    whole = areas.agg(F.sum("area")).first()[0] or 0
    return apportioned(areas, whole // 5).select("pos", "area", "seats")


def surfaces(spark, sf_dir) -> tuple[int, int, int]:
    """Land cells, water cells, and connected waters."""
    whole = land(spark, sf_dir, "is_water")
    n, wet = run(spark, sf_dir, f"WITH {cells(SPARK)} SELECT count(*) AS n FROM cells").first().n, whole.count()
    return n - wet, wet, grid.components(whole, WIDTH).select("component").distinct().count()


def surfaces_oracle(d: Dialect) -> str:
    return f"{cells(d)}, {closure('is_water')}, n AS (SELECT (SELECT count(*) FROM cells) - count(*) AS land, count(*) AS water, count(DISTINCT component) AS bodies FROM comp)"


AREAS, ASKED = (1, 8, 10, 40, 1000, 1000000), (0, 1, 300, 100000000)


def listed(values: tuple[int, ...], name: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(f'({v})' for v in values)}) AS t({name})) AS t"


@query
def water_count_from_area(spark, sf_dir):
    """How many water territories of about an area there are: one for each connected water at least, one a cell at most."""
    _, wet, bodies = surfaces(spark, sf_dir)
    return spark.sql(f"SELECT CAST(area AS BIGINT) AS area, CAST(greatest(least(({wet} + area div 2) div area, {wet}), {bodies}) AS BIGINT) AS territories FROM {listed(AREAS, 'area')}")


ORACLES["water_count_from_area"] = lambda d: f"""WITH RECURSIVE {surfaces_oracle(d)}
  SELECT CAST(area AS BIGINT) AS area, CAST(greatest(least((water + area // 2) // area, water), bodies) AS BIGINT) AS territories FROM {listed(AREAS, 'area')} CROSS JOIN n"""


@query
def validate_preconditions(spark, sf_dir):
    """Which numbers of land and water territories, and areas of them, can be asked for."""
    dry, wet, bodies = surfaces(spark, sf_dir)
    return spark.sql(f"SELECT CAST(want AS BIGINT) AS want, want BETWEEN 1 AND {dry} AS land_ok, want BETWEEN {bodies} AND {wet} AS water_ok, want >= 1 AS area_ok FROM {listed(ASKED, 'want')}")


ORACLES["validate_preconditions"] = lambda d: f"""WITH RECURSIVE {surfaces_oracle(d)}
  SELECT CAST(want AS BIGINT) AS want, want BETWEEN 1 AND land AS land_ok, want BETWEEN bodies AND water AS water_ok, want >= 1 AS area_ok FROM {listed(ASKED, 'want')} CROSS JOIN n"""


@query
def territory_union(spark, sf_dir):
    """Land territories first, then water ones, whose positions follow."""
    parts = [("false", f"{territories(SPARK)} SELECT pos, ax, ay, n FROM terr"), ("true", f"{water_bodies(SPARK)} SELECT pos, ax, ay, n FROM bodies")]
    out, before = None, 0
    for wet, text in parts:
        rows = sql(spark, sf_dir, f"WITH {cells(SPARK)}, {text}").withColumnRenamed("pos", "_pos")
        placed = ranked(rows, F.col("ay"), F.col("ax"), F.col("_pos"), name="pos").select((F.col("pos") + before).alias("pos"), F.expr(wet).alias("is_water"), "ax", "ay", "n")
        before = rows.count()
        out = placed if out is None else out.unionByName(placed)
    return out


ORACLES |= ORACLE_ONLY


@query
def flow_accumulation(spark, sf_dir):
    return flowing(spark, sf_dir)[2]


ORACLES["flow_accumulation"] = lambda d: f"WITH RECURSIVE {flow_oracle(d)} SELECT cell_id, flow FROM flow"


def rivers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    base, targets, flow = flowing(spark, sf_dir)
    member = thresholds(base.where("NOT is_water"))
    return base, targets, cut(flow.join(member, "cell_id").where("flow >= least").select("cell_id", "flow"))


def thresholds(surface: DataFrame) -> DataFrame:
    """(cell_id, least): the flow that makes a river, by the size of a cell's land component."""
    member = cut(grid.components(surface, WIDTH))
    return member.join(member.groupBy("component").agg(F.expr(f"greatest({SHARE} * count(*), {LEAST})").alias("least")), "component").select("cell_id", "least")


@query
def component_threshold(spark, sf_dir):
    """The river threshold of each land cell."""
    return thresholds(land(spark, sf_dir)).select("cell_id", F.expr(f"{SPARK.whole('least * 1E6')}").alias("threshold_micro"))


ORACLES["component_threshold"] = lambda d: f"""WITH RECURSIVE {cells(d)}, {closure('NOT is_water')}
  SELECT cell_id, {d.whole(f'greatest({SHARE} * count(*) OVER (PARTITION BY component), {LEAST}) * 1E6')} AS threshold_micro FROM comp"""


@query
def river_threshold(spark, sf_dir):
    """The river threshold of each land component by its size."""
    sizes = grid.components(land(spark, sf_dir), WIDTH).groupBy("component").agg(F.count("*").alias("land_cells"))
    return sizes.select("component", "land_cells", F.expr(SPARK.whole(f"greatest({SHARE} * land_cells, {LEAST}) * 1E6")).alias("threshold_micro"))


ORACLES["river_threshold"] = lambda d: f"""WITH RECURSIVE {cells(d)}, {closure('NOT is_water')}
  SELECT component, count(*) AS land_cells, {d.whole(f'greatest({SHARE} * count(*), {LEAST}) * 1E6')} AS threshold_micro FROM comp GROUP BY component"""


@query
def river_cells(spark, sf_dir):
    return rivers(spark, sf_dir)[2]


ORACLES["river_cells"] = lambda d: f"WITH RECURSIVE {flow_oracle(d)} SELECT cell_id, flow FROM river"


def sources(targets: DataFrame, river: DataFrame) -> DataFrame:
    fed = targets.join(river.select("cell_id"), "cell_id").select(F.col("target").alias("cell_id"))
    return river.select("cell_id").join(fed, "cell_id", "left_anti")


@query
def river_sources(spark, sf_dir):
    _, targets, river = rivers(spark, sf_dir)
    return sources(targets, river)


ORACLES["river_sources"] = lambda d: f"WITH RECURSIVE {flow_oracle(d)} SELECT cell_id FROM source"


def paths(spark, sf_dir) -> DataFrame:
    """(start, ord, cell_id) of land cells of rivers that reach water."""
    base, targets, river = rivers(spark, sf_dir)
    way = grid.walks(sources(targets, river), targets, WIDTH).join(base.select("cell_id", "is_water"), "cell_id")
    end = way.where("is_water").groupBy("start").agg(F.min("ord").alias("end"))
    return cut(way.join(end, "start").where("ord < end").select("start", "ord", "cell_id"))


@query
def river_paths(spark, sf_dir):
    return paths(spark, sf_dir).select("start", F.col("ord").cast("long").alias("ord"), "cell_id")


ORACLES["river_paths"] = lambda d: f"WITH RECURSIVE {flow_oracle(d)} SELECT start, CAST(ord AS BIGINT) AS ord, cell_id FROM path"


@query
def river_cell_set(spark, sf_dir):
    return paths(spark, sf_dir).select("cell_id").distinct()


ORACLES["river_cell_set"] = lambda d: f"WITH RECURSIVE {flow_oracle(d)} SELECT DISTINCT cell_id FROM path"


@query
def river_ids(spark, sf_dir):
    """Rivers with their mouths; rivers of one mouth take successive probes in the order of their sources."""
    m = paths(spark, sf_dir).groupBy("start").agg(F.max_by("cell_id", "ord").alias("mouth"), F.count("*").alias("n"))
    m = m.withColumn("probe", F.expr("row_number() OVER (PARTITION BY mouth ORDER BY start) - 1"))
    return m.select("start", "mouth", "n", F.expr(anchored_id(SPARK, 3, "mouth % 100", "mouth div 100", [], "probe")).alias("id"))


ORACLES["river_ids"] = lambda d: f"""WITH RECURSIVE {flow_oracle(d)}, p AS (SELECT *, row_number() OVER (PARTITION BY mouth ORDER BY start) - 1 AS probe FROM mouth)
  SELECT start, mouth, n, {anchored_id(d, 3, 'mouth % 100', 'mouth // 100', [], 'probe')} AS id FROM p"""

@query
def raster_rivers(spark, sf_dir):
    """River cells over land and water."""
    base = smooth_cells(spark, sf_dir).select("cell_id", "is_water")
    river = paths(spark, sf_dir).select("cell_id").distinct().withColumn("river", F.lit(True))
    return base.join(river, "cell_id", "left").selectExpr("cell_id", *river_colours("is_water", "river"))


def river_colours(water: str, river: str) -> list[str]:
    return [f"CASE WHEN {river} THEN {a} WHEN {water} THEN {b} ELSE {c} END AS {n}" for n, a, b, c in zip("rgb", RIVER_COLOR, RIVERS_WATER_COLOR, LAND_COLOR, strict=True)]


ORACLES["raster_rivers"] = lambda d: f"""WITH RECURSIVE {flow_oracle(d)}, p AS (SELECT DISTINCT cell_id FROM path)
  SELECT s.cell_id, {', '.join(river_colours('s.height_m <= 0', 'p.cell_id IS NOT NULL'))} FROM smooth s LEFT JOIN p ON p.cell_id = s.cell_id"""

# A recurrence along rows

HUMIDITY_OFFSET, EVAPORATION = 0.3, 0.18


def marched(spark, sf_dir) -> DataFrame:
    """(cell_id, humidity, rain): moisture carried along each row with its wind, over the cells."""
    base = land(spark, sf_dir, "true").select("cell_id", "height_m", (F.col("height_m") <= 0).alias("is_water"))
    rows = water_rows(spark, sf_dir) + 1

    return moisture_along_rows(base, WIDTH, rows, Air(EVAPORATION, HUMIDITY_OFFSET))


@query
def moisture_march(spark, sf_dir):
    """Moisture carried along each row, east or west by its latitude: the sea fills it, land takes rain by the rise of the ground."""
    return marched(spark, sf_dir).select("cell_id", F.expr(SPARK.whole("humidity * 1E6")).alias("humidity_micro"), F.expr(SPARK.whole("rain * 3E3")).alias("precipitation_mm"))


@query
def humidity_smoothed(spark, sf_dir):
    """The humidity of the march, averaged over 7 cells and 7 rows at most."""
    wet = cut(marched(spark, sf_dir)).selectExpr("cell_id", "cell_id % 100 AS x", "cell_id div 100 AS y", "humidity")
    return box_blur(wet, WIDTH, 3, "humidity", wrap=False).select("cell_id", F.expr(SPARK.whole("least(greatest(humidity, 0E0), 1E0) * 1E3")).alias("humidity_dp"))


def _march(d: Dialect) -> str:
    """RECURSIVE: humidity h and rain of the cells, k steps along their rows."""
    rain = "least(r.m * (2E-2 + 8E0 * greatest((c.height_m - coalesce(r.prev, c.height_m)) / 4E3, 0E0)), r.m)"
    lat = "(abs((y + 5E-1) / (SELECT max(y) + 1 FROM cells) - 5E-1) * 2)"
    return f"""{cells(d)}, way AS (SELECT *, CASE WHEN {lat} > 3E-1 AND {lat} < 7E-1 THEN x ELSE 99 - x END AS k FROM cells),
    r(k, y, cell_id, m, h, rain, prev) AS (SELECT -1::BIGINT, y, NULL::BIGINT, 0E0, 0E0, 0E0, NULL::BIGINT FROM cells WHERE x = 0 UNION ALL
      SELECT c.k, c.y, c.cell_id, CASE WHEN c.is_water THEN least(1E0, r.m + {EVAPORATION}) ELSE r.m - {rain} END, CASE WHEN c.is_water THEN 1E0 ELSE greatest(2E1 * {rain} + {HUMIDITY_OFFSET}, 0E0) END,
        CASE WHEN c.is_water THEN 0E0 ELSE {rain} END, c.height_m FROM r JOIN way c ON c.y = r.y AND c.k = r.k + 1),
    wet AS (SELECT cell_id, cell_id % 100 AS x, y, h, rain FROM r WHERE k >= 0)"""


ORACLES["moisture_march"] = lambda d: f"WITH RECURSIVE {_march(d)} SELECT cell_id, {d.whole('h * 1E6')} AS humidity_micro, {d.whole('rain * 3E3')} AS precipitation_mm FROM wet"
ORACLES["humidity_smoothed"] = lambda d: f"""WITH RECURSIVE {_march(d)}, flat AS (SELECT cell_id, x, y, avg(h) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM wet)
  SELECT cell_id, {d.whole('least(greatest(avg(v) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0E0), 1E0) * 1E3')} AS humidity_dp FROM flat"""

# Orders of all cells


def ordered(spark, sf_dir, columns: str, source: str = "cells", where: str = "true") -> DataFrame:
    return run(spark, sf_dir, f"WITH {cells(SPARK)}, {territories(SPARK)} SELECT {columns} FROM {source} WHERE {where}")


@query
def seed_selection(spark, sf_dir):
    """All land cells by weight, with their place in that order."""
    return ranked(ordered(spark, sf_dir, f"cell_id, {weight_of(SPARK)} AS weight", where="NOT is_water"), F.desc("weight"), F.col("cell_id"))


ORACLES["seed_selection"] = lambda d: f"""WITH {cells(d)}, w AS (SELECT cell_id, {weight_of(d)} AS weight FROM cells WHERE NOT is_water)
  SELECT cell_id, weight, CAST(row_number() OVER (ORDER BY weight DESC, cell_id) - 1 AS BIGINT) AS rank FROM w"""


@query
def height_order(spark, sf_dir):
    """All cells from the highest to the lowest, with their place."""
    return ranked(ordered(spark, sf_dir, "cell_id, height_m"), F.desc("height_m"), F.col("cell_id"))


ORACLES["height_order"] = lambda d: f"WITH {cells(d)} SELECT cell_id, height_m, CAST(row_number() OVER (ORDER BY height_m DESC, cell_id) - 1 AS BIGINT) AS rank FROM cells"


@query
def canonical_rank(spark, sf_dir):
    return ranked(ordered(spark, sf_dir, "pos, ax, ay", "terr"), F.col("ay"), F.col("ax"), F.col("pos")).select("pos", "rank")


ORACLES["canonical_rank"] = lambda d: f"WITH {cells(d)}, {territories(d)} SELECT pos, CAST(row_number() OVER (ORDER BY ay, ax, pos) - 1 AS BIGINT) AS rank FROM terr"

SAMPLE = 32


@query
def even_sample(spark, sf_dir):
    """32 of all land cells by weight, at even steps; all of them where there are just 32."""
    order = seed_selection(spark, sf_dir)
    return order.where(even_positions(F.lit(order.count()), F.lit(SAMPLE), F.col("rank"))).select("cell_id", "rank")


def _even(d: Dialect, ranks: str) -> str:
    step = d.div("n - 1", str(SAMPLE))
    return f"WITH {cells(d)}, r AS ({ranks}) SELECT cell_id, rank FROM r WHERE n = {SAMPLE} OR ({step} > 0 AND rank % greatest({step}, 1) = 0 AND {d.div('rank', f'greatest({step}, 1)')} < {SAMPLE})"


ORACLES["even_sample"] = lambda d: _even(d, f"SELECT cell_id, CAST(row_number() OVER (ORDER BY {weight_of(d)} DESC, cell_id) - 1 AS BIGINT) AS rank, count(*) OVER () AS n FROM cells WHERE NOT is_water")


def morton(d: Dialect) -> str:
    bit = lambda v, i: f"{d.shl(f'({d.shr(v, str(i))} & 1)', str(2 * i))}"
    xs, ys = (" + ".join(bit(f"CAST({v} AS BIGINT)", i) for i in range(16)) for v in "xy")
    return f"({xs}) + 2 * ({ys})"


@query
def z_order_sample(spark, sf_dir):
    """32 of all water cells at even steps along the Z-order curve."""
    order = ranked(ordered(spark, sf_dir, f"cell_id, {morton(SPARK)} AS z", where="is_water"), F.col("z"), F.col("cell_id"))
    return order.where(even_positions(F.lit(order.count()), F.lit(SAMPLE), F.col("rank"))).select("cell_id", "rank")


ORACLES["z_order_sample"] = lambda d: _even(d, f"SELECT cell_id, CAST(row_number() OVER (ORDER BY {morton(d)}, cell_id) - 1 AS BIGINT) AS rank, count(*) OVER () AS n FROM cells WHERE is_water")


@query
def nearest_centroid(spark, sf_dir):
    """The nearest of all territories' centroids to each land cell; ties go to the lower position."""
    surface = land(spark, sf_dir)
    return grid.nearest(surface, cut(ordered(spark, sf_dir, "pos, ax, ay", "terr")))


ORACLES["nearest_centroid"] = lambda d: f"""WITH {cells(d)}, {territories(d)} SELECT c.cell_id, {d.min_by('f.pos', '(c.x - f.ax) * (c.x - f.ax) + (c.y - f.ay) * (c.y - f.ay)', 'f.pos')} AS owner
  FROM cells c CROSS JOIN terr f WHERE NOT c.is_water GROUP BY c.cell_id"""
