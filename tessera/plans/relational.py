"""Queries over many rows: joins, aggregates, windows, searches and checks of the grid."""

from __future__ import annotations

from tessera.functions import biomes
from tessera.plans.scalar import LAND_COLOR, NO_TERRITORY_COLOR, SCORE, WATER_COLORS, categorical, temperature_of
from tessera.plans.sql import Dialect, Text, cells, smooth, stencil4, stencil8

QUERIES: dict[str, Text] = {}


def query(f: Text) -> Text:
    QUERIES[f.__name__] = f
    return f


def water_bodies(d: Dialect) -> str:
    """A table of water bodies by position: one for each column strip of 10 cells, kinds by size of its water."""
    return f"""bodies AS (SELECT {d.div('x', '10')} AS pos, count(*) AS n, CAST({d.div('sum(x)', 'count(*)')} AS BIGINT) AS ax, CAST({d.div('sum(y)', 'count(*)')} AS BIGINT) AS ay,
      CASE WHEN count(*) % 3 = 0 THEN 0 WHEN count(*) >= 200 THEN 1 ELSE 2 END AS kind FROM cells WHERE is_water GROUP BY {d.div('x', '10')}),
    wet AS (SELECT *, CASE WHEN is_water THEN {d.div('x', '10')} END AS water_body FROM cells)"""


def territories(d: Dialect) -> str:
    """Territories by position, with centroid, size and a region (a square of four by two territories)."""
    return f"""terr AS (SELECT territory AS pos, count(*) AS n, CAST({d.div('sum(x)', 'count(*)')} AS BIGINT) AS ax, CAST({d.div('sum(y)', 'count(*)')} AS BIGINT) AS ay,
      territory % 7 * 1000 + 17 AS region FROM cells WHERE territory IS NOT NULL GROUP BY territory),
    regions AS (SELECT region AS id, CAST(row_number() OVER (ORDER BY region) - 1 AS BIGINT) AS pos FROM (SELECT DISTINCT region FROM terr) AS r)"""


# Filters and joins


@query
def land_share(d):
    return f"WITH {cells(d)} SELECT count(*) AS cells, CAST(sum(CASE WHEN is_water THEN 0 ELSE 1 END) AS BIGINT) AS land, {d.whole('avg(CASE WHEN is_water THEN 0E0 ELSE 1E0 END) * 1E9')} AS share_nano FROM cells"


@query
def cell_water_kind(d):
    return f"WITH {cells(d)}, {water_bodies(d)} SELECT cell_id, b.kind FROM wet w JOIN bodies b ON b.pos = w.water_body"


@query
def cell_region(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT cell_id, t.region, r.pos AS region_pos FROM cells c JOIN terr t ON t.pos = c.territory JOIN regions r ON r.id = t.region"


@query
def region_position(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT t.pos AS territory, r.pos AS region_pos FROM terr t JOIN regions r ON r.id = t.region"


@query
def stencil_4(d):
    return f"WITH {cells(d)}, {stencil4(d)} SELECT s.cell_id, CAST(s.ord AS BIGINT) AS ord, s.nid, n.height_m FROM st4 s JOIN cells n ON n.cell_id = s.nid"


@query
def stencil_8(d):
    return f"""WITH {cells(d)}, {stencil8(d)} SELECT s.cell_id, count(*) AS neighbours, CAST(sum(n.height_m * (s.ord + 1)) AS BIGINT) AS weighted, min(n.height_m) AS lowest
      FROM st8 s JOIN cells n ON n.cell_id = s.nid GROUP BY s.cell_id"""


@query
def coastal(d):
    """Land cells beside water: any hit will do."""
    return f"""WITH {cells(d)}, {stencil4(d)} SELECT c.cell_id FROM cells c WHERE NOT c.is_water AND EXISTS
      (SELECT 1 FROM st4 s JOIN cells n ON n.cell_id = s.nid WHERE s.cell_id = c.cell_id AND n.is_water)"""


@query
def river_mouth_kind(d):
    """The first water body beside a mouth, W, E, N, S (here every land cell beside water is one); none only diagonally."""
    return f"""WITH {cells(d)}, {water_bodies(d)}, {stencil4(d)} SELECT s.cell_id, {d.min_by('b.kind', 's.ord')} AS kind
      FROM st4 s JOIN cells c ON c.cell_id = s.cell_id JOIN wet n ON n.cell_id = s.nid JOIN bodies b ON b.pos = n.water_body
      WHERE NOT c.is_water GROUP BY s.cell_id"""


def edges(d: Dialect) -> str:
    """Pairs of distinct neighbouring land territories, the half stencil to the right and down."""
    return f"""half AS (SELECT territory, y * 100 + (x + 1) % 100 AS nid FROM cells WHERE territory IS NOT NULL
      UNION ALL SELECT territory, (y + 1) * 100 + x FROM cells WHERE territory IS NOT NULL),
    edges AS (SELECT DISTINCT least(h.territory, n.territory) AS a, greatest(h.territory, n.territory) AS b FROM half h JOIN cells n ON n.cell_id = h.nid
      WHERE n.territory IS NOT NULL AND n.territory <> h.territory)"""


@query
def territory_edges(d):
    return f"WITH {cells(d)}, {edges(d)} SELECT a, b FROM edges"


@query
def biome_registry_join(d):
    return f"""WITH {cells(d)}, reg AS (SELECT * FROM (VALUES {biomes.registry_sql()}) AS r(id, name, category, r, g, b, deprecated))
      SELECT c.cell_id, c.cell_id % 19 AS biome, r.name, r.category FROM cells c LEFT JOIN reg r ON r.id = c.cell_id % 19"""


@query
def enrich_potential(d):
    return f"""WITH {cells(d)}, {territories(d)}, p AS (SELECT territory AS pos, {d.whole(f'{d.exact_mean(SCORE)} / 1E-3', 'INT')} AS natural_potential FROM cells WHERE territory IS NOT NULL GROUP BY territory)
      SELECT t.pos, t.n AS cell_count, coalesce(p.natural_potential, 0) AS natural_potential FROM terr t LEFT JOIN p ON p.pos = t.pos"""


# Aggregates


@query
def minmax_normalize(d):
    return f"""WITH {cells(d)}, m AS (SELECT min(height_m) AS lo, max(height_m) AS hi FROM cells)
      SELECT cell_id, {d.whole('CASE WHEN hi > lo THEN (height_m - lo) * 1E9 / (hi - lo) ELSE 0E0 END')} AS height_nano FROM cells CROSS JOIN m"""


@query
def centroids(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT pos, ax, ay FROM terr"


@query
def territory_cell_counts(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT pos, n FROM terr"


@query
def natural_potential(d):
    return f"""WITH {cells(d)} SELECT territory, count(*) AS land_cells, {d.whole(f'{d.exact_mean(SCORE)} / 1E-3', 'INT')} AS natural_potential
      FROM cells WHERE territory IS NOT NULL GROUP BY territory"""


@query
def territory_flags(d):
    return f"""WITH {cells(d)}, {stencil4(d)}, wetter AS (SELECT DISTINCT s.cell_id FROM st4 s JOIN cells n ON n.cell_id = s.nid WHERE n.is_water)
      SELECT c.territory, bool_or(w.cell_id IS NOT NULL) AS is_coastal, bool_or(c.height_m > 2500) AS is_mountainous, bool_or(c.y = 0 OR c.y = p.last) AS touches_pole
      FROM cells c LEFT JOIN wetter w ON w.cell_id = c.cell_id CROSS JOIN (SELECT max(y) AS last FROM cells) AS p WHERE c.territory IS NOT NULL GROUP BY c.territory"""


@query
def territory_mouths(d):
    """Mouths by territory in order (every land cell beside an ocean or a sea)."""
    text = "CAST(m.cell_id AS STRING)" if d.spark else "CAST(m.cell_id AS VARCHAR)"
    return f"""WITH {cells(d)}, {water_bodies(d)}, {stencil4(d)}, m AS (
      SELECT s.cell_id, {d.min_by('b.kind', 's.ord')} AS kind FROM st4 s JOIN cells c ON c.cell_id = s.cell_id JOIN wet n ON n.cell_id = s.nid JOIN bodies b ON b.pos = n.water_body
      WHERE NOT c.is_water GROUP BY s.cell_id)
      SELECT c.territory, {d.joined(text, 'm.cell_id')} AS mouths, count(*) AS n FROM m JOIN cells c ON c.cell_id = m.cell_id WHERE m.kind IN (0, 1) GROUP BY c.territory"""


@query
def region_anchor(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT region, {d.min_by('ax', 'ay', 'ax')} AS anchor_x, min(ay) AS anchor_y FROM terr GROUP BY region"


@query
def world_summary(d):
    return f"""WITH {cells(d)}, {territories(d)}, {water_bodies(d)} SELECT 'cells' AS what, count(*) AS n FROM cells UNION ALL SELECT 'land', count(*) FROM cells WHERE NOT is_water
      UNION ALL SELECT 'territories', count(*) FROM terr UNION ALL SELECT 'regions', count(*) FROM regions UNION ALL SELECT 'water_bodies', count(*) FROM bodies"""


@query
def size_spread(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT {d.whole('stddev_pop(n) / avg(n) * 1E6')} AS spread_micro FROM terr"


@query
def highland_share(d):
    share = lambda h: d.whole(f"avg(CASE WHEN height_m > {h} THEN 1E0 ELSE 0E0 END) * 1E9")
    return f"WITH {cells(d)} SELECT {share(1500)} AS over_1500_nano, {share(2500)} AS over_2500_nano FROM cells WHERE NOT is_water"


@query
def band_mean_temperature(d):
    return f"WITH {cells(d)} SELECT {d.div('y', '10')} AS band, count(*) AS n, {d.whole('avg(temperature_dc) * 1E6')} AS mean_micro FROM cells GROUP BY {d.div('y', '10')}"


@query
def coastline_ratio(d):
    return f"""WITH {cells(d)}, half AS (SELECT is_water, y * 100 + (x + 1) % 100 AS nid FROM cells UNION ALL SELECT is_water, (y + 1) * 100 + x FROM cells)
      SELECT count(*) AS coast, {d.whole('count(*) * 1E6 / (SELECT count(*) FROM cells WHERE NOT is_water)')} AS ratio_micro FROM half h JOIN cells n ON n.cell_id = h.nid WHERE n.is_water <> h.is_water"""


# Windows


@query
def box_blur_wrap(d):
    """Means over 5 cells that wrap in x, then over at most 5 rows."""
    return f"""WITH {cells(d)}, pad AS (SELECT x, y, height_m FROM cells UNION ALL SELECT x + 100, y, height_m FROM cells WHERE x < 2 UNION ALL SELECT x - 100, y, height_m FROM cells WHERE x >= 98),
    h AS (SELECT x, y, sum(height_m) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5E0 AS v FROM pad)
    SELECT y * 100 + x AS cell_id, {d.whole('avg(v) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) * 1E3')} AS blur_mm FROM h WHERE x BETWEEN 0 AND 99"""


@query
def box_blur_clamp(d):
    frame = "ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING"
    return f"""WITH {cells(d)}, h AS (SELECT x, y, avg(CAST(humidity_dp AS DOUBLE)) OVER (PARTITION BY y ORDER BY x {frame}) AS v FROM cells)
    SELECT y * 100 + x AS cell_id, {d.whole(f'avg(v) OVER (PARTITION BY x ORDER BY y {frame}) * 1E3')} AS blur_milli FROM h"""


@query
def windward_rise(d):
    return f"WITH {cells(d)} SELECT cell_id, greatest(height_m - lag(height_m) OVER (PARTITION BY y ORDER BY x), 0) AS rise_m FROM cells"


# Sorts and searches


@query
def land_ratio_search(d):
    """Offsets to heights that give the wished land share: 100 coarse, then 41 fine ones if that misses.

    Heights are whole steps of 1/12000, so a count over a threshold comes from one running sum of a histogram.
    """
    return f"""WITH {cells(d)}, total AS (SELECT count(*) AS n FROM cells),
    hist AS (SELECT height_m + 6000 AS k, count(*) AS c FROM cells GROUP BY height_m + 6000),
    coarse AS (SELECT i, i * 120 AS off FROM (SELECT {d.explode(d.numbers('-50', '49'))} AS i) AS s),
    shares AS (SELECT o.i, o.off, sum(CASE WHEN h.k > 6000 - o.off THEN h.c ELSE 0 END) * 1E0 / max(t.n) AS share FROM coarse o CROSS JOIN hist h CROSS JOIN total t GROUP BY o.i, o.off),
    best AS (SELECT {d.min_by('off', 'abs(share - 3E-1)', 'i')} AS off, min(abs(share - 3E-1)) AS miss FROM shares),
    fine AS (SELECT i, best.off + i * 6 AS off, best.miss AS miss FROM (SELECT {d.explode(d.numbers('-20', '20'))} AS i) AS s CROSS JOIN best),
    shares2 AS (SELECT o.i, o.off, max(o.miss) AS miss, sum(CASE WHEN h.k > 6000 - o.off THEN h.c ELSE 0 END) * 1E0 / max(t.n) AS share FROM fine o CROSS JOIN hist h CROSS JOIN total t GROUP BY o.i, o.off),
    best2 AS (SELECT {d.min_by('off', 'abs(share - 3E-1)', 'i')} AS off FROM shares2)
    SELECT CAST(CASE WHEN b.miss > 1.5E-2 THEN f.off ELSE b.off END AS BIGINT) AS offset_steps FROM best b CROSS JOIN best2 f"""


@query
def flow_target(d):
    """The lowest of the neighbours that are lower; ties go to the first in order."""
    return f"""WITH {cells(d)}, {stencil8(d)} SELECT s.cell_id, {d.min_by('s.nid', 'n.height_m', 's.ord')} AS target
      FROM st8 s JOIN cells c ON c.cell_id = s.cell_id JOIN cells n ON n.cell_id = s.nid WHERE n.height_m < c.height_m GROUP BY s.cell_id"""


def flow_sql(d: Dialect) -> str:
    return f"""smooth8 AS (SELECT s.cell_id, s.nid, s.ord FROM (SELECT c.cell_id, o.ord, (c.y + o.dy) * 100 + {d.mod('c.x + o.dx', '100')} AS nid, c.y + o.dy AS ny FROM smooth c
        CROSS JOIN (SELECT * FROM (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)) AS t(ord, dy, dx)) o) AS s WHERE s.ny >= 0),
    target AS (SELECT s.cell_id, {d.min_by('s.nid', 'n.height_m', 's.ord')} AS target FROM smooth8 s JOIN smooth c ON c.cell_id = s.cell_id JOIN smooth n ON n.cell_id = s.nid
      WHERE n.height_m < c.height_m GROUP BY s.cell_id)"""


@query
def smooth_flow_target(d):
    return f"WITH {cells(d)}, {smooth(d)}, {flow_sql(d)} SELECT cell_id, target FROM target"


@query
def lloyd_reseed(d):
    """The member next to the seam-aware mean of each territory, ties to the lower cell."""
    dx = lambda a, b: f"({d.mod(f'{a} - {b} + 50', '100')} - 50)"
    return f"""WITH {cells(d)}, first AS (SELECT territory, min(cell_id) AS f FROM cells WHERE territory IS NOT NULL GROUP BY territory),
    rel AS (SELECT c.territory, c.cell_id, c.y, {dx('c.x', 'f.f % 100')} AS rx, f.f % 100 AS fx FROM cells c JOIN first f ON f.territory = c.territory),
    mean AS (SELECT territory, {d.div('CAST(sum(rx) AS BIGINT)', 'count(*)')} AS mx, {d.div('CAST(sum(y) AS BIGINT)', 'count(*)')} AS my FROM rel GROUP BY territory)
    SELECT r.territory, {d.min_by('r.cell_id', '(r.rx - m.mx) * (r.rx - m.mx) + (r.y - m.my) * (r.y - m.my)', 'r.cell_id')} AS seed FROM rel r JOIN mean m ON m.territory = r.territory GROUP BY r.territory"""


@query
def apportion(d):
    """Seats for areas: floors of at least one, then what is missing goes to the largest remainder up to its area,
    and what is too much comes from the smallest remainder down to one."""
    return f"""WITH {cells(d)}, a AS (SELECT territory AS pos, count(*) AS area FROM cells WHERE territory IS NOT NULL GROUP BY territory),
    s AS (SELECT sum(area) AS total, {d.div('CAST(sum(area) AS BIGINT)', '5')} AS seats FROM a),
    q AS (SELECT pos, area, greatest({d.div('CAST(area * seats AS BIGINT)', 'CAST(total AS BIGINT)')}, 1) AS quota, (area * seats) % total AS rest, seats FROM a CROSS JOIN s),
    b AS (SELECT *, seats - sum(quota) OVER () AS missing,
      coalesce(sum(area - quota) OVER (ORDER BY rest DESC, area DESC, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS up,
      coalesce(sum(quota - 1) OVER (ORDER BY rest, area, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down FROM q)
    SELECT pos, area, CAST(quota + greatest(0, least(area - quota, missing - up)) - greatest(0, least(quota - 1, -missing - down)) AS BIGINT) AS seats FROM b"""


@query
def top_components(d):
    return f"WITH {cells(d)}, {territories(d)} SELECT pos, n FROM terr ORDER BY n DESC, pos LIMIT 12"


# Checks: each lists what breaks its rule, over tables with some broken rows


def broken(d: Dialect) -> str:
    """Territories and cells with faults put in by row number."""
    return f"""{territories(d)}, ents AS (SELECT pos, CASE WHEN pos % 11 = 3 THEN 0 WHEN pos % 11 = 4 THEN 4242 ELSE pos + 1000 END AS id, CASE WHEN pos % 13 = 5 THEN ax + 100 ELSE ax END AS ax, ay,
      n, CASE WHEN pos % 17 = 2 THEN n + 1 ELSE n END AS declared, CASE WHEN pos % 19 = 7 THEN 999 ELSE region END AS region FROM terr),
    bad AS (SELECT cell_id, is_water, CASE WHEN cell_id % 503 = 11 THEN 100000 ELSE territory END AS territory, CASE WHEN cell_id % 701 = 5 THEN 3 WHEN is_water THEN {d.div('x', '10')} END AS water_body FROM cells)"""


@query
def validate_cell_count(d):
    return f"WITH {cells(d)} SELECT count(*) AS declared, 100 * (max(y) + 1) AS expected, count(*) = 100 * (max(y) + 1) AS ok FROM cells"


@query
def validate_duplicate_ids(d):
    return f"WITH {cells(d)}, {broken(d)} SELECT CAST(id AS BIGINT) AS id, count(*) AS n FROM ents GROUP BY id HAVING count(*) > 1 OR id = 0"


@query
def validate_bounds(d):
    return f"WITH {cells(d)}, {broken(d)} SELECT pos, ax, ay FROM ents WHERE ax < 0 OR ax >= 100 OR ay < 0 OR ay >= (SELECT {d.div('count(*)', '100')} FROM cells)"


@query
def validate_region_fk(d):
    return f"WITH {cells(d)}, {broken(d)} SELECT pos, region FROM ents e WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.id = e.region)"


@query
def validate_cell_fk(d):
    return f"WITH {cells(d)}, {broken(d)} SELECT cell_id, territory FROM bad b WHERE territory IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ents e WHERE e.pos = b.territory)"


@query
def validate_land_water(d):
    return f"WITH {cells(d)}, {broken(d)} SELECT cell_id FROM bad WHERE NOT is_water AND water_body IS NOT NULL"


@query
def validate_member_count(d):
    return f"""WITH {cells(d)}, {broken(d)}, actual AS (SELECT territory AS pos, count(*) AS actual FROM bad WHERE territory IS NOT NULL GROUP BY territory)
      SELECT coalesce(e.pos, a.pos) AS pos, coalesce(e.declared, 0) AS declared, coalesce(a.actual, 0) AS actual FROM ents e FULL OUTER JOIN actual a ON a.pos = e.pos
      WHERE coalesce(e.declared, 0) <> coalesce(a.actual, 0)"""


@query
def validate_paths(d):
    """Rivers are orders' line items here: those without a path, or with a cell beyond the grid."""
    return f"""WITH {cells(d)}, rivers AS (SELECT o_orderkey AS pos FROM {d.table('orders')}),
    steps AS (SELECT l_orderkey AS pos, l_partkey * 9 AS cell FROM {d.table('lineitem')} WHERE l_orderkey % 70 <> 0)
    SELECT r.pos, count(s.pos) AS length, CAST(coalesce(sum(CASE WHEN s.cell >= (SELECT count(*) FROM cells) THEN 1 ELSE 0 END), 0) AS BIGINT) AS outside
      FROM rivers r LEFT JOIN steps s ON s.pos = r.pos GROUP BY r.pos HAVING count(s.pos) = 0 OR sum(CASE WHEN s.cell >= (SELECT count(*) FROM cells) THEN 1 ELSE 0 END) > 0"""


@query
def validate_sections(d):
    return f"""WITH {cells(d)}, s AS (SELECT 'temperature' AS section, count(temperature_dc) AS n FROM cells UNION ALL SELECT 'humidity', count(CASE WHEN humidity_dp < 900 THEN humidity_dp END) FROM cells
      UNION ALL SELECT 'territory', count(territory) FROM cells) SELECT section, n, n = (SELECT count(*) FROM cells) OR n = 0 AS ok FROM s"""


@query
def territory_union(d):
    """Land territories first, then water ones, whose positions follow."""
    return f"""WITH {cells(d)}, {territories(d)}, {water_bodies(d)}, land AS (SELECT row_number() OVER (ORDER BY ay, ax, pos) - 1 AS pos, ax, ay, n FROM terr),
      water AS (SELECT row_number() OVER (ORDER BY ay, ax, pos) - 1 AS pos, ax, ay, n FROM bodies)
      SELECT CAST(pos AS BIGINT) AS pos, false AS is_water, ax, ay, n FROM land UNION ALL SELECT CAST(pos + (SELECT count(*) FROM land) AS BIGINT), true, ax, ay, n FROM water"""


@query
def raster_layers(d):
    """Water, potential and territory layers of each cell, as numbers 0xRRGGBB."""
    rgb = lambda c: c[0] * 65536 + c[1] * 256 + c[2]
    return f"""WITH {cells(d)}, {water_bodies(d)} SELECT w.cell_id, CAST(CASE WHEN NOT w.is_water THEN {rgb(LAND_COLOR)} WHEN b.kind = 0 THEN {rgb(WATER_COLORS['ocean'])} WHEN b.kind = 1 THEN {rgb(WATER_COLORS['sea'])} ELSE {rgb(WATER_COLORS['lake'])} END AS BIGINT) AS water
      FROM wet w LEFT JOIN bodies b ON b.pos = w.water_body"""


@query
def polar_temperature_check(d):
    """Means of the formula's temperatures at the poles and in the middle."""
    return f"""WITH {cells(d)}, t AS (SELECT y, {temperature_of(d)} AS t FROM cells), h AS (SELECT max(y) + 1 AS h FROM cells)
      SELECT {d.whole('avg(CASE WHEN y * 10 < h THEN t END) * 1E3')} AS north_milli, {d.whole('avg(CASE WHEN y * 10 BETWEEN 4 * h AND 6 * h THEN t END) * 1E3')} AS middle_milli FROM t CROSS JOIN h"""


@query
def thermal_erosion(d):
    """Three passes of slumping: what a slope has over the talus moves, 3 in 10, to the lowest neighbour (E, S, W, N).

    Each pass adds a decimal place, so heights stay whole numbers: of meters, then of tenths and so on.
    """
    text = f"off AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 0, -1), (3, -1, 0)) AS t(ord, dy, dx)), h0 AS (SELECT cell_id, x, y, CAST(height_m AS BIGINT) AS h FROM cells)"
    for k in range(3):
        text += f""", st{k} AS (SELECT c.cell_id, c.h, o.ord, (c.y + o.dy) * 100 + {d.mod('c.x + o.dx', '100')} AS nid FROM h{k} c CROSS JOIN off o WHERE c.y + o.dy >= 0),
    low{k} AS (SELECT s.cell_id, min(n.h) AS lowest, {d.min_by('s.nid', 'n.h', 's.ord')} AS nid, max(s.h) AS h FROM st{k} s JOIN h{k} n ON n.cell_id = s.nid GROUP BY s.cell_id),
    moves{k} AS (SELECT cell_id, nid, (h - lowest - {120 * 10**k}) * 3 AS moved FROM low{k} WHERE h - lowest > {120 * 10**k}),
    flux{k} AS (SELECT cell_id, -moved AS moved FROM moves{k} UNION ALL SELECT nid, moved FROM moves{k}),
    net{k} AS (SELECT cell_id, CAST(sum(moved) AS BIGINT) AS moved FROM flux{k} GROUP BY cell_id),
    h{k + 1} AS (SELECT c.cell_id, c.x, c.y, c.h * 10 + coalesce(n.moved, 0) AS h FROM h{k} c LEFT JOIN net{k} n ON n.cell_id = c.cell_id)"""
    return f"WITH {cells(d)}, {text} SELECT cell_id, h AS height_mm FROM h3"


@query
def raster_regions(d):
    """Cells by the position of their territory's region, others in the colour of none."""
    none = ", ".join(f"coalesce(c.{n}, {v}) AS {n}" for n, v in zip("rgb", NO_TERRITORY_COLOR, strict=True))
    return f"""WITH {cells(d)}, {territories(d)}, c AS (SELECT t.pos AS territory, {categorical('r.pos')} FROM terr t JOIN regions r ON r.id = t.region)
      SELECT cells.cell_id, {none} FROM cells LEFT JOIN c ON c.territory = cells.territory"""


#: Texts of the oracle only: Spark runs these over bands of rows (graphs.py).
ORACLE_ONLY = {name: QUERIES.pop(name) for name in ("thermal_erosion", "flow_target", "smooth_flow_target", "box_blur_wrap", "box_blur_clamp", "apportion", "territory_union", "stencil_8")}

#: The names under which the survey lists the two stencils.
QUERIES["stencil4"] = QUERIES.pop("stencil_4")
ORACLE_ONLY["stencil8"] = ORACLE_ONLY.pop("stencil_8")
