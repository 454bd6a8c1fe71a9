"""Queries over single rows: scans, lattices, identity, bits, formulas of a cell."""

from __future__ import annotations

from tessera.functions import biomes
from tessera.plans.sql import Dialect, Text, cells

QUERIES: dict[str, Text] = {}


def query(f: Text) -> Text:
    QUERIES[f.__name__] = f
    return f


def over_cells(d: Dialect, columns: str, where: str = "") -> str:
    return f"WITH {cells(d)} SELECT cell_id, {columns} FROM cells {where}"


# Scans


@query
def grid_scan(d):
    return over_cells(d, "x, y, CAST(0 AS BIGINT) AS height_m, false AS is_water")


@query
def content_hash(d):
    digits = " + ".join(f"CAST(ascii(substr(c_name, length(c_name) - {7 - i}, 1)) AS DECIMAL(20, 0)) * {256**i}" for i in range(8))
    return f"SELECT c_custkey, CAST({digits} AS DECIMAL(38, 0)) AS stored_hash FROM {d.table('customer')} WHERE length(c_name) >= 8"


# Lattices


@query
def quantize_half_even(d):
    v = "(o_orderkey % 4001 - 2000)"
    return f"""SELECT o_orderkey, {d.whole(f'{v} / 2E0', 'INT')} AS height_m, {d.whole(f'{v} / 4E1 / 1E-1', 'INT')} AS temperature_dc,
      {d.whole(f'abs({v}) / 2E1 / 1E-1', 'INT')} AS humidity_dp, {d.whole(f'abs({v}) * 5E-1', 'INT')} AS precip_mm,
      {d.whole(f'abs({v}) / 2E3 / 1E-3', 'INT')} AS potential, {d.whole(f'{v} / 4E2 / 1E-2', 'INT')} AS centi
      FROM {d.table('orders')}"""


@query
def dequantize(d):
    return over_cells(d, "height_m * 1E0 AS height, temperature_dc * 1E-1 AS temperature, humidity_dp * 1E-1 AS humidity")


@query
def cell_xy_roundtrip(d):
    return over_cells(d, f"x, y, y * 100 + x AS again, y * 100 + x = cell_id AND cell_id % 100 = x AND {d.div('cell_id', '100')} = y AS same")


@query
def id_hex_display(d):
    return over_cells(d, ", ".join(f"concat('{k}:', lower(hex(cell_id * 2654435761 + {n}))) AS {n_}" for n, (k, n_) in enumerate(zip("ctrwvb", ("cell", "territory", "region", "water_body", "river", "biome"), strict=True))))


@query
def z_order(d):
    bit = lambda v, i: f"{d.shl(f'({d.shr(v, str(i))} & 1)', str(2 * i))}"
    xs, ys = (" + ".join(bit(f"CAST({v} AS BIGINT)", i) for i in range(16)) for v in "xy")
    return over_cells(d, f"CAST(({xs}) + 2 * ({ys}) AS BIGINT) AS morton")


@query
def seam_offset(d):
    dx = "(x - (cell_id * 37) % 100)"
    return over_cells(d, f"{d.mod(f'{dx} + 50', '100')} - 50 AS dx")


@query
def byte_offset(d):
    return over_cells(d, "(cell_id % 256) % 7 - 3 AS offset3, (cell_id % 256) % 9 - 4 AS offset4")


@query
def enum_codes(d):
    k = "(o_orderkey % 5)"
    return f"""SELECT o_orderkey, CASE {k} WHEN 0 THEN 'Four' WHEN 1 THEN 'Eight' END AS connectivity,
      CASE {k} WHEN 0 THEN 'Ocean' WHEN 1 THEN 'Sea' WHEN 2 THEN 'Lake' END AS water_body FROM {d.table('orders')}"""


@query
def octave_budget(d):
    wave, least, most = "(CAST(p_size AS DOUBLE) * p_partkey)", "(p_partkey % 17)", "(p_partkey % 8 + 1)"
    return f"""SELECT p_partkey, CAST(CASE WHEN {wave} <= 0 OR {least} <= 0 THEN {most}
      ELSE greatest(1, least({most}, CAST(floor(1 + log2({wave} / {least})) AS INT))) END AS INT) AS octaves FROM {d.table('part')}"""


@query
def fnv1a64(d):
    """FNV-1a of names: xor of the low byte, product modulo 2^64."""
    n = "CAST(s_suppkey AS STRING)" if d.spark else "CAST(s_suppkey AS VARCHAR)"
    if d.spark:
        byte = f"ascii(substr({n}, i, 1))"
        low = "CAST(a % 256 AS INT)"
        step = f"CAST(((a - {low} + ({low} ^ {byte})) * CAST(1099511628211 AS DECIMAL(13, 0))) % CAST(18446744073709551616 AS DECIMAL(20, 0)) AS DECIMAL(20, 0))"
        hashed = f"aggregate(sequence(1, length({n})), CAST(14695981039346656037 AS DECIMAL(20, 0)), (a, i) -> {step})"
    else:
        step = f"((a - a % 256 + xor(CAST(a % 256 AS INT), CAST(ascii(substr({n}, CAST(i AS BIGINT), 1)) AS INT))) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
        hashed = f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length({n}) + 1), lambda k: k::HUGEINT)), lambda a, i: {step})"
    return f"SELECT s_suppkey, CAST({hashed} AS DECIMAL(20, 0)) AS hash FROM {d.table('supplier')}"


# Noise helpers


@query
def cylinder_coords(d):
    turn, radius = "(x + 5E-1) / 100 * 2E0 * pi()", "(100 / (2E0 * pi()))"
    return over_cells(d, ", ".join(f"{d.whole(f'{radius} * {f}({turn}) * 1E6')} AS {n}" for f, n in (("cos", "cx_micro"), ("sin", "cz_micro"))) + ", y AS cy")


@query
def ridge_mask(d):
    t = "greatest(0E0, least(1E0, ((height_m + 6000) / 1.2E4 - 4E-1) / 2.5E-1))"
    return over_cells(d, f"{d.whole(f'({t}) * ({t}) * (3 - 2 * ({t})) * 1E6')} AS mask_micro")


# Formulas of a cell


H01 = "((height_m + 6000) / 1.2E4)"


@query
def island_lift(d):
    n = "((humidity_dp + 1E0) / 2E0 / 5.01E2)"
    return over_cells(d, f"{d.whole(f'({H01} + {n} * 5E-1 * greatest(5E-1 - {H01}, 0E0)) * 1E6')} AS height_micro")


@query
def power_clamp(d):
    return over_cells(d, f"{d.whole(f'pow(least(greatest({H01} * 1.5E0 - 2E-1, 0E0), 1E0), 1E0) * 1E6')} AS height_micro")


@query
def hypsometry(d):
    """Land above the middle is raised by a power; 3 is a whole exponent, so all engines agree."""
    linear = f"(({H01} - 5E-1) * 1.2E4)"
    a = f"(2 * ({H01} - 5E-1))"
    raised = f"greatest(1, {d.whole(f'{a} * {a} * {a} * 6E3')})"
    value = f"CASE WHEN {linear} > 0 THEN {raised} ELSE {d.whole(linear)} END"
    return over_cells(d, f"CAST({value} AS BIGINT) AS hypso_m, ({value}) <= 0 AS under_water")


def latitude(d: Dialect) -> str:
    return f"(abs((y + 5E-1) / (SELECT {d.div('count(*)', '100')} FROM {d.table('orders')}) - 5E-1) * 2)"


@query
def latitude_factor(d):
    return over_cells(d, f"{d.whole(latitude(d) + ' * 1E9')} AS latitude_nano")


@query
def wind_direction(d):
    return over_cells(d, f"CASE WHEN {latitude(d)} > 3E-1 AND {latitude(d)} < 7E-1 THEN 1 ELSE -1 END AS wind")


@query
def evaporation(d):
    return over_cells(d, f"{d.whole('greatest(1.5E-1 + 1E-1 * (humidity_dp / 5E2 - 1), 5E-2) * 1E6')} AS evaporation_micro")


def temperature_of(d: Dialect, offset: str = "0E0", amplification: str = "1E0") -> str:
    lat = latitude(d)
    return f"""least(6E1, greatest(-9E1, 2.7E1 - 5.2E1 * {lat} + {offset} * (1 + {lat} * {amplification})
      - CASE WHEN is_water THEN 5E0 * least(abs(height_m) / 1E3, 1E0) ELSE 6.5E0 * height_m / 1E3 END))"""


@query
def temperature(d):
    return over_cells(d, f"{d.whole(temperature_of(d, '1.5E0') + ' / 1E-1', 'INT')} AS temperature_dc")


@query
def biome_dither(d):
    n = "((cell_id % 201) / 1E2 - 1)"
    return over_cells(d, f"{d.whole(f'{n} * 2 / 1E-1', 'INT')} AS dt_dc, {d.whole(f'{n} * 5 / 1E-1', 'INT')} AS dh_dp")


def dithered(d: Dialect) -> str:
    """Cells with values moved against the dither, which is added to the rules' bounds."""
    n = "((cell_id % 201) / 1E2 - 1)"
    return f"dith AS (SELECT *, temperature_dc - {d.whole(f'{n} * 2 / 1E-1')} AS t, humidity_dp - {d.whole(f'{n} * 5 / 1E-1')} AS h FROM cells)"


@query
def biome_classify(d):
    return f"WITH {cells(d)}, {dithered(d)} SELECT cell_id, CAST({biomes.case_sql('is_water', 'height_m', 'temperature_dc', 't', 'h')} AS INT) AS biome FROM dith"


@query
def biome_classify_join(d):
    """The same by a table of rules: the first rule whose bounds hold."""
    return f"""WITH {cells(d)}, {dithered(d)}, rules AS (SELECT * FROM (VALUES {biomes.rules_sql()}) AS r(ord, tier, height_over, t_below, h_below, biome)),
    tiered AS (SELECT *, CASE WHEN height_m <= 0 THEN 0 WHEN height_m > 2500 THEN 1 ELSE 2 END AS tier FROM dith)
    SELECT c.cell_id, CAST({d.min_by('r.biome', 'r.ord')} AS INT) AS biome FROM tiered c JOIN rules r ON r.tier = c.tier
      AND (CASE WHEN c.tier = 0 THEN -c.height_m ELSE c.height_m END) > r.height_over
      AND (CASE WHEN c.tier = 2 THEN c.t ELSE c.temperature_dc END) < r.t_below AND c.h < r.h_below
    GROUP BY c.cell_id"""


def clamp(v: str) -> str:
    return f"least(greatest({v}, 0E0), 1E0)"


def weight_of(d: Dialect) -> str:
    return d.whole(f"{clamp('(temperature_dc / 1E1 + 25) / 5.2E1')} * {clamp('humidity_dp / 1E1 / 1E2')} * {clamp('1E0 - abs(height_m) / 6E3')} / 1E-3")


COMFORT = """(CASE WHEN temperature_dc / 1E1 <= -5 OR temperature_dc / 1E1 >= 45 THEN 0E0 WHEN temperature_dc / 1E1 < 10 THEN (temperature_dc / 1E1 + 5) / 1.5E1
  WHEN temperature_dc / 1E1 <= 25 THEN 1E0 ELSE (45 - temperature_dc / 1E1) / 2E1 END)"""
MOISTURE, LOWLAND = clamp("humidity_dp / 1E1 / 7E1"), clamp("1E0 - abs(height_m) / 3E3")
SCORE = f"({COMFORT} * {MOISTURE} * {LOWLAND})"


@query
def seed_weight(d):
    return over_cells(d, f"{weight_of(d)} AS weight", "WHERE NOT is_water")


@query
def temp_comfort(d):
    return over_cells(d, f"{d.whole(f'{COMFORT} * 1E9')} AS comfort_nano")


@query
def moisture_factor(d):
    return over_cells(d, f"{d.whole(f'{MOISTURE} * 1E9')} AS moisture_nano")


@query
def lowland_factor(d):
    return over_cells(d, f"{d.whole(f'{LOWLAND} * 1E9')} AS lowland_nano")


@query
def cell_score(d):
    return over_cells(d, f"{d.whole(f'{SCORE} * 1E9')} AS score_nano")


# Rendering


def gradient(value: str, stops: list[tuple[float, tuple[int, int, int]]]) -> str:
    """Three channels of a piecewise linear scale, constant beyond its ends."""
    out = []
    for k, name in enumerate("rgb"):
        arms = [f"WHEN {value} <= {stops[0][0]!r}E0 THEN {stops[0][1][k]}"]
        for (lo, a), (hi, b) in zip(stops, stops[1:], strict=False):
            arms.append(f"WHEN {value} < {hi!r}E0 THEN round({a[k]}E0 + ({b[k]}E0 - {a[k]}E0) * (({value} - {lo!r}E0) / ({hi!r}E0 - {lo!r}E0)))")
        out.append(f"CAST(CASE {' '.join(arms)} ELSE {stops[-1][1][k]} END AS INT) AS {name}")
    return ", ".join(out)


#: The colour scales.
TEMPERATURE_STOPS = [(-90.0, (49, 54, 149)), (0.0, (247, 247, 247)), (60.0, (165, 15, 21))]
HUMIDITY_STOPS = [(0.0, (84, 48, 5)), (50.0, (245, 245, 245)), (100.0, (0, 136, 55))]
PRECIPITATION_STOPS = [(0.0, (255, 255, 217)), (1500.0, (65, 182, 196)), (3000.0, (8, 29, 88))]
POTENTIAL_STOPS = [(0.0, (150, 120, 70)), (1000.0, (70, 150, 70))]
WATER_COLORS = {"ocean": (52, 110, 190), "sea": (80, 140, 205), "lake": (120, 175, 225)}
RIVER_COLOR, RIVERS_WATER_COLOR, LAND_COLOR, NO_TERRITORY_COLOR = (70, 130, 180), (205, 220, 240), (238, 238, 238), (60, 60, 60)


@query
def gradient_temperature(d):
    return over_cells(d, gradient("(temperature_dc / 1E1)", TEMPERATURE_STOPS))


@query
def gradient_humidity(d):
    return over_cells(d, gradient("(humidity_dp / 1E1)", HUMIDITY_STOPS))


@query
def raster_water(d):
    pick = lambda k: f"CASE WHEN is_water THEN {WATER_COLORS['ocean'][k]} ELSE {LAND_COLOR[k]} END"
    return over_cells(d, ", ".join(f"{pick(k)} AS {n}" for k, n in enumerate("rgb")))


def categorical(index: str) -> str:
    """Three channels for a number: golden-ratio hues at saturation 0.55 and value 0.9."""
    hue = f"({index} * 6.180339887498949E-1 - floor({index} * 6.180339887498949E-1))"
    part = f"({hue} * 6 - floor({hue} * 6))"
    level = {"v": "9E-1", "p": "9E-1 * (1 - 5.5E-1)", "q": f"9E-1 * (1 - {part} * 5.5E-1)", "t": f"9E-1 * (1 - (1 - {part}) * 5.5E-1)"}
    channels = {"r": "vqpptv", "g": "tvvqpp", "b": "pptvvq"}
    return ", ".join(f"CAST(round(CASE CAST(floor({hue} * 6) AS INT) " + " ".join(f"WHEN {s} THEN {level[c]}" for s, c in enumerate(path)) + f" END * 255) AS INT) AS {n}" for n, path in channels.items())


@query
def categorical_color(d):
    return f"WITH {cells(d)}, t AS (SELECT DISTINCT territory FROM cells WHERE territory IS NOT NULL) SELECT territory, {categorical('territory')} FROM t"


@query
def zoom(d):
    return f"""WITH {cells(d)}, wide AS (SELECT x, y, height_m, {d.explode(d.numbers('0', '1'))} AS i FROM cells),
    tall AS (SELECT *, {d.explode(d.numbers('0', '1'))} AS j FROM wide)
    SELECT CAST((2 * y + j) * 200 + 2 * x + i AS BIGINT) AS pixel, height_m FROM tall"""


@query
def synthetic_island(d):
    """The synthetic island of seed 42: a paraboloid whose center and amplitude come from named bytes."""
    from tessera.sources.world_file import HEIGHT, WIDTH, island_shape

    cx, cy, amplitude, _ = island_shape(42)
    h = f"({amplitude!r}E0 - 9E-1 * ((x - {cx}) * (x - {cx}) + (y - {cy}) * (y - {cy})))"
    return f"""WITH ids AS (SELECT {d.explode(d.numbers('0', str(WIDTH * HEIGHT - 1)))} AS id),
    xy AS (SELECT CAST(id AS BIGINT) AS cell_id, CAST(id AS BIGINT) % {WIDTH} AS x, {d.div('CAST(id AS BIGINT)', str(WIDTH))} AS y FROM ids)
    SELECT cell_id, {d.whole(h)} AS height_m, {h} <= 0 AS is_water FROM xy"""


@query
def raster_precipitation(d):
    return over_cells(d, gradient("(humidity_dp * 3E0)", PRECIPITATION_STOPS))


@query
def raster_potential(d):
    return f"""WITH {cells(d)}, p AS (SELECT territory, {d.whole(f'{d.exact_mean(SCORE)} / 1E-3')} AS potential FROM cells WHERE territory IS NOT NULL GROUP BY territory)
      SELECT territory, {gradient('(potential * 1E0)', POTENTIAL_STOPS)} FROM p"""


@query
def raster_height(d):
    """Grey by height, 40 for the lowest and 235 for the highest cell."""
    return f"""WITH {cells(d)}, m AS (SELECT min(height_m) AS lo, max(height_m) AS hi FROM cells)
      SELECT cell_id, CAST(CASE WHEN hi > lo THEN round(4E1 + 1.95E2 * ((height_m - lo) * 1E0 / (hi - lo))) ELSE 40 END AS INT) AS grey FROM cells CROSS JOIN m"""


@query
def raster_biome(d):
    """The registry's colour of each cell's biome."""
    return f"""WITH {cells(d)}, {dithered(d)}, b AS (SELECT cell_id, {biomes.case_sql('is_water', 'height_m', 'temperature_dc', 't', 'h')} AS biome FROM dith),
    reg AS (SELECT * FROM (VALUES {biomes.registry_sql()}) AS r(id, name, category, r, g, b, deprecated))
    SELECT b.cell_id, reg.r, reg.g, reg.b FROM b JOIN reg ON reg.id = b.biome"""


@query
def raster_territory(d):
    """Land cells by territory, others in the colour of none."""
    none = ", ".join(f"coalesce(c.{n}, {v}) AS {n}" for n, v in zip("rgb", NO_TERRITORY_COLOR, strict=True))
    return f"WITH {cells(d)}, t AS (SELECT DISTINCT territory FROM cells WHERE territory IS NOT NULL), c AS (SELECT territory, {categorical('territory')} FROM t) SELECT cell_id, {none} FROM cells LEFT JOIN c ON c.territory = cells.territory"
