"""Biomes: the registry, and the ordered rules that give each cell one."""

from __future__ import annotations

#: Fixed values: (id, name, category, red, green, blue).
REGISTRY = (
    (1, "DeepOcean", "Water", 0, 30, 80),
    (2, "Ocean", "Water", 0, 70, 140),
    (3, "IcyOcean", "Water", 120, 180, 220),
    (4, "FrozenOcean", "Water", 180, 200, 220),
    (5, "Ice", "Climate", 220, 230, 255),
    (6, "Tundra", "Climate", 200, 210, 190),
    (7, "Taiga", "Climate", 80, 120, 80),
    (8, "TemperateForest", "Climate", 60, 140, 60),
    (9, "TropicalRainforest", "Climate", 30, 100, 30),
    (10, "Grassland", "Climate", 140, 190, 100),
    (11, "Shrubland", "Climate", 160, 150, 100),
    (12, "Savanna", "Climate", 190, 170, 100),
    (13, "Desert", "Climate", 220, 200, 150),
    (14, "Swamp", "Climate", 70, 110, 60),
    (15, "RockyMountain", "Mountain", 140, 140, 140),
    (16, "GlacialMountain", "Mountain", 200, 220, 240),
)

ANY = 100_000

#: Fixed values: (tier, height or depth over, temperature below, humidity below, biome), first match wins.
#: Tiers: 0 water (by depth), 1 mountains over 2500 m, 2 other land (dithered values).
#: Water deeper than 1000 m gets 2 and other open water 1, as the exports have them.
RULES = (
    (0, -1, -50, ANY, 4),
    (0, -1, 50, ANY, 3),
    (0, 1000, ANY, ANY, 2),
    (0, -1, ANY, ANY, 1),
    (1, 3500, 50, ANY, 16),
    (1, 3500, ANY, ANY, 15),
    (1, 2500, 0, ANY, 16),
    (1, 2500, ANY, ANY, 15),
    (2, -ANY, -120, ANY, 5),
    (2, -ANY, 0, 400, 6),
    (2, -ANY, 0, ANY, 7),
    (2, -ANY, 180, 200, 11),
    (2, -ANY, 180, 400, 10),
    (2, -ANY, 180, 700, 8),
    (2, -ANY, 180, ANY, 14),
    (2, -ANY, ANY, 250, 13),
    (2, -ANY, ANY, 550, 12),
    (2, -ANY, ANY, ANY, 9),
)


def rules_sql() -> str:
    return ", ".join(f"({k}, {', '.join(map(str, r))})" for k, r in enumerate(RULES))


def case_sql(water: str, height: str, temperature: str, dithered_t: str, dithered_h: str) -> str:
    """The rules as one CASE over whether a cell is water (land may lie at height 0), a height, a temperature, and dithered temperature and humidity (in lattice steps)."""
    arms = []
    for tier, over, t, h, biome in RULES:
        tests = [(water, f"NOT {water} AND {height} > 2500", f"NOT {water} AND {height} <= 2500")[tier]]
        if tier == 0 and over >= 0:
            tests.append(f"-({height}) > {over}")
        if tier == 1:
            tests.append(f"{height} > {over}")
        if t < ANY:
            tests.append(f"{dithered_t if tier == 2 else temperature} < {t}")
        if h < ANY:
            tests.append(f"{dithered_h} < {h}")
        arms.append(f"WHEN {' AND '.join(tests)} THEN {biome}")
    return f"(CASE {' '.join(arms)} END)"


def registry_sql() -> str:
    return ", ".join(f"({i}, '{n}', '{c}', {r}, {g}, {b}, false)" for i, n, c, r, g, b in REGISTRY)
