"""Binary world files: encoding, decoding with all checks, and the synthetic worlds.

A file is one sequence with a hash at its end, so it is put together where the file is written; tables of
cells come in and go out as DataFrames. Positions in lists are the foreign keys; None is no entity.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rng import Identifiers, fnv1a64, stream_bytes

#: Fixed values of the format.
MAGIC = b"VGW\0"
SCHEMA, PARAMS = 1, 6
ID_STRATEGY, LATTICES, BIOMES = "content-hash-v1", "lr-v1", "biomes-v1"
NONE = 0xFFFFFFFF
LONGEST_STRING = 128

CELLS = "cell_id long, x int, y int, height_m int, is_water boolean, territory int, water_body int"


class WorldError(ValueError):
    """A file or world that breaks a rule; rule names it."""

    def __init__(self, rule: str, message: str = "") -> None:
        super().__init__(f"{rule}: {message}" if message else rule)
        self.rule = rule


@dataclass
class World:
    seed: int
    width: int
    height: int
    cells: list[tuple[int, bool, int | None, int | None]]
    territories: list[tuple[int, bool, int, int, int, int, int | None]] = field(default_factory=list)  # id, water, x, y, cells, potential, region
    regions: list[int] = field(default_factory=list)
    water_bodies: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, kind, x, y
    rivers: list[tuple[int, int, int, list[int]]] = field(default_factory=list)  # id, mouth x, y, path
    temperature: list[int] | None = None
    humidity: list[int] | None = None
    precipitation: list[int] | None = None
    biomes: list[int] | None = None
    connectivity: int = 0
    params_version: int = 0
    climate: tuple[int, ...] | None = None  # four numbers
    terrain: tuple | None = None  # ((droplets, power, talus) or None, features, least cells, land, islands, hypsometry, warp, warp features, ridge, ridge features)
    hydrology: int | None = None


def before_cells(w: World) -> bytes:
    """What stands before the cells: the format, the parameters, the size of the grid."""
    out = bytearray(MAGIC + struct.pack("<I", SCHEMA))

    def put(form: str, *values) -> None:
        out.extend(struct.pack("<" + form, *values))

    def text(s: str) -> None:
        put("H", len(s.encode()))
        out.extend(s.encode())

    for s in (ID_STRATEGY, LATTICES, BIOMES):
        text(s)
    put("IQ", w.params_version, w.seed)
    if w.params_version >= 2:
        put("B", (w.climate is not None) | (w.terrain is not None) << 1 | (w.hydrology is not None) << 2)
    if w.params_version >= 1 and w.climate is not None:
        put("4h", *w.climate)
    if w.params_version >= 2 and w.terrain is not None:
        erosion, features, least, *rest = w.terrain
        put("B", erosion is not None)
        if erosion is not None:
            put("hhi", *erosion)
        for at, form, values in ((4, "hI", (features, least)), (5, "hh", rest[:2]), (6, "5h", rest[2:])):
            if w.params_version >= at:
                put(form, *values)
    if w.params_version >= 2 and w.hydrology is not None:
        put("h", w.hydrology)
    put("IIB", w.width, w.height, w.connectivity)
    return bytes(out)


def after_cells(w: World) -> bytes:
    """The tables of entities, which stand between the cells and the sections."""
    out = bytearray()

    def put(form: str, *values) -> None:
        out.extend(struct.pack("<" + form, *values))

    put("I", len(w.territories))
    for i, water, x, y, n, potential, region in w.territories:
        put("QBqqIhB", i, water, x, y, n, potential, region is not None)
        if region is not None:
            put("Q", region)
    put("I", len(w.regions))
    for i in w.regions:
        put("Q", i)
    put("I", len(w.water_bodies))
    for b in w.water_bodies:
        put("QBqq", *b)
    put("I", len(w.rivers))
    for i, x, y, path in w.rivers:
        put("QqqI", i, x, y, len(path))
        put(f"{len(path)}Q", *path)
    return bytes(out)


def to_bytes(w: World) -> bytes:
    out = bytearray(before_cells(w))

    def put(form: str, *values) -> None:
        out.extend(struct.pack("<" + form, *values))

    for h, water, territory, body in w.cells:
        put("iBII", h, water, NONE if territory is None else territory, NONE if body is None else body)
    out += after_cells(w)
    for values, form in ((w.temperature, "h"), (w.humidity, "h"), (w.precipitation, "i"), (w.biomes, "H")):
        put("B", values is not None)
        if values is not None:
            put(f"I{len(values)}{form}", len(values), *values)
    return bytes(out) + struct.pack("<Q", fnv1a64(bytes(out)))


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        n = struct.calcsize("<" + form)
        if self.at + n > len(self.data):
            raise WorldError("UnexpectedEnd")
        self.at += n
        return struct.unpack("<" + form, self.data[self.at - n : self.at])

    def one(self, form: str):
        return self.take(form)[0]

    def flag(self) -> bool:
        b = self.one("B")
        if b > 1:
            raise WorldError("InvalidBool", str(b))
        return b == 1

    def count(self, least: int) -> int:
        """A number of items of so many bytes at least, which must fit."""
        n = self.one("I")
        if n * least > len(self.data) - self.at:
            raise WorldError("UnexpectedEnd", f"{n} items")
        return n

    def text(self) -> str:
        n = self.one("H")
        if n > LONGEST_STRING:
            raise WorldError("StringTooLong", str(n))
        try:
            return self.take(f"{n}s")[0].decode()
        except UnicodeDecodeError:
            raise WorldError("InvalidUtf8") from None


def stored_hash(data: bytes) -> int:
    return struct.unpack("<Q", data[-8:])[0]


def read_header(r: _Reader) -> tuple[World, int]:
    """What stands before the cells: a world without any, and the number of the format."""
    if r.take("4s")[0] != MAGIC:
        raise WorldError("InvalidMagic")
    schema = r.one("I")
    if schema > SCHEMA:
        raise WorldError("UnsupportedSchema", str(schema))
    for name, want in (("IdStrategy", ID_STRATEGY), ("LatticeRegistry", LATTICES), *([("BiomeRegistry", BIOMES)] if schema else [])):
        if (got := r.text()) != want:
            raise WorldError(f"Unsupported{name}", got)
    version, seed = r.take("IQ")
    if version > PARAMS:
        raise WorldError("UnsupportedParams", str(version))
    flags = r.one("B") if version >= 2 else int(version == 1)
    if flags > 7:
        raise WorldError("InvalidFlags", str(flags))
    w = World(seed, 0, 0, [], params_version=version)
    if flags & 1:
        w.climate = r.take("4h")
    if flags & 2:
        erosion = r.take("hhi") if r.flag() else None
        features = r.take("hI") if version >= 4 else (150, 8)
        land = r.take("hh") if version >= 5 else (30, 50)
        rest = r.take("5h") if version >= 6 else (100, 0, 600, 0, 500)
        w.terrain = (erosion, *features, *land, *rest)
    if flags & 4:
        w.hydrology = r.one("h")
    w.width, w.height, w.connectivity = r.take("IIB")
    if w.connectivity > 1:
        raise WorldError("InvalidConnectivity", str(w.connectivity))
    return w, schema


def from_bytes(data: bytes) -> World:
    """Decode and validate; the first broken rule is raised."""
    if len(data) < 8:
        raise WorldError("UnexpectedEnd")
    if fnv1a64(data[:-8]) != stored_hash(data):
        raise WorldError("HashMismatch")
    r = _Reader(data[:-8])
    w, schema = read_header(r)
    none = lambda v: None if v == NONE else v
    if w.width * w.height * 13 > len(r.data) - r.at:
        raise WorldError("UnexpectedEnd", "cells")
    for _ in range(w.width * w.height):
        h, water, t, b = r.one("i"), r.flag(), *r.take("II")
        w.cells.append((h, water, none(t), none(b)))
    for _ in range(r.count(32)):
        i, water, rest = r.one("Q"), r.flag(), r.take("qqIh")
        w.territories.append((i, water, *rest, r.one("Q") if r.flag() else None))
    w.regions = [r.one("Q") for _ in range(r.count(8))]
    for _ in range(r.count(25)):
        body = r.take("QBqq")
        if body[1] > 2:
            raise WorldError("InvalidWaterBodyKind", str(body[1]))
        w.water_bodies.append(body)
    for _ in range(r.count(28)):
        i, x, y = r.take("Qqq")
        w.rivers.append((i, x, y, list(r.take(f"{r.count(8)}Q"))))
    for name, form in (("temperature", "h"), ("humidity", "h"), ("precipitation", "i"), *([("biomes", "H")] if schema else [])):
        if r.flag():
            setattr(w, name, list(r.take(f"{r.count(struct.calcsize('<' + form))}{form}")))
    validate(w)
    return w


def validate(w: World) -> None:
    """The rules that a decoded world keeps, in their order."""
    n = w.width * w.height
    if len(w.cells) != n:
        raise WorldError("CellCountMismatch")

    def distinct(name: str, ids: list[int]) -> None:
        seen = set()
        for i in ids:
            if i == 0:
                raise WorldError("ReservedId", name)
            if i in seen:
                raise WorldError("DuplicateId", name)
            seen.add(i)

    def inside(name: str, x: int, y: int) -> None:
        if not (0 <= x < w.width and 0 <= y < w.height):
            raise WorldError("AnchorOutOfBounds", name)

    distinct("territory", [t[0] for t in w.territories])
    known = set(w.regions)
    for t in w.territories:
        inside("territory", t[2], t[3])
        if t[6] is not None and t[6] not in known:
            raise WorldError("UnknownRegion", str(t[6]))
    distinct("region", w.regions)
    distinct("water body", [b[0] for b in w.water_bodies])
    for b in w.water_bodies:
        inside("water body", b[2], b[3])
    distinct("river", [r[0] for r in w.rivers])
    for _, x, y, path in w.rivers:
        inside("river", x, y)
        if not path or max(path) >= n:
            raise WorldError("InvalidRiverPath")
    members = [0] * len(w.territories)
    for _, water, t, b in w.cells:
        if t is not None:
            if t >= len(w.territories):
                raise WorldError("TerritoryIndexOutOfRange")
            members[t] += 1
        if b is not None:
            if b >= len(w.water_bodies):
                raise WorldError("WaterBodyIndexOutOfRange")
            if not water:
                raise WorldError("LandCellInWaterBody")
    for t, have in zip(w.territories, members, strict=True):
        if t[4] != have:
            raise WorldError("MemberCountMismatch")
    for name in ("temperature", "humidity", "precipitation", "biomes"):
        if (v := getattr(w, name)) is not None and len(v) != n:
            raise WorldError("SectionLengthMismatch", name)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all world files under path, with the file's name as world; each file is decoded by one task."""

    def decode(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                w = from_bytes(bytes(content))
                at = range(len(w.cells))
                h, water, t, b = zip(*w.cells, strict=True) if w.cells else ((), (), (), ())
                frame = pd.DataFrame({"world": name, "cell_id": at, "x": [k % w.width for k in at], "y": [k // w.width for k in at], "height_m": h, "is_water": water})
                yield frame.assign(territory=pd.array(t, "Int32"), water_body=pd.array(b, "Int32"))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "world string, " + CELLS)


#: Tables of entities in a file, by their positions.
TABLES = {
    "territories": "pos long, id long, is_water boolean, anchor_x long, anchor_y long, cell_count long, natural_potential int, region long",
    "regions": "pos long, id long",
    "water_bodies": "pos long, id long, kind int, anchor_x long, anchor_y long",
    "rivers": "pos long, id long, mouth_x long, mouth_y long, path array<long>",
}
SECTIONS = "cell_id long, temperature int, humidity int, precipitation int, biome int"


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of entities (of TABLES) of all world files under path, or their sections by cell; each file is decoded by one task."""
    schema = SECTIONS if table == "sections" else TABLES[table]

    def rows(w: World) -> list[tuple]:
        if table == "sections":
            n = w.width * w.height
            columns = [v if v is not None else [None] * n for v in (w.temperature, w.humidity, w.precipitation, w.biomes)]
            return list(zip(range(n), *columns, strict=True))
        return [(k, *(i if isinstance(i, tuple) else (i,))) for k, i in enumerate(getattr(w, table))]

    def decode(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(name, *r) for r in rows(from_bytes(content))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    whole = to_arrow_schema(_parse_datatype_string("world string, " + schema))
    kinds, names = whole.types, whole.names
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "world string, " + schema)


# The synthetic world

WIDTH, HEIGHT, CENTER = 48, 32, (24, 16)


def island_shape(seed: int) -> tuple[int, int, float, int]:
    """Center, amplitude and river column of the synthetic island of a seed."""
    a, b, c = stream_bytes(seed, "synthetic.terrain", 3)
    river = stream_bytes(seed, "synthetic.river", 1)[0]
    return CENTER[0] + a % 7 - 3, CENTER[1] + b % 7 - 3, 150.0 * (1000.0 + c) / 1000.0, CENTER[0] + river % 9 - 4


def island_cells(spark: SparkSession, seed: int) -> DataFrame:
    """Cells of the synthetic island: a paraboloid over the distance from its center."""
    cx, cy, amplitude, _ = island_shape(seed)
    df = spark.range(WIDTH * HEIGHT).select(F.col("id").alias("cell_id"), (F.col("id") % WIDTH).alias("x"), F.expr(f"id div {WIDTH}").alias("y"))
    height = F.lit(amplitude) - F.lit(0.9) * ((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy))
    return df.select("cell_id", "x", "y", F.rint(height).cast("int").alias("height_m"), (height <= 0).alias("is_water"))


def synthetic_world(spark: SparkSession, seed: int) -> World:
    """The island with its two territories, one region, ocean and river. Entities are aggregates of the cells."""
    df = island_cells(spark, seed)
    half = F.when(~F.col("is_water"), F.when(F.col("x") < WIDTH // 2, 0).otherwise(1))
    groups = df.groupBy(F.coalesce(half, F.lit(2)).alias("g")).agg(F.expr("sum(x) div count(*)").alias("ax"), F.expr("sum(y) div count(*)").alias("ay"), F.count("*").alias("n"))
    by = {r.g: r for r in groups.collect()}
    ids = Identifiers()
    halves = sorted((0, 1), key=lambda g: (by[g].ay, by[g].ax))
    named = [(ids.assign("territory", by[g].ax, by[g].ay, b"\0"), g) for g in halves]
    region = min(i for i, _ in named)
    rows = df.orderBy("cell_id").collect()  # 1536 cells
    place = {g: k for k, g in enumerate(halves)}
    cells = [(r.height_m, r.is_water, None if r.is_water else place[int(r.x >= WIDTH // 2)], 0 if r.is_water else None) for r in rows]
    column = island_shape(seed)[3]
    path = [r.cell_id for r in rows if r.x == column and not r.is_water]
    mouth = path[-1]
    return World(
        seed,
        WIDTH,
        HEIGHT,
        cells,
        [(i, False, by[g].ax, by[g].ay, by[g].n, (500, 750)[g], region) for i, g in named],
        [region],
        [(ids.assign("water_body", by[2].ax, by[2].ay), 0, by[2].ax, by[2].ay)],
        [(ids.assign("river", mouth % WIDTH, mouth // WIDTH), mouth % WIDTH, mouth // WIDTH, path)],
    )


def minimal_world(spark: SparkSession) -> World:
    """The synthetic world of seed 0."""
    return synthetic_world(spark, 0)
