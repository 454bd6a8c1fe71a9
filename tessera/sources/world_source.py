"""World files as a Spark data source: the cells of a file are read by ranges of bytes, in as many tasks as it has ranges.

    spark.dataSource.register(WorldSource)
    spark.read.format("world").load(path)

The checksum at a file's end is over all its bytes in sequence, so it isn't checked here; whole files are by
from_bytes(), and the rules of worlds by tessera.stages.validate.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.session import open_folder
from tessera.sources.world_file import NONE, WorldError, _Reader, read_header

SCHEMA = "world string, cell_id long, x int, y int, height_m int, is_water boolean, territory int, water_body int, temperature int, humidity int, precipitation int, biome int"
#: How a cell and the values of sections are stored, and the bytes of a file that its header is within.
CELL = np.dtype([("height_m", "<i4"), ("is_water", "u1"), ("territory", "<u4"), ("water_body", "<u4")])
FORMS = {"temperature": "<i2", "humidity": "<i2", "precipitation": "<i4", "biome": "<u2"}
HEADER_BYTES = 4096

#: Cells of a task and of a batch; the first is the option cellsPerTask.
CELLS_PER_TASK, CELLS_PER_BATCH = 2_000_000, 100_000


@dataclass(frozen=True)
class Layout:
    """Where the parts of a file are: its cells, and the values of each section that it has."""

    width: int
    height: int
    cells: int
    sections: dict[str, int]


def layout(source) -> Layout:
    """The layout of an open file; tables of entities are passed over, their items being read only as far as their sizes vary."""
    size = source.size() - 8
    if size < 0:
        raise WorldError("UnexpectedEnd")
    r = _Reader(source.read_at(min(size, HEADER_BYTES), 0))
    w, schema = read_header(r)
    n, at = w.width * w.height, r.at

    def take(form: str) -> tuple:
        nonlocal at
        k = struct.calcsize("<" + form)
        if at + k > size:
            raise WorldError("UnexpectedEnd")
        at += k
        return struct.unpack("<" + form, source.read_at(k, at - k))

    def skip(k: int) -> None:
        nonlocal at
        if at + k > size:
            raise WorldError("UnexpectedEnd")
        at += k

    skip(n * CELL.itemsize)
    for _ in range(take("I")[0]):
        skip(31)
        skip(8 * take("B")[0])
    skip(8 * take("I")[0])
    skip(25 * take("I")[0])
    for _ in range(take("I")[0]):
        skip(24)
        skip(8 * take("I")[0])
    sections = {}
    for name, form in FORMS.items():
        if (name != "biome" or schema) and take("B")[0]:
            if take("I")[0] != n:
                raise WorldError("SectionLengthMismatch", name)
            sections[name] = at
            skip(n * np.dtype(form).itemsize)
    return Layout(w.width, w.height, r.at, sections)


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    first: int
    end: int


class WorldReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("cellspertask", options.get("cellsPerTask", CELLS_PER_TASK)))

    def partitions(self) -> list[Range]:
        fs, base = open_folder(self.path)
        info = fs.get_file_info(base)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        names = [base] if info.is_file else sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(base)) if f.is_file and not f.base_name.startswith((".", "_")))
        out = []
        for name in names:
            with fs.open_input_file(name) as source:
                known = layout(source)
            n = known.width * known.height
            out += [Range(name, known, k, min(k + self.step, n)) for k in range(0, n, self.step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(self.path)
        with fs.open_input_file(partition.path) as source:
            for k in range(partition.first, partition.end, CELLS_PER_BATCH):
                yield _batch(source, partition, k, min(k + CELLS_PER_BATCH, partition.end))


def _batch(source, part: Range, first: int, end: int) -> pa.RecordBatch:
    n, known, i32 = end - first, part.layout, pa.int32()
    cells = np.frombuffer(source.read_at(n * CELL.itemsize, known.cells + first * CELL.itemsize), CELL)
    if (cells["is_water"] > 1).any():
        raise WorldError("InvalidBool")
    at = np.arange(first, end)
    place = lambda c: pa.array(cells[c].astype(np.int64), mask=cells[c] == NONE).cast(i32)
    columns = [pa.array([part.path] * n), pa.array(at), pa.array((at % known.width).astype(np.int32)), pa.array((at // known.width).astype(np.int32)), pa.array(cells["height_m"].astype(np.int32)), pa.array(cells["is_water"].astype(bool)), place("territory"), place("water_body")]
    for name, form in FORMS.items():
        if name in known.sections:
            size = np.dtype(form).itemsize
            columns.append(pa.array(np.frombuffer(source.read_at(n * size, known.sections[name] + first * size), form).astype(np.int32)))
        else:
            columns.append(pa.nulls(n, i32))
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


class WorldSource(DataSource):
    """path: a file, or a folder of files; cellsPerTask: how many cells a task reads."""

    @classmethod
    def name(cls) -> str:
        return "world"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WorldReader:
        return WorldReader(self.options)
