"""Worlds of any size to files: tasks pack ranges of cells, and the driver only strings the packs together."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions.rng import fnv1a64
from tessera.session import cut, drop_cut, open_folder, ship
from tessera.sources.world_file import NONE, WorldError, after_cells, before_cells
from tessera.sources.world_source import CELL, FORMS
from tessera.stages.world import SECTIONS, GridWorld, without_cells


def _pack(columns: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            whole = lambda name, none: b.column(name).cast(pa.int64()).fill_null(none).to_numpy()
            at = whole("cell_id", -1)
            if (np.diff(at) != 1).any():
                raise WorldError("CellCountMismatch", "cells are missing or doubled")
            cells = np.empty(len(at), CELL)
            for name, none in (("height_m", 0), ("is_water", 0), ("territory", NONE), ("water_body", NONE)):
                cells[name] = whole(name, none) if name in columns else none
            values = [whole(s, 0).astype(FORMS[s]).tobytes() if s in columns else None for s in SECTIONS]
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([len(at)], pa.int64()), *[pa.array([v], pa.binary()) for v in (cells.tobytes(), *values)]], ["first", "n", "cells", *SECTIONS])

    return pack


def write_world(g: GridWorld, path: str) -> int:
    """Write a world to a file at path (as the file system of the driver knows it); the checksum of its contents.

    Tasks pack the cells of a range; the packs go to the shared folder and come one by one, in order, to the
    driver, which holds one pack and the tables of entities. The file gets its name when it is whole. Missing
    or doubled cells are an error.
    """
    ship(g.spark)
    w, size = without_cells(g), g.width * g.height
    columns = [c for c in ("cell_id", "height_m", "is_water", "territory", "water_body", *SECTIONS) if c in g.cells.columns]
    sorted_ = g.cells.select(*columns).repartitionByRange("cell_id").sortWithinPartitions("cell_id")
    packs = cut(sorted_.mapInArrow(_pack(columns), "first long, n long, cells binary, " + ", ".join(f"{s} binary" for s in SECTIONS)))
    fs, name = open_folder(path)
    folder, _, last = name.rpartition("/")
    draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
    check = None
    with fs.open_output_stream(draft, compression=None) as out:

        def put(data: bytes) -> None:
            nonlocal check
            out.write(data)
            check = fnv1a64(data) if check is None else fnv1a64(data, check)

        def stream(column: str) -> None:
            at = 0
            for r in packs.select("first", "n", F.col(column).alias("data")).orderBy("first").toLocalIterator():
                if r.first != at:
                    raise WorldError("CellCountMismatch", f"cell {at}")
                put(bytes(r.data))
                at += r.n
            if at != size:
                raise WorldError("CellCountMismatch", f"{at} of {size}")

        put(before_cells(w))
        stream("cells")
        put(after_cells(w))
        for s in SECTIONS:
            put(struct.pack("<B", s in columns))
            if s in columns:
                put(struct.pack("<I", size))
                stream(s)
        out.write(struct.pack("<Q", check))
    fs.move(draft, name)
    drop_cut(packs)
    return check
