"""A PNG sink for rasters: one picture per layer, its rows in order."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png_bytes(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB picture."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + rgb[y * width * 3 : (y + 1) * width * 3] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_png(raster: DataFrame, width: int, path: str, zoom: int = 1) -> None:
    """Write a raster (cell_id, r, g, b), every cell zoom x zoom pixels (1 to 16).

    A picture is one small file in the end: executors pack each row of cells, the driver joins the rows.
    """
    if not 1 <= zoom <= 16:
        raise ValueError("zoom is 1 to 16")
    row = F.array_sort(F.collect_list(F.struct("cell_id", "r", "g", "b")))
    rows = raster.groupBy(F.expr(f"cell_id div {width}").alias("y")).agg(row.alias("row")).orderBy("y")
    packed = [b"".join(bytes((c.r, c.g, c.b)) * zoom for c in r.row) for r in rows.toLocalIterator()]
    with open(path, "wb") as f:
        f.write(png_bytes(width * zoom, len(packed) * zoom, b"".join(p for p in packed for _ in range(zoom))))
