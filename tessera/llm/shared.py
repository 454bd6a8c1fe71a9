"""Tables in the shared folder that tasks read themselves, a file at a time."""

from __future__ import annotations

import functools

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from tessera.session import open_folder


def files(df: DataFrame) -> list[str]:
    """The files of a table that cut() wrote, in the order of their names."""
    fs, base = open_folder(df._tessera_path)
    names = sorted(f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if f.base_name.endswith(".parquet"))
    return [f"{df._tessera_path}/{n}" for n in names]


def load(path: str) -> pa.Table:
    """One file, whole: its writer bounds it."""
    fs, name = open_folder(path)
    with fs.open_input_file(name) as source:
        return pq.read_table(source)


@functools.lru_cache(16)
def load_cached(path: str) -> pa.Table:
    """As load(), the last few remembered by the worker; a written file never changes."""
    return load(path)
