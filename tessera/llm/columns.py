"""Rows of the caller's in one column, so that no name of theirs meets a name that an operator works with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The only column of the caller's while an operator works.
ROW = "_row"


def packed(docs: DataFrame, *needed: Column | str, without: tuple[str, ...] = ()) -> DataFrame:
    """ROW (the columns of docs but those of without) and what the operator reads."""
    own = [_of(c) for c in docs.columns if c not in without]
    return docs.select(F.struct(*own or [F.lit(None).alias("_none")]).alias(ROW), *needed)


def unpacked(df: DataFrame, names: list[str], *added: Column | str, instead: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ROW by their names, some with another value, then what is added."""
    instead = instead or {}
    return df.select(*[instead[n].alias(n) if n in instead else F.col(ROW).getField(n).alias(n) for n in names], *added)


def _of(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
