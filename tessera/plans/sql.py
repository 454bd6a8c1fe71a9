"""One text for two engines: the few places where Spark SQL and the oracle's SQL differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.dialect import ORACLE, SPARK, Dialect

__all__ = ["ORACLE", "SPARK", "Dialect", "Text", "cells", "run", "smooth", "stencil4", "stencil8"]

TABLES = "region nation customer supplier part orders lineitem events".split()


Text = Callable[[Dialect], str]


def cells(d: Dialect) -> str:
    """The grid: 100 cells wide, one for each order, whole numbers only. Land gets square territories."""
    cents = "CAST(round(o_totalprice * 100) AS BIGINT)"
    return f"""cells0 AS (
      SELECT o_orderkey AS cell_id, o_orderkey % 100 AS x, {d.div('o_orderkey', '100')} AS y,
             {cents} % 12001 - 6000 AS height_m, {cents} % 851 - 250 AS temperature_dc,
             o_custkey % 1001 AS humidity_dp
      FROM {d.table('orders')}),
    cells AS (
      SELECT *, height_m <= 0 AS is_water,
             CASE WHEN height_m > 0 THEN {d.div('y', '5')} * 10 + {d.div('x', '10')} END AS territory
      FROM cells0)"""


def stencil4(d: Dialect, source: str = "cells") -> str:
    """Neighbours W, E, N, S of each cell, in this order; x wraps, rows end at the poles."""
    return f"""off4 AS (SELECT * FROM (VALUES (0, 0, -1), (1, 0, 1), (2, -1, 0), (3, 1, 0)) AS t(ord, dy, dx)),
    st4 AS (SELECT c.cell_id, o.ord, (c.y + o.dy) * 100 + {d.mod('c.x + o.dx', '100')} AS nid, c.y + o.dy AS ny
            FROM {source} c CROSS JOIN off4 o WHERE c.y + o.dy >= 0)"""


def stencil8(d: Dialect, source: str = "cells") -> str:
    """Neighbours NW, W, SW, N, S, NE, E, SE of each cell, in this order."""
    return f"""off8 AS (SELECT * FROM (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, -1, 0), (4, 1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)) AS t(ord, dy, dx)),
    st8 AS (SELECT c.cell_id, o.ord, (c.y + o.dy) * 100 + {d.mod('c.x + o.dx', '100')} AS nid, c.y + o.dy AS ny
            FROM {source} c CROSS JOIN off8 o WHERE c.y + o.dy >= 0)"""


def smooth(d: Dialect) -> str:
    """cells with height_s, the sum of heights in 5 x 5 windows that wrap in x (whole numbers), as their height."""
    return f"""pad AS (
      SELECT x, y, height_m FROM cells UNION ALL
      SELECT x + 100, y, height_m FROM cells WHERE x < 2 UNION ALL
      SELECT x - 100, y, height_m FROM cells WHERE x >= 98),
    rows5 AS (SELECT x, y, sum(height_m) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM pad),
    smooth AS (
      SELECT y * 100 + x AS cell_id, x, y,
             CAST(sum(s) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS height_m
      FROM rows5 WHERE x BETWEEN 0 AND 99)"""


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The text over the tables of sf_dir that it names."""
    used = sorted({t for t in re.findall(r"\{(\w+)\}", text) if t in TABLES})
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})
