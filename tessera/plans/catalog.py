"""The named queries of the library, each paired with its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import graphs, relational, scalar, worlds
from tessera.plans.sql import ORACLE, SPARK, Text, run

_TEXTS = scalar.QUERIES | relational.QUERIES


def _runner(text: Text) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark, sf_dir, text(SPARK))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(text) for name, text in _TEXTS.items()} | graphs.QUERIES | worlds.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: text(ORACLE) for name, text in _TEXTS.items()} | {name: text(ORACLE) for name, text in (graphs.ORACLES | worlds.ORACLES).items()}
