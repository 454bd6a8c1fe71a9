"""Stable identifiers of entities by open addressing, in rounds over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.functions.anchors import anchored_id
from tessera.functions.dialect import SPARK
from tessera.session import cut, drop_cut
from tessera.stages.world import StageError

KINDS = {"territory": 1, "water_body": 2, "river": 3, "region": 4}

#: Fixed value: probes after which there is no free identifier.
PROBES = 1 << 20


def identified(entities: DataFrame, kind: str, attributes: tuple[str, ...] = (), bits: int = 63) -> DataFrame:
    """entities (pos, anchor_x, anchor_y, columns of attributes of 0 to 255) with id: what one that assigns them in the order of pos finds.

    Each entity takes the first of its probes' hashes that is not 0 and that no earlier one has. In a round
    every entity holds the hash of its probe; of those that hold one hash the first by pos keeps it, the
    others go to their next probe. An early entity may take a hash that a later one held, so rounds go on
    until nobody moves; the outcome is that of the sequence, since all prefer the lower pos. Entities of one
    anchor and attributes start at their place among each other, as the ones before take as many probes.
    bits are those of the hash that count (fewer only to see collisions).
    """
    place = F.row_number().over(W.Window.partitionBy("anchor_x", "anchor_y", *attributes).orderBy("pos")) - 1
    hashed = F.expr(anchored_id(SPARK, KINDS[kind], "anchor_x", "anchor_y", [f"CAST({a} AS INT)" for a in attributes], "_probe")).bitwiseAND(F.lit((1 << bits) - 1))
    state = cut(entities.withColumn("_probe", place.cast("long")).withColumn("id", hashed))
    while True:
        first = state.groupBy("id").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).where("_n > 1 OR id = 0")
        losers = state.join(first, "id").where("id = 0 OR pos <> _first").select(*entities.columns, (F.col("_probe") + 1).alias("_probe"))
        if losers.isEmpty():
            return state.select(*entities.columns, "id")
        losers = cut(losers)
        if losers.agg(F.max("_probe")).first()[0] >= PROBES:
            raise StageError(f"no free identifier of {kind} within {PROBES} probes")
        old, state = state, cut(state.join(losers.select("pos"), "pos", "left_anti").unionByName(losers.withColumn("id", hashed)))
        drop_cut(old)
        drop_cut(losers)
