"""Positions in a global order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tessera.session import cut

#: Rows of a partition are numbered in the low bits of monotonically_increasing_id().
SHIFT = 33


def ranked(df: DataFrame, *order: Column, name: str = "rank", within: str | None = None) -> DataFrame:
    """df with each row's position (from 0) in an order that leaves no ties.

    Rows are dealt by ranges and sorted where they lie; a row's position is its place in its range plus the
    rows of the ranges before, of which there is one number a range. With `within` (the first key of the
    order) positions count from the first row of each of its values.
    """
    at = F.monotonically_increasing_id()
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", SHIFT), F.col("_at").bitwiseAND(F.lit((1 << SHIFT) - 1))
    sizes = sorted(sorted_.groupBy(part.alias("p")).count().collect(), key=lambda r: r.p)  # a row a range
    before, starts = 0, []
    for r in sizes:
        starts.append((r.p, before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _before long")
    out = sorted_.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, place + F.col("_before")).drop("_at", "_p", "_before")
    if within is None:
        return out
    first = out.groupBy(F.col(within).alias("_of")).agg(F.min(name).alias("_first"))
    return out.join(first, F.col(within) == F.col("_of")).withColumn(name, F.col(name) - F.col("_first")).drop("_of", "_first")


def running(df: DataFrame, value: Column, *order: Column, name: str) -> DataFrame:
    """df with the sum of a whole-number value over the rows before each one, in an order that leaves no ties.

    As with positions, ranges are summed where they lie, and the sum of the ranges before is one number a range.
    """
    sorted_ = cut(df.withColumn("_v", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sorted_ = sorted_.withColumn("_p", F.shiftright("_at", SHIFT))
    before, carried = 0, []
    for r in sorted(sorted_.groupBy("_p").agg(F.sum("_v").alias("n")).collect(), key=lambda r: r["_p"]):  # a row a range
        carried.append((r["_p"], before))
        before += r.n or 0
    carry = df.sparkSession.createDataFrame(carried or [(0, 0)], "_p long, _carry long")
    own = W.Window.partitionBy("_p").orderBy("_at").rowsBetween(W.Window.unboundedPreceding, -1)
    inside = sorted_.withColumn("_own", F.coalesce(F.sum("_v").over(own), F.lit(0)))
    return inside.join(F.broadcast(carry), "_p").withColumn(name, F.col("_own") + F.col("_carry")).drop("_v", "_at", "_p", "_own", "_carry")


def apportioned(areas: DataFrame, total: int) -> DataFrame:
    """areas (pos, area and more; areas of 1 or more) with seats, total in all: from the number of rows up to the sum of areas.

    Each gets its share rounded down, and one at least; what is missing goes to the largest remainders, each
    up to its area, what is too much comes from the smallest, each down to one. Ties go to the larger area,
    then to the lower pos.
    """
    whole = areas.agg(F.sum("area")).first()[0] or 1
    product = F.col("area") * F.lit(total).cast("long")
    shares = areas.withColumn("_rest", product % F.lit(whole))
    shares = cut(shares.withColumn("_seats", F.greatest(F.expr(f"(area * {total}L - _rest) div {whole}L"), F.lit(1).cast("long"))))
    missing = total - (shares.agg(F.sum("_seats")).first()[0] or 0)
    more = missing > 0
    room = F.col("area") - F.col("_seats") if more else F.col("_seats") - 1
    known = running(shares, room, F.desc("_rest") if more else F.col("_rest"), F.desc("area"), F.col("pos"), name="_before")
    change = F.greatest(F.least(room, F.lit(abs(missing)) - F.col("_before")), F.lit(0))
    return known.withColumn("seats", (F.col("_seats") + change * (1 if more else -1)).cast("long")).drop("_seats", "_rest", "_before")


def even_positions(length: Column, count: Column, rank: Column) -> Column:
    """Whether a position is one of `count` at even steps of a list; a list of just so many is taken whole."""
    step = F.floor((length - 1) / F.greatest(count, F.lit(1))).cast("long")
    stepped = F.greatest(step, F.lit(1))
    return (length == count) | ((step > 0) & (rank % stepped == 0) & (F.floor(rank / stepped) < count))
