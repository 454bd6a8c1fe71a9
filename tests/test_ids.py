"""Identifiers against one that assigns them one after the other."""

import random
import struct

import pytest

from tessera.stages import ids
from tessera.stages.world import StageError


def one_by_one(rows, kind, bits):
    used, out = set(), {}
    for pos, x, y, wet in sorted(rows):
        for probe in range(ids.PROBES):
            h = 0xCBF29CE484222325
            for b in bytes([1, kind]) + struct.pack("<qq", x, y) + bytes([wet]) + struct.pack("<I", probe):
                h = ((h ^ b) * 0x100000001B3) % (1 << 64)
            h &= (1 << bits) - 1
            if h and h not in used:
                used.add(h)
                out[pos] = h
                break
    return out


@pytest.mark.parametrize(("n", "bits"), [(300, 12), (200, 9), (40, 63)])
def test_collisions_are_probed_in_order(spark, n, bits):
    rng = random.Random(bits)
    rows = [(pos, rng.randrange(-4, 30), rng.randrange(8), rng.randrange(2)) for pos in range(n)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "pos long, anchor_x long, anchor_y long, wet int").repartition(3)
    got = ids.identified(frame, "territory", ("wet",), bits)
    assert got.columns == ["pos", "anchor_x", "anchor_y", "wet", "id"]
    assert {r.pos: r.id for r in got.collect()} == one_by_one(rows, 1, bits)


def test_no_free_identifier(spark, monkeypatch):
    monkeypatch.setattr(ids, "PROBES", 8)
    frame = spark.createDataFrame([(k, 1, 1) for k in range(4)], "pos long, anchor_x long, anchor_y long")
    with pytest.raises(StageError):
        ids.identified(frame, "river", (), 1)
    assert ids.identified(frame.limit(0), "river").count() == 0
