"""Identifiers as hashes of kinds, anchors, attributes and probes, in either SQL."""

from __future__ import annotations

from tessera.functions.dialect import Dialect


def fnv_bytes(d: Dialect, items: list[str]) -> str:
    """FNV-1a 64 of a list of byte expressions, top bit cleared."""
    if d.spark:
        low = "CAST(a % 256 AS INT)"
        step = f"CAST(((a - {low} + ({low} ^ b)) * CAST(1099511628211 AS DECIMAL(13, 0))) % CAST(18446744073709551616 AS DECIMAL(20, 0)) AS DECIMAL(20, 0))"
        h = f"aggregate(array({', '.join(f'CAST({i} AS INT)' for i in items)}), CAST(14695981039346656037 AS DECIMAL(20, 0)), (a, b) -> {step})"
        return f"CAST({h} % CAST(9223372036854775808 AS DECIMAL(20, 0)) AS BIGINT)"
    step = "((a - a % 256 + xor(CAST(a % 256 AS INT), CAST(b AS INT))) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT"
    h = f"list_reduce([14695981039346656037::HUGEINT, {', '.join(f'CAST({i} AS HUGEINT)' for i in items)}], lambda a, b: {step})"
    return f"CAST({h} % 9223372036854775808::HUGEINT AS BIGINT)"


def anchored_id(d: Dialect, kind: int, x: str, y: str, attributes: list[str], probe: str) -> str:
    """Identifier of an entity: its kind, anchor, attributes and probe, little-endian, hashed."""
    whole = lambda v, n: [f"({d.shr(f'CAST({v} AS BIGINT)', str(8 * k))} & 255)" for k in range(n)]
    return fnv_bytes(d, ["1", str(kind), *whole(x, 8), *whole(y, 8), *attributes, *whole(probe, 4)])
