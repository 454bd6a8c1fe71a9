"""Named byte streams of a seed: FNV-1a names, ChaCha8 streams. The driver takes a few bytes for literals, tasks take blocks from anywhere."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

U64 = (1 << 64) - 1

#: FNV-1a's basis and prime; the generator that spreads a seed; ChaCha's constant.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
SPREAD, STEP = 6364136223846793005, 11634580027462260723
SIGMA = b"expand 32-byte k"


def fnv1a64(data: bytes, h: int = BASIS) -> int:
    """The hash of data, or of what h is the hash of with data after it."""
    for b in data:
        h = (h ^ b) * PRIME & U64
    return h


def _key(seed: int) -> bytes:
    """32 bytes of a 64-bit seed, four at a time."""
    out = b""
    for _ in range(8):
        seed = (seed * SPREAD + STEP) & U64
        x, turn = ((seed >> 18 ^ seed) >> 27) & 0xFFFFFFFF, seed >> 59
        out += struct.pack("<I", (x >> turn | x << (32 - turn)) & 0xFFFFFFFF)
    return out


def chacha8(key: bytes) -> Iterator[int]:
    """The bytes of the stream of a key, from its start."""
    first = struct.unpack("<4I", SIGMA) + struct.unpack("<8I", key)
    columns = [(k, k + 4, k + 8, k + 12) for k in range(4)]
    diagonals = [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]
    block = 0
    while True:
        start = [*first, block & 0xFFFFFFFF, block >> 32, 0, 0]
        s = list(start)
        for quarter in (columns + diagonals) * 4:
            a, b, c, d = quarter
            for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
                s[x] = (s[x] + s[y]) & 0xFFFFFFFF
                v = s[z] ^ s[x]
                s[z] = (v << turn | v >> (32 - turn)) & 0xFFFFFFFF
        yield from struct.pack("<16I", *((x + y) & 0xFFFFFFFF for x, y in zip(s, start, strict=True)))
        block += 1


def stream_bytes(seed: int, name: str, n: int) -> bytes:
    """The first n bytes of the stream of a name."""
    stream = chacha8(_key(fnv1a64(b"\x01" + name.encode() + struct.pack("<Q", seed))))
    return bytes(next(stream) for _ in range(n))


def stream_blocks(seed: int, name: str, first: int, n: int) -> np.ndarray:
    """Blocks (64 bytes, as 16 numbers of 32 bits each) first to first + n of the stream of a name."""
    key = _key(fnv1a64(b"\x01" + name.encode() + struct.pack("<Q", seed)))
    at = np.arange(first, first + n, dtype=np.uint64)
    start = [np.full(n, v, np.uint32) for v in struct.unpack("<4I", SIGMA) + struct.unpack("<8I", key)]
    start += [at.astype(np.uint32), (at >> np.uint64(32)).astype(np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)]
    s = list(start)
    columns = [(k, k + 4, k + 8, k + 12) for k in range(4)]
    diagonals = [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]
    for a, b, c, d in (columns + diagonals) * 4:
        for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
            s[x] = s[x] + s[y]
            v = s[z] ^ s[x]
            s[z] = (v << np.uint32(turn)) | (v >> np.uint32(32 - turn))
    return np.stack([x + y for x, y in zip(s, start, strict=True)], 1)


class Identifiers:
    """Identifiers of entities by kind and anchor; a collision takes the next probe."""

    KINDS = {"territory": 1, "water_body": 2, "river": 3, "region": 4}
    PROBES = 1 << 20

    def __init__(self) -> None:
        self.used: dict[str, set[int]] = {k: set() for k in self.KINDS}

    def assign(self, kind: str, x: int, y: int, attributes: bytes = b"") -> int:
        head = bytes([1, self.KINDS[kind]]) + struct.pack("<qq", x, y) + attributes
        for probe in range(self.PROBES):
            found = fnv1a64(head + struct.pack("<I", probe)) & (U64 >> 1)
            if found and found not in self.used[kind]:
                self.used[kind].add(found)
                return found
        raise ValueError("no identifier is left at this anchor")
