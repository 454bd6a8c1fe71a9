"""Seeded gradient noise in three dimensions (the public OpenSimplex2 lattice), over whole arrays of 32-bit floats.

The lattice is body-centred cubic: two cubic lattices, the second half a step off the first. Each point
takes the nearest lattice point of either, and of its cubic neighbours the next one along the axis on
which it is furthest out. All arithmetic is in 32-bit floats, since whole steps of the results are
compared bit by bit.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np

from tessera.functions.rng import stream_bytes

F = np.float32

#: Fixed values of the public noise: primes of the axes, the hash's multiplier, the turn of space, the scale.
PRIMES = (501125321, 1136930381, 1720413743)
MIX = 0x27D4EB2D
TURN, SCALE = F(2.0 / 3.0), F(32.69428253173828125)
REACH, STEP = F(0.6), F(0.75)


def _gradients() -> np.ndarray:
    """64 directions: the 12 middles of a cube's edges five times, then four of them."""
    signs = ((1, 1), (-1, 1), (1, -1), (-1, -1))
    edges = [(0, a, b) for a, b in signs] + [(a, 0, b) for a, b in signs] + [(a, b, 0) for a, b in signs]
    return np.array(edges * 5 + [(1, 1, 0), (0, -1, 1), (-1, 1, 0), (0, -1, -1)], F)


GRADIENTS = _gradients()


def _pull(seed: np.ndarray, cell: list[np.ndarray], off: list[np.ndarray]) -> np.ndarray:
    """The gradient of a lattice point (its cell times the primes) along an offset from it."""
    h = (seed ^ cell[0] ^ cell[1] ^ cell[2]) * np.int32(MIX)
    g = GRADIENTS[((h ^ (h >> np.int32(15))) >> np.int32(2)) & np.int32(63)]
    return off[0] * g[:, 0] + off[1] * g[:, 1] + off[2] * g[:, 2]


def _fade(a: np.ndarray) -> np.ndarray:
    """The fourth power of what is over 0."""
    a = np.maximum(a, F(0))
    return (a * a) * (a * a)


def simplex(seed: int, points: list[np.ndarray]) -> np.ndarray:
    """Noise in about [-1, 1] at points, which are turned and scaled already."""
    with np.errstate(over="ignore"):
        primes = [np.int32(p) for p in PRIMES]
        whole = [np.where(p >= 0, p + F(0.5), p - F(0.5)).astype(np.int32) for p in points]
        off = [p - w.astype(F) for p, w in zip(points, whole, strict=True)]
        sign = [(F(-1) - o).astype(np.int32) | np.int32(1) for o in off]
        out = [s.astype(F) * -o for s, o in zip(sign, off, strict=True)]
        cell = [w * p for w, p in zip(whole, primes, strict=True)]
        a = (REACH - off[0] * off[0]) - (off[1] * off[1] + off[2] * off[2])
        value, at = np.zeros(len(points[0]), F), np.int32(seed)
        for lattice in range(2):
            value = value + _fade(a) * _pull(at, cell, off)
            first = (out[0] >= out[1]) & (out[0] >= out[2])
            second = ~first & (out[1] > out[0]) & (out[1] >= out[2])
            axis = [first, second, ~first & ~second]
            far = np.where(first, out[0], np.where(second, out[1], out[2]))
            b = ((a + far) + far) - F(1)
            near_cell = [np.where(x, c - s * p, c) for x, c, s, p in zip(axis, cell, sign, primes, strict=True)]
            near_off = [np.where(x, o + s.astype(F), o) for x, o, s in zip(axis, off, sign, strict=True)]
            value = value + _fade(b) * _pull(at, near_cell, near_off)
            if lattice == 0:
                out = [F(0.5) - o for o in out]
                off = [s.astype(F) * o for s, o in zip(sign, out, strict=True)]
                a = (a + (STEP - out[0])) - (out[1] + out[2])
                cell = [c + ((s >> np.int32(1)) & p) for c, s, p in zip(cell, sign, primes, strict=True)]
                sign = [-s for s in sign]
                at = ~at
        return value * SCALE


@dataclass(frozen=True)
class Noise:
    """A field of a seed: one octave, or several of half the size and strength each; ridged ones fold at 0."""

    seed: int
    frequency: float
    octaves: int = 0
    ridged: bool = False

    @classmethod
    def named(cls, seed: int, name: str, frequency: float, octaves: int = 0, ridged: bool = False) -> Noise:
        """The field of a named stream; octaves of 0 is a plain field."""
        return cls(struct.unpack("<i", stream_bytes(seed, name, 4))[0], float(F(frequency)), octaves, ridged)

    def at(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
        x, y, z = (np.asarray(v, F) * F(self.frequency) for v in (x, y, z))
        r = (x + y + z) * TURN
        points = [r - x, r - y, r - z]
        if not self.octaves:
            return simplex(self.seed, points)
        share = whole = F(0.5)
        total = F(1)
        for _ in range(1, self.octaves):
            total, share = total + share, share * whole
        strength, out = F(1) / total, np.zeros(len(x), F)
        for k in range(self.octaves):
            one = simplex(_wrap(self.seed + k), points)
            out = out + (np.abs(one) * F(-2) + F(1) if self.ridged else one) * strength
            points, strength = [p * F(2) for p in points], strength * whole
        return out


def _wrap(seed: int) -> int:
    return (seed + (1 << 31)) % (1 << 32) - (1 << 31)


def radius(width: int) -> np.float32:
    """Of the cylinder on which a row of cells goes once around."""
    return F(width / math.tau)


#: Fixed values of single-precision sine and cosine as the common C library computes them, in doubles.
TURNS = float.fromhex("0x1.45f306dc9c883p-1")
QUARTER = float.fromhex("0x1.921fb54442d18p+0")
COSINE = tuple(map(float.fromhex, ("0x1p+0", "-0x1.ffffffd0c621cp-2", "0x1.55553e1068f19p-5", "-0x1.6c087e89a359dp-10", "0x1.99343027bf8c3p-16")))
SINE = tuple(map(float.fromhex, ("-0x1.555545995a603p-3", "0x1.1107605230bc4p-7", "-0x1.994eb3774cf24p-13")))


def sine_cosine(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of single-precision angles within some turns, to the last bit as exports were made with: about one in 50 differs from the correctly rounded value."""
    a = angle.astype(np.float64)
    quarter = np.floor(a * TURNS + 0.5)
    quarter[np.abs(angle) < F(math.pi / 4)] = 0
    x = a - quarter * QUARTER
    x2 = x * x
    s = (x + x * x2 * SINE[0]) + x * x2 * x2 * (SINE[1] + x2 * SINE[2])
    c = ((COSINE[0] + x2 * COSINE[1]) + x2 * x2 * COSINE[2]) + x2 * x2 * x2 * (COSINE[3] + x2 * COSINE[4])
    turn = quarter.astype(np.int64) & 3
    odd = (turn & 1).astype(bool)
    sine, cosine = np.where(odd, c, s), np.where(odd, s, c)
    return np.where(turn & 2, -sine, sine).astype(F), np.where((turn == 1) | (turn == 2), -cosine, cosine).astype(F)


def on_cylinder(noise: Noise, width: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The field at map positions (cells, not whole ones as they may be displaced), without a seam in x."""
    angle = ((np.asarray(x, F) + F(0.5)) / F(width)) * F(math.tau)
    sine, cosine = sine_cosine(angle)
    wide = radius(width)
    return noise.at(wide * cosine, np.asarray(y, F), wide * sine)


def octave_budget(most: int, wavelength: float, least_cells: int) -> int:
    """Octaves whose waves are at least so many cells long."""
    if least_cells == 0 or wavelength <= 0:
        return max(most, 1)
    ratio = F(wavelength) / F(least_cells)
    return int(min(max(math.floor(F(1) + np.log2(ratio)), 1), max(most, 1)))
