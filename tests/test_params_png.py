"""Parameters and pictures."""

import math
import struct
import zlib

import pytest

from tessera.functions import params as p
from tessera.sources.png import png_bytes


def test_defaults_and_steps():
    assert p.parameters("climate").steps() == {"temperature_offset_c": 0, "polar_amplification": 100, "latitude_exponent": 100, "humidity_offset": 30}
    assert p.parameters("hydrology").steps() == {"river_land_share_percent": 12}
    assert "power" not in p.parameters("terrain", {"erosion_enabled": False}).steps()
    assert p.parameters("terrain", {"power": 0.005}).steps()["power"] == 0


def test_large_droplet_counts_do_not_fit():
    with pytest.raises(p.ParameterError):
        p.parameters("terrain", {"droplets_per_hundred_cells": 400}).steps()


@pytest.mark.parametrize("bad", [{"nope": 1}, {"land_ratio": 0.99}, {"land_ratio": math.nan}, {"land_ratio": "x"}, {"min_feature_cells": 0}, {"erosion_enabled": 1}])
def test_bad_settings(bad):
    with pytest.raises(p.ParameterError):
        p.parameters("terrain", bad)


def test_toml_and_versions():
    assert p.from_toml("terrain", "land_ratio = 0.4").steps()["land_ratio"] == 40
    assert [p.params_version(*x) for x in ((1, 0, 1), (0, 1, 1), (0, 0, 1), (0, 0, 0))] == [6, 3, 1, 0]


def test_half_to_even():
    assert [p.quantize(v, 1.0) for v in (0.5, 1.5, 2.5, -0.5, -1.5, 2.4, 2.6)] == [0, 2, 2, 0, -2, 2, 3]


def test_png():
    data = png_bytes(2, 1, bytes([1, 2, 3, 4, 5, 6]))
    assert data.startswith(b"\x89PNG") and struct.unpack(">II", data[16:24]) == (2, 1)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == b"\0\1\2\3\4\5\6"
