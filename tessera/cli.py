"""Command line: dump a world to a file, validate a file, render pictures (python -m tessera.cli)."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions.params import ParameterError, from_toml
from tessera.sources.world_file import WorldError, from_bytes
from tessera.stages import pipeline
from tessera.stages.export import write_world
from tessera.stages.partition import WaterSplit, land_components
from tessera.stages.render import LAYERS, render
from tessera.stages.world import GridWorld, StageError, from_world

SHOWN = 12


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera", description="Worlds on a grid of cells.")
    commands = parser.add_subparsers(dest="command", required=True)

    def build(p: argparse.ArgumentParser) -> None:
        p.add_argument("--width", type=int, default=pipeline.WIDTH)
        p.add_argument("--grid-height", type=int, default=pipeline.HEIGHT)
        p.add_argument("--land-count", type=int, default=pipeline.LAND)
        water = p.add_mutually_exclusive_group()
        water.add_argument("--water-count", type=int, default=pipeline.WATER)
        water.add_argument("--water-cells", type=int, help="cells that a water territory has, about; instead of their count")
        p.add_argument("--config", type=Path, help="TOML settings of the climate stage")
        p.add_argument("--hydrology-config", type=Path)
        p.add_argument("--terrain-config", type=Path)

    draw = commands.add_parser("render", help="write one PNG a layer, {out}.{layer}.png")
    source = draw.add_mutually_exclusive_group(required=True)
    source.add_argument("--seed", type=int)
    source.add_argument("--input", type=Path)
    build(draw)
    draw.add_argument("--out", default="map")
    draw.add_argument("--no-climate", action="store_true")
    draw.add_argument("--zoom", type=int, default=1, choices=range(1, 17))
    dump = commands.add_parser("dump", help="make a world and write it to a file")
    dump.add_argument("--seed", type=int, required=True)
    build(dump)
    dump.add_argument("--out", type=Path, required=True)
    check = commands.add_parser("validate", help="check a file and print what it holds")
    check.add_argument("--input", type=Path, required=True)
    return parser


def made(spark: SparkSession, a: argparse.Namespace, with_climate: bool = True) -> GridWorld:
    if not 0 <= a.seed < 1 << 64:
        raise StageError("a seed is a whole number of 64 bits, without a sign")
    read = lambda stage, path: from_toml(stage, path.read_text()) if path else None
    split = WaterSplit(cells=a.water_cells) if a.water_cells is not None else WaterSplit(count=a.water_count)
    return pipeline.build_world(spark, a.seed, a.width, a.grid_height, a.land_count, split, read("terrain", a.terrain_config), read("climate", a.config), read("hydrology", a.hydrology_config), with_climate)


def summary(spark: SparkSession, path: Path) -> str:
    w = from_bytes(path.read_bytes())
    world = from_world(spark, w)
    share = world.cells.agg(F.avg(F.when(F.col("is_water"), 0.0).otherwise(100.0))).first()[0] or 0.0
    sizes = [r.territories for r in land_components(world).orderBy(F.desc("territories"), "component").limit(SHOWN + 1).collect()] if w.territories else []
    count = land_components(world).count() if w.territories else 0
    return (
        f"valid export {path}: {w.width}×{w.height} cells, {len(w.territories)} territories, {len(w.regions)} regions, {len(w.water_bodies)} water bodies, "
        f"{len(w.rivers)} rivers; seed {w.seed:#018x}, params version {w.params_version}\n"
        f"land {share:.1f}% of cells; {count} land component(s): {', '.join(map(str, sizes[:SHOWN]))}{', …' if count > SHOWN else ''}"
    )


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; errors of input are printed and give 1."""
    a = arguments().parse_args(argv)
    if spark is None:
        from tessera.session import local_session

        spark = local_session("*", "tessera-cli")
    try:
        if a.command == "validate":
            print(summary(spark, a.input))
        elif a.command == "dump":
            began = time.time()
            world = made(spark, a)
            write_world(world, str(a.out.resolve()))
            print(f"world written to {a.out} ({world.width * world.height} cells, {world.territories.count()} territories, pipeline {time.time() - began:.2f} s)")
        else:
            if a.no_climate and a.config:
                raise ParameterError("--no-climate doesn't go with --config")
            world = from_world(spark, from_bytes(a.input.read_bytes())) if a.input else made(spark, a, not a.no_climate)
            written = render(world, a.out, a.zoom)
            for name in LAYERS:
                if name not in written:
                    print(f"warning: layer '{name}' skipped (section absent from the world)", file=sys.stderr)
            print(f"{len(written)} layer(s) written")
    except (OSError, WorldError, StageError, ParameterError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
