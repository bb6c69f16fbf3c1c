"""Command line: python -m voxlattice second_level MAPS [options]."""

from __future__ import annotations

import argparse
import dataclasses
import sys

from .plans.group_analysis import Settings, group_analysis


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("voxlattice")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("second_level", help="group analysis of a folder, a table or a list of volumes")
    c.add_argument("maps", nargs="+")
    c.add_argument("--out-dir")
    c.add_argument("--brain-mask", help="path of the default mask")
    c.add_argument("--template", help="path of the template volume")
    for f in dataclasses.fields(Settings):
        if f.name == "templates":
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            c.add_argument(flag, action=argparse.BooleanOptionalAction, default=f.default)
        else:
            kind = float if "float" in f.type else int if "int" in f.type else str
            c.add_argument(flag, type=kind, default=f.default)
    return p


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = vars(parser().parse_args(argv))
    args.pop("command")
    maps = args.pop("maps")
    templates = {k: v for k, v in (("brain_mask", args.pop("brain_mask")), ("template", args.pop("template"))) if v}
    out_dir = args.pop("out_dir")
    if str(args["height_control"]).lower() == "none":
        args["height_control"] = None
    spark = SparkSession.builder.appName("voxlattice").getOrCreate()
    group_analysis(spark, maps[0] if len(maps) == 1 else maps, out_dir, Settings(**args, templates=templates)).drop("used_map_paths").show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
