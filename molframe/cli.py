"""Command line: `inspect` prints reports, `prepare` writes bundles.

Force-field files are given by path: --template FAMILY=FILE (.off/.lib or .prep) and --parameters
KIND=FILE (legacy or frcmod), each as often as needed, in load order.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from molframe.errors import MolframeError
from molframe.options import BuildOptions, parse_override
from molframe.plans.prepare import ForceField
from molframe.plans.report import inspect, prepare
from molframe.runtime import cut
from molframe.sinks.bundle import places, write_bundles
from molframe.sources import parameters, pdb
from molframe.sources.templates import Templates, overlaid, read_off, read_prep


def _pair(text: str) -> tuple[str, str]:
    a, sign, b = text.partition("=")
    if not (a and sign and b):
        raise argparse.ArgumentTypeError("expected NAME=FILE")
    return a, b


def force_field(spark: SparkSession, templates: list[tuple[str, str]], params: list[tuple[str, str]]) -> ForceField:
    read = [(read_prep if f.endswith(".prep") else read_off)(spark, family, Path(f).read_text()) for family, f in templates]
    t = overlaid(read)
    return ForceField(Templates(cut(t.atoms), cut(t.bonds)), parameters.load(spark, [(kind, Path(f).read_text()) for kind, f in params]))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="molframe", description="Prepare molecular systems with Spark")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "prepare"):
        c = sub.add_parser(name)
        c.add_argument("input", nargs="+")
        c.add_argument("--config")
        c.add_argument("--model", type=int)
        c.add_argument("--altloc")
        c.add_argument("--protonation", type=parse_override, action="append", default=[])
        c.add_argument("--template", type=_pair, action="append", required=True)
        c.add_argument("--parameters", type=_pair, action="append", required=True)
        if name == "prepare":
            c.add_argument("-o", "--output", required=True)
            c.add_argument("--padding", type=float)
            c.add_argument("--salt", type=float)
            c.add_argument("--seed", type=int)
            for flag in ("--no-water", "--no-ions", "--overwrite"):
                c.add_argument(flag, action="store_true")
    return top


def options(a: argparse.Namespace) -> BuildOptions:
    base = BuildOptions.from_file(a.config) if a.config else BuildOptions()
    extra = {k: getattr(a, k) for k in ("padding", "salt", "seed", "no_water", "no_ions", "overwrite")} if a.command == "prepare" else {}
    return base.overridden(model=a.model, altloc=a.altloc, protonation=dict(a.protonation), **extra)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        o = options(a).validate()
        spark = spark or SparkSession.builder.appName("molframe").getOrCreate()
        ff = force_field(spark, a.template, a.parameters)
        docs = cut(pdb.read_texts(spark, a.input))
        if a.command == "inspect":
            for r in inspect(docs, ff, o).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                print(r.j)
        else:
            places(a.output, [r.sid for r in docs.select("sid").collect()], o.overwrite)
            s, reports = prepare(docs, ff, o)
            write_bundles(s, reports, a.output, o.overwrite)
            for r in s.info.join(s.atoms.groupBy("sid").agg(F.count("*").alias("n")), "sid").orderBy("sid").toLocalIterator():
                print(f"Prepared {r.sid}: {r.n} atoms ({r.waters} waters, {r.sodium} Na+, {r.chloride} Cl-) in {a.output}")
    except MolframeError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
