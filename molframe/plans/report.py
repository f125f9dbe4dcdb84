"""Reports: one row a structure with hashes, decisions, warnings, counts, charges and the box."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.errors import MolframeError, require_none
from molframe.options import BuildOptions
from molframe.plans.prepare import ForceField, kept_residues, parameterize, unsupported
from molframe.plans.solvate import solvate
from molframe.plans.system import System
from molframe.sources import pdb


def _listed(df: DataFrame, value, out: str, order=()) -> DataFrame:
    return df.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, value.alias("v")))), lambda x: x["v"]).alias(out))


def report(docs: DataFrame, p: pdb.ParsedPdb, s: System | None, options: BuildOptions, decisions: DataFrame | None = None, unsupported_rows: DataFrame | None = None) -> DataFrame:
    """Rows of reports of prepared systems `s`, or of inspected structures without one."""
    out = docs.select("sid", F.sha2(F.col("text").cast("binary"), 256).alias("input_sha256"))
    o = {k: v for k, v in dataclasses.asdict(options).items() if k not in ("protonation", "altloc")}
    out = out.withColumn("options", F.struct(*[F.lit(v).alias(k) for k, v in o.items()], F.lit(options.altloc).cast("string").alias("altloc"), (F.create_map(*[F.lit(x) for kv in options.protonation.items() for x in kv]) if options.protonation else F.create_map().cast("map<string,string>")).alias("protonation")))
    out = out.withColumn("selected_model", F.lit(options.model)).join(p.chains(), "sid", "left")
    out = out.join(p.residues.groupBy("sid").agg(F.count("*").alias("residues_read")), "sid", "left")
    decisions = s.decisions if s is not None else decisions
    warnings = s.warnings if s is not None else p.warnings
    pairs = [(_listed(decisions, F.concat("selector", F.lit("="), "state"), "protonation_decisions", ["residue_idx"]) if decisions is not None else None), _listed(warnings, F.struct("code", "message"), "warnings"), (_listed(unsupported_rows, F.col("reference"), "unsupported_residues", ["residue_idx"]) if unsupported_rows is not None else None)]
    for t in pairs:
        if t is not None:
            out = out.join(t, "sid", "left")
    if s is not None:
        missing = _listed(s.violations.where("code = 'missing_heavy_atoms'"), F.col("message"), "missing_heavy_atoms")
        n = s.atoms.groupBy("sid").agg(F.count("*").alias("total_atoms"))
        r = s.residues.groupBy("sid").agg(F.count("*").alias("residues"))
        for t in (missing, n, r, s.info.drop("components"), s.charges()):
            out = out.join(t, "sid", "left")
        out = out.withColumn("box_angstrom", F.array("box_x", "box_y", "box_z")).drop("box_x", "box_y", "box_z")
    return out


def inspect(docs: DataFrame, ff: ForceField, options: BuildOptions | None = None) -> DataFrame:
    """Reports without solvation. Structures with unsupported residues are not parameterised; missing heavy atoms become a line, any other problem is raised."""
    o = (options or BuildOptions()).validate()
    p = pdb.parse(docs, o, strict=True)
    odd = unsupported(p, ff.templates)
    skip = odd.select("sid").distinct()
    fine = pdb.ParsedPdb(*[t.join(skip, "sid", "left_anti") for t in (p.atoms, p.residues, p.conect, p.links, p.ssbonds)], p.warnings, p.violations)
    _, decisions, _, _ = kept_residues(p, o)
    if fine.residues.isEmpty():
        return report(docs, p, None, o, decisions, odd)
    s = parameterize(fine, ff, o, strict=False)
    require_none(s.violations.where("code <> 'missing_heavy_atoms'").join(s.violations.where("code = 'missing_heavy_atoms'").select("sid").distinct(), "sid", "left_anti"))
    return report(docs, p, s, o, decisions, odd)


def prepare(docs: DataFrame, ff: ForceField, options: BuildOptions | None = None) -> tuple[System, DataFrame]:
    """(systems, reports) of structures `docs` (sid, text); the first problem is raised."""
    o = (options or BuildOptions()).validate()
    p = pdb.parse(docs, o, strict=True)
    if p.residues.isEmpty():
        raise MolframeError("invalid_pdb", "nothing but hydrogen, or nothing, is in the model")
    s = parameterize(p, ff, o)
    if o.add_water:
        s = solvate(s, ff, o)
    return s, report(docs, p, s, o)
