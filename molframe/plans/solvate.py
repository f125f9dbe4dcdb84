"""Solvation: the box, tiled water, overlap and potential, ion counts and spaced ion choice, numbering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.errors import require_none, violation
from molframe.functions.geometry import distance2, vec
from molframe.functions.mixing import splitmix64, unsigned_order
from molframe.functions.order import total_order_np
from molframe.operators import radius
from molframe.operators.radius import without_near
from molframe.options import BuildOptions
from molframe.plans.prepare import ForceField
from molframe.plans.system import System
from molframe.runtime import cut

# Edge of the water cell, ions a cubic nanometre at one mole a litre, distances.
CELL = 18.774349
PER_NM3 = 0.602214076
CLASH, SPACING, FLOOR = 2.4, 5.0, 0.5
WATER_ATOMS = [("O", "OW", 8, -0.834, 16.0), ("H1", "HW", 1, 0.417, 1.008), ("H2", "HW", 1, 0.417, 1.008)]
#: Rows of a tile of a sum over all pairs.
TILE = 4096


def box(atoms: DataFrame, padding: float) -> DataFrame:
    """(sid, box_x.., shift_x..): lengths, and the move that centres the solute."""
    ends = atoms.groupBy("sid").agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    sized = ends.select("*", *[(F.col(f"hi{a}") - F.col(f"lo{a}") + 2.0 * padding).alias(f"box_{a}") for a in "xyz"])
    return sized.select("sid", *[f"box_{a}" for a in "xyz"], *[(F.col(f"box_{a}") * 0.5 - (F.col(f"lo{a}") + F.col(f"hi{a}")) * 0.5).alias(f"shift_{a}") for a in "xyz"])


def tiles(boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """(sid, box_*, ix, iy, iz): cells that cover each box."""
    out = boxes
    for a in "xyz":
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(f"box_{a}") / cell).cast("int") - 1, F.lit(0)))))
    return out


def water_lattice(boxes: DataFrame, water_box: DataFrame, seed: int = 0) -> DataFrame:
    """Waters whose oxygen lies in the box: (sid, ix, iy, iz, w, x0..z2, tie). `water_box`: ord, x, y, z of one cell, three atoms a water."""
    low = water_box.agg(*[F.min(a).alias(a) for a in "xyz"]).first()
    molecules = water_box.withColumn("w", F.floor(F.col("ord") / 3).cast("int")).groupBy("w").agg(*[F.max(F.when(F.col("ord") % 3 == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in "xyz"])
    one = F.broadcast(molecules.groupBy().agg(F.collect_list(F.struct("*")).alias("cell")))  # one row, as large as one water cell
    spread = tiles(boxes).join(one).select("*", F.explode("cell").alias("m")).drop("cell")
    moved = spread.select("sid", *[f"box_{a}" for a in "xyz"], "ix", "iy", "iz", "m.w", *[(F.col(f"m.{a}{k}") + (F.col(f"i{a}") * CELL - low[a])).alias(f"{a}{k}") for k in range(3) for a in "xyz"])
    inside = moved.where(" AND ".join(f"{a}0 >= 0 AND {a}0 < box_{a}" for a in "xyz"))
    bits = lambda c, n: F.shiftleft(F.col(c).cast("long"), n)
    from molframe.functions.mixing import signed

    x = F.lit(signed(seed)).cast("long").bitwiseXOR(bits("ix", 48)).bitwiseXOR(bits("iy", 32)).bitwiseXOR(bits("iz", 16)).bitwiseXOR(F.col("w").cast("long"))
    return inside.select("sid", "ix", "iy", "iz", "w", *[f"{a}{k}" for k in range(3) for a in "xyz"], unsigned_order(splitmix64(x)).alias("tie"))


def ion_counts(boxes: DataFrame, charges: DataFrame, salt: float) -> DataFrame:
    """(sid, net, sodium, chloride): salt pairs by volume plus what makes the system neutral; halves round away from zero."""
    net = F.round("solute_charge").cast("long")
    pairs = F.round(F.lit(float(salt)) * PER_NM3 * (F.col("box_x") * F.col("box_y") * F.col("box_z") / 1000.0)).cast("long")
    j = boxes.join(charges, "sid").select("sid", net.alias("net"), pairs.alias("pairs"))
    zero = F.lit(0).cast("long")
    return j.select("sid", "net", (F.col("pairs") + F.greatest(-F.col("net"), zero)).alias("sodium"), (F.col("pairs") + F.greatest(F.col("net"), zero)).alias("chloride"))


def ion_schedule(sodium: int, chloride: int, net: int) -> list[bool]:
    """True for sodium: first the ions that neutralise, then pairs."""
    na, cl = max(-net, 0), max(net, 0)
    return [True] * na + [False] * cl + [True, False] * min(max(sodium - na, 0), max(chloride - cl, 0))


def choose_spaced(xyz: np.ndarray, potential: np.ndarray, tie: np.ndarray, schedule: list[bool], spacing: float = SPACING) -> list[int]:
    """One site an ion, in order: of the free sites by potential (in total order, rising for sodium, falling for chloride, then by tie) the first at least `spacing` from all chosen, else the first."""
    key = total_order_np(potential)
    rising, falling = np.lexsort((tie, key)), np.lexsort((tie, ~key))
    free, clear = np.ones(len(xyz), bool), np.ones(len(xyz), bool)
    out = []
    for sodium in schedule:
        order = rising if sodium else falling
        ok = order[free[order] & clear[order]]
        pick = int(ok[0] if len(ok) else order[free[order]][0])
        free[pick] = False
        clear &= ((xyz - xyz[pick]) ** 2).sum(1) >= spacing**2
        out.append(pick)
    return out


def site_potential(sites: DataFrame, charges: DataFrame, ident: str, part: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(part, ident, potential) of every site: the sum of charge / distance over the charges of its part, distances of FLOOR at least; 0 without any.

    Quadratic by definition. Sites and charges of a part are dealt over tiles of about `tile` rows each, by counts taken first, and a key is a
    pair of tiles, so a large part is many tasks of bounded size; the partial sums are then added up by site. Tiles of a large part are larger (`radius.tiles`)."""
    p = list(part)
    count = lambda df, name: df.groupBy(*p).agg(radius.tiles(F.count("*"), tile, max(tile, TILE)).alias(name))
    n = cut(count(sites, "__s").join(count(charges, "__c"), p)) if p else cut(count(sites, "__s").crossJoin(F.broadcast(count(charges, "__c"))))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    meet = (lambda df: df.join(n, p)) if p else (lambda df: df.crossJoin(F.broadcast(n)))
    own = meet(sites.select(*p, ident, "x", "y", "z")).withColumn("__a", F.pmod(F.xxhash64(ident), "__s").cast("int")).withColumn("__b", every("__c"))
    q = charges.select(*p, "charge", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    other = meet(q).withColumn("__b", F.pmod(F.xxhash64("qx", "qy", "qz", "charge"), "__c").cast("int")).withColumn("__a", every("__s"))
    term = F.col("charge") / F.greatest(F.sqrt(distance2(vec(), vec("q"))), F.lit(FLOOR))
    sums = own.drop("__s", "__c").join(other.drop("__s", "__c"), [*p, "__a", "__b"]).groupBy(*p, ident).agg(F.sum(term).alias("potential"))
    return sites.select(*p, ident).join(sums, [*p, ident], "left").withColumn("potential", F.coalesce("potential", F.lit(0.0)))


def solvate(s: System, ff: ForceField, options: BuildOptions | None = None, strict: bool = True) -> System:
    """The system centred in a box of water with ions; the input must be dry."""
    o = (options or BuildOptions()).validate()
    boxes = cut(box(s.atoms, o.padding_angstrom))
    shifted = s.atoms.join(boxes, "sid").withColumns({a: F.col(a) + F.col(f"shift_{a}") for a in "xyz"}).select(*s.atoms.columns)
    shifted = cut(shifted)
    water = ff.templates.atoms.where("family = 'water_box'").select("ord", "x", "y", "z")
    if water.count() % 3:
        raise ValueError("the water box holds atoms that make no whole molecule of three")
    sites = water_lattice(boxes, water, o.seed).withColumnsRenamed({f"{a}0": a for a in "xyz"}).withColumn("site", F.struct("ix", "iy", "iz", "w"))
    sites = sites.withColumn("key", F.concat_ws(",", "ix", "iy", "iz", "w"))
    free = cut(without_near(sites, shifted, CLASH, "key", ["sid"]))
    potential = site_potential(free, shifted, "key", ["sid"])
    numbered = free.join(potential, ["sid", "key"]).withColumn("idx", F.row_number().over(W.partitionBy("sid").orderBy("site")) - 1)
    numbered = cut(numbered.drop("site"))
    if o.add_ions:
        counts = ion_counts(boxes, s.charges().select("sid", "solute_charge"), o.salt_molar)
    else:
        counts = boxes.select("sid", *[F.lit(0).cast("long").alias(n) for n in ("net", "sodium", "chloride")])
    counts = cut(counts)
    have = numbered.groupBy("sid").agg(F.count("*").alias("n"))
    short = counts.join(have, "sid", "left").where(F.col("sodium") + F.col("chloride") > F.coalesce("n", F.lit(0)))
    bad = violation(short, "insufficient_solvent", F.col("sid"), F.format_string("%d ions are wanted and only %d waters are far enough from the solute", F.col("sodium") + F.col("chloride"), F.coalesce("n", F.lit(0))))
    if strict:
        require_none(bad)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        plan = ion_schedule(int(pdf["sodium"].iloc[0]), int(pdf["chloride"].iloc[0]), int(pdf["net"].iloc[0]))
        plan = plan[: len(pdf)]
        got = choose_spaced(pdf[["x", "y", "z"]].to_numpy(), pdf["potential"].to_numpy(), pdf["tie"].to_numpy(), plan)
        return pd.DataFrame({"sid": pdf["sid"].iloc[0], "idx": pdf["idx"].to_numpy()[got], "turn": np.arange(len(got)), "is_sodium": plan})

    asked = numbered.join(counts, "sid").where("sodium + chloride > 0").select("sid", "idx", "x", "y", "z", "potential", "tie", "net", "sodium", "chloride")
    ions = cut(asked.groupBy("sid").applyInPandas(pick, "sid string, idx int, turn long, is_sodium boolean"))
    waters = numbered.join(ions.select("sid", "idx"), ["sid", "idx"], "left_anti").withColumn("n", F.row_number().over(W.partitionBy("sid").orderBy("idx")) - 1)
    base = s.info.join(s.residues.groupBy("sid").agg(F.count("*").alias("residues")), "sid").select("sid", "solute_atoms", "residues", "components")
    waters = cut(waters.join(base, "sid"))
    tally = base.join(waters.groupBy("sid").agg(F.count("*").alias("nw")), "sid", "left").fillna(0, ["nw"])

    par = ff.parameters
    lj = {r.t: (r.radius, r.epsilon) for r in par.nonbonded.where(F.col("t").isin("OW", "HW")).collect()}
    oh = par.bonds.where("t1 = 'HW' AND t2 = 'OW'").first()
    hoh = par.angles.where("t1 = 'HW' AND t2 = 'OW' AND t3 = 'HW'").first()
    if len(lj) < 2 or oh is None or hoh is None:
        raise ValueError("the parameters lack water")
    at = F.col("solute_atoms") + 3 * F.col("n")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(t).alias("atom_type"), F.lit(e).alias("element"), F.lit(q).alias("charge"), F.lit(m).alias("mass"), F.lit(lj[t][0]).alias("radius"), F.lit(lj[t][1]).alias("epsilon"), *[F.col(a if k == 0 else f"{a}{k}").alias(a) for a in "xyz"]) for k, (n, t, e, q, m) in enumerate(WATER_ATOMS)])
    water_atoms = waters.select("sid", at.alias("base"), (F.col("residues") + F.col("n")).alias("residue"), F.explode(rows).alias("r"))
    water_atoms = water_atoms.select("sid", (F.col("base") + F.col("r.k")).alias("atom_idx"), "r.name", "r.atom_type", "r.element", "residue", "r.charge", "r.mass", "r.radius", "r.epsilon", "r.x", "r.y", "r.z")
    sites_of = ions.join(numbered.select("sid", "idx", "x", "y", "z"), ["sid", "idx"]).join(tally, "sid")
    mass = par.masses.select(F.col("t").alias("atom_type"), F.col("mass").alias("m"))
    kinds = ff.templates.atoms.where("family = 'ion' AND ord = 0 AND template IN ('Na+', 'Cl-')").select((F.col("template") == "Na+").alias("is_sodium"), "atom_type", "element", "charge")
    kinds = kinds.join(par.nonbonded.select(F.col("t").alias("atom_type"), "radius", "epsilon"), "atom_type", "left").join(mass, "atom_type", "left")
    ion_rows = sites_of.join(F.broadcast(kinds), "is_sodium").withColumn("name", F.when(F.col("is_sodium"), "NA").otherwise("CL"))
    ion_rows = cut(ion_rows.select("sid", "turn", "is_sodium", (F.col("solute_atoms") + 3 * F.col("nw") + F.col("turn")).alias("atom_idx"), "name", "atom_type", "element", (F.col("residues") + F.col("nw") + F.col("turn")).alias("residue"), "charge", F.coalesce("m", F.lit(0.0)).alias("mass"), "radius", "epsilon", "x", "y", "z", (F.col("components") + F.col("nw") + F.col("turn")).alias("component")))
    if strict:
        require_none(violation(ion_rows.where("radius IS NULL"), "missing_parameter", F.col("atom_type"), F.concat(F.lit("no parameter for nonbonded atom types "), "atom_type")))
    columns = s.atoms.columns
    atoms = shifted.unionByName(water_atoms.select(*columns)).unionByName(ion_rows.select(*columns))
    null = F.lit(None).cast("string").alias("icode")
    w_res = waters.select("sid", (F.col("residues") + F.col("n")).alias("residue"), F.lit("WAT").alias("name"), (F.col("residues") + F.col("n") + 1).cast("int").alias("number"), null, F.lit("W").alias("chain"), at.alias("first_atom"), F.lit(3).alias("atom_count"), (F.col("components") + F.col("n")).alias("component"))
    i_res = ion_rows.select("sid", "residue", "name", (F.col("residue") + 1).cast("int").alias("number"), null, F.lit("I").alias("chain"), F.col("atom_idx").alias("first_atom"), F.lit(1).alias("atom_count"), "component")
    residues = s.residues.unionByName(w_res).unionByName(i_res)
    bonds = s.bonds.unionByName(waters.select("sid", at.alias("i"), F.explode(F.array(at + 1, at + 2)).alias("j"), F.lit(oh.force).alias("force"), F.lit(oh.length).alias("length")))
    angles = s.angles.unionByName(waters.select("sid", (at + 1).alias("i"), at.alias("j"), (at + 2).alias("k"), F.lit(hoh.force).alias("force"), F.radians(F.lit(hoh.degrees)).alias("radians")))
    apart = F.array(*[F.struct((at + a).alias("i"), (at + b).alias("j")) for a in range(3) for b in range(3) if a != b])
    exclusions = s.exclusions.unionByName(waters.select("sid", F.explode(apart).alias("e")).select("sid", "e.i", "e.j"))
    placed = ion_rows.groupBy("sid").agg(F.count_if("is_sodium").alias("na"), F.count_if(~F.col("is_sodium")).alias("cl"))
    info = s.info.select("sid", "solute_atoms", "components").join(boxes, "sid").join(tally.select("sid", "nw"), "sid").join(placed, "sid", "left").fillna(0, ["na", "cl"])
    info = info.select("sid", "box_x", "box_y", "box_z", "solute_atoms", F.col("nw").alias("waters"), F.col("na").alias("sodium"), F.col("cl").alias("chloride"), (F.col("components") + F.col("nw") + F.col("na") + F.col("cl")).alias("components"))
    return replace(s, atoms=atoms, residues=residues, bonds=bonds, angles=angles, exclusions=exclusions, info=info, violations=s.violations.unionByName(bad)).kept()
