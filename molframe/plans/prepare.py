"""Preparation: residues are renamed, matched with templates and completed; bonds are found, topology is
enumerated and parameters attached. Many structures run at once; every join carries `sid`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.errors import require_none, violation
from molframe.functions.geometry import distance2, vec
from molframe.operators import graph
from molframe.operators.lookup import IMPROPER, PROPER, containing_set, either_direction, pair_lookup, wildcard_lookup
from molframe.operators.radius import nearest, radius_join, radius_pairs
from molframe.operators.relational import end_flags, missing_from, with_neighbour
from molframe.options import BuildOptions
from molframe.plans.hydrogens import place_hydrogens
from molframe.plans.system import System
from molframe.runtime import cut
from molframe.schema import CROSS_BONDS, FREE_IONS, GLYCOSYLATED, MASSES, PROTEIN, SUGAR_ENDINGS, WATER
from molframe.sources.parameters import Parameters
from molframe.sources.pdb import ParsedPdb
from molframe.sources.templates import Templates

KEY = ["sid", "chain", "number", "icode"]


@dataclass
class ForceField:
    """Families of templates: central, n_terminal, c_terminal, glycan, ion, water_box."""

    templates: Templates
    parameters: Parameters


def protein() -> Column:
    return F.col("name").isin(PROTEIN)


def selector() -> Column:
    """CHAIN:NUMBER[CODE]."""
    return F.concat(F.col("chain"), F.lit(":"), F.col("number").cast("string"), F.coalesce("icode", F.lit("")))


def reference() -> Column:
    """CHAIN/NAME/NUMBER and the code or a blank, as reports name a residue."""
    return F.concat(F.col("chain"), F.lit("/"), F.col("name"), F.lit("/"), F.col("number").cast("string"), F.coalesce("icode", F.lit(" ")))


def same_residue(a: DataFrame, b: DataFrame, chain: str, number: str, icode: str) -> Column:
    """b's residue is the one that columns of a name; codes compare null-safe."""
    return (a["sid"] == b["sid"]) & (a[chain] == b["chain"]) & (a[number] == b["number"]) & a[icode].eqNullSafe(b["icode"])


def histidine_states(p: ParsedPdb, options: BuildOptions) -> DataFrame:
    """(sid, residue_idx, selector, state): an override, else HID if the nearest O, N or S of ND1 is nearer than that of NE2 by over 0.04 in squared distance, else HIE. Water counts, the atom itself does not."""
    his = p.residues.where("name = 'HIS'").withColumn("selector", selector())
    acceptors = p.atoms.where(F.col("element").isin("O", "N", "S")).select("sid", "serial", "x", "y", "z")
    own = p.atoms.where(F.col("name").isin("ND1", "NE2")).join(his.select("sid", "residue_idx"), ["sid", "residue_idx"])
    source = own.select("sid", "residue_idx", F.col("name").alias("atom"), "serial", "x", "y", "z")
    near = nearest(source, acceptors.toDF("sid", "other", "x", "y", "z"), "serial", "other", 4.0, ["sid"]).select("sid", "serial", "d2")
    far = source.join(near, ["sid", "serial"], "left_anti")
    other = acceptors.toDF("sid", "o", "ox", "oy", "oz")
    wide = far.join(other, "sid").where("serial <> o").groupBy("sid", "serial").agg(F.min(distance2(vec(), vec("o"))).alias("d2"))
    d2 = source.join(near.unionByName(wide), ["sid", "serial"])
    pick = lambda n: F.min(F.when(F.col("atom") == n, F.col("d2")))
    both = d2.groupBy("sid", "residue_idx").agg(pick("ND1").alias("nd"), pick("NE2").alias("ne"))
    out = his.join(both, ["sid", "residue_idx"], "left")
    never = F.lit(float("inf"))
    state = F.when(F.coalesce("nd", never) + 0.04 < F.coalesce("ne", never), "HID").otherwise("HIE")
    if options.protonation:
        given = F.create_map(*[F.lit(x) for kv in options.protonation.items() for x in kv])
        state = F.coalesce(F.try_element_at(given, F.col("selector")), state)
    return out.select("sid", "residue_idx", "selector", state.alias("state"))


def declared_ends(p: ParsedPdb) -> DataFrame:
    """(sid, ord, side, chain, number, atom): ends of declared bonds in order, CONECT (by serials) before LINK."""
    at = p.atoms.groupBy("sid", "serial").agg(F.max_by(F.struct("chain", "number", F.col("name").alias("atom")), "pos").alias("e"))
    one, two = at.select("sid", F.col("serial").alias("a"), F.col("e").alias("e1")), at.select("sid", F.col("serial").alias("b"), F.col("e").alias("e2"))
    con = p.conect.join(one, ["sid", "a"]).join(two, ["sid", "b"]).select("sid", F.struct(F.lit(0).alias("k"), "a", "b").alias("ord"), "e1", "e2")
    lnk = p.links.select("sid", F.struct(F.lit(1).alias("k"), F.col("ord").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), F.struct(F.col("chain1").alias("chain"), F.col("number1").alias("number"), F.col("atom1").alias("atom")).alias("e1"), F.struct(F.col("chain2").alias("chain"), F.col("number2").alias("number"), F.col("atom2").alias("atom")).alias("e2"))
    both = con.unionByName(lnk)
    return both.select("sid", "ord", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("e1").alias("e"), F.col("e2").alias("o")), F.struct(F.lit(1).alias("side"), F.col("e2").alias("e"), F.col("e1").alias("o")))).alias("x")).select("sid", "ord", "x.side", "x.e.chain", "x.e.number", "x.e.atom", F.col("x.o").alias("other"))


def kept_residues(p: ParsedPdb, options: BuildOptions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(residues with their final names, decisions, ends of declared bonds, warnings); water and free ions go."""
    solvent = F.col("name").isin(WATER) | F.upper("name").isin(FREE_IONS)
    decisions, ends = cut(histidine_states(p, options)), cut(declared_ends(p))
    r = p.residues.where(~solvent).withColumn("residue", F.row_number().over(W.partitionBy("sid").orderBy("residue_idx")) - 1)
    warnings = violation(p.residues.where(solvent), "existing_solvent_removed", F.col("residue_idx"), reference())
    warnings = warnings.unionByName(violation(decisions, "histidine_state_inferred", F.col("residue_idx"), F.concat("selector", F.lit(" selected as "), "state")))
    r = r.join(decisions.select("sid", "residue_idx", "state"), ["sid", "residue_idx"], "left").withColumn("name", F.coalesce("state", "name")).drop("state")
    first = ends.groupBy("sid", "chain", "number").agg(F.min_by("atom", F.struct("ord", "side")).alias("attached"))
    r = r.join(first, ["sid", "chain", "number"], "left")
    renamed = F.coalesce(*[F.when((F.col("name") == n) & (F.col("attached") == a), F.lit(to)) for n, a, to in GLYCOSYLATED])
    warnings = warnings.unionByName(violation(r.where(renamed.isNotNull()), "glycan_name_normalized", F.col("residue_idx"), F.concat(reference(), F.lit(" -> "), renamed)))
    r = r.withColumn("name", F.coalesce(renamed, F.col("name"))).drop("attached")
    sulfur = p.atoms.where("name = 'SG'").join(r.where("name = 'CYS'").select("sid", "residue_idx"), ["sid", "residue_idx"]).select("sid", "residue_idx", "x", "y", "z")
    pairs = radius_pairs(sulfur, 2.3, "residue_idx", ["sid"])
    near = pairs.select("sid", F.explode(F.array("i", "j")).alias("residue_idx")).distinct().withColumn("near", F.lit(True))
    said = p.ssbonds.select("sid", F.explode(F.array(*[F.struct(F.col(f"chain{k}").alias("chain"), F.col(f"number{k}").alias("number"), F.col(f"icode{k}").alias("icode")) for k in (1, 2)])).alias("e")).select("sid", "e.*").distinct()
    r = r.join(near, ["sid", "residue_idx"], "left")
    said = said.select(*[F.col(c).alias(f"s_{c}") for c in KEY], F.lit(True).alias("said"))
    r = r.join(said, (r["sid"] == F.col("s_sid")) & (r["chain"] == F.col("s_chain")) & (r["number"] == F.col("s_number")) & r["icode"].eqNullSafe(F.col("s_icode")), "left").drop(*[f"s_{c}" for c in KEY])
    bridged = (F.col("name") == "CYS") & (F.coalesce("near", F.lit(False)) | F.coalesce("said", F.lit(False)))
    r = r.withColumn("name", F.when(bridged, "CYX").otherwise(F.col("name"))).drop("near", "said")
    flags = end_flags(r.where(protein()).select("sid", "chain", "residue"), ["sid", "chain"], ["residue"], "n_terminal", "c_terminal").drop("chain")
    r = r.join(flags, ["sid", "residue"], "left").fillna(False, ["n_terminal", "c_terminal"])
    return r.select("sid", "residue", "residue_idx", "chain", "number", "icode", "name", "n_terminal", "c_terminal"), decisions, ends, warnings


def resolve_templates(r: DataFrame, p: ParsedPdb, ends: DataFrame, t: Templates) -> tuple[DataFrame, DataFrame]:
    """(residues with family and template, warnings). Proteins by name and end; glycans by name or by their atoms and links."""
    have = t.atoms.select("family", "template").distinct()
    mapped = F.when(F.col("name") == "HIS", "HIE").otherwise(F.col("name"))
    family = F.when(protein(), F.when(F.col("n_terminal"), "n_terminal").when(F.col("c_terminal"), "c_terminal").otherwise("central")).otherwise("glycan")
    prefix = F.when(F.col("family") == "n_terminal", F.concat(F.lit("N"), "mapped")).when(F.col("family") == "c_terminal", F.concat(F.lit("C"), "mapped"))
    r = r.withColumn("family", family).withColumn("mapped", mapped).withColumn("longer", prefix)
    one, two = have.select("family", F.col("template").alias("mapped"), F.col("template").alias("t1")), have.select("family", F.col("template").alias("longer"), F.col("template").alias("t2"))
    r = r.join(F.broadcast(one), ["family", "mapped"], "left").join(F.broadcast(two), ["family", "longer"], "left").withColumn("template", F.coalesce("t1", "t2"))

    sugars = [(c, e) for c, es in SUGAR_ENDINGS.items() for e in es]
    spark = r.sparkSession
    codes = spark.createDataFrame(sugars, "code string, ending string")
    open_ = r.where("family = 'glycan' AND template IS NULL").select("sid", "residue", "residue_idx", "chain", "number", "name")
    heavy = p.atoms.where(~F.col("element").isin("H", "D")).groupBy("sid", "residue_idx").agg(F.collect_set("name").alias("members"))
    foreign = (F.col("chain") != F.col("other.chain")) | (F.col("number") != F.col("other.number"))
    spot = F.when(F.col("atom").startswith("O") & foreign, F.expr("substring(atom, 2)").try_cast("int"))
    linked = ends.groupBy("sid", "chain", "number").agg(F.collect_set(spot).alias("linked"))
    asked = open_.join(heavy, ["sid", "residue_idx"]).join(linked, ["sid", "chain", "number"], "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<int>")))
    position = F.when((F.col("atom_type") == "Os") & F.col("name").startswith("O"), F.expr("substring(name, 2)").try_cast("int"))
    sets = t.atoms.where("family = 'glycan'").groupBy("template").agg(F.collect_set(F.when(F.col("element") != 1, F.col("name"))).alias("set_members"), F.collect_set(F.when(position != 5, position)).alias("substituted"))
    fits = sets.join(F.broadcast(codes), F.col("template").endswith(F.col("ending"))).select("code", "template", "set_members", "substituted")
    cost = F.size(F.array_except("substituted", "linked")) + F.size(F.array_except("linked", "substituted"))
    tagged = asked.withColumn("members", F.concat(F.array(F.concat(F.lit("#"), "name")), "members"))
    sets2 = fits.select(F.col("template"), F.concat(F.array(F.concat(F.lit("#"), "code")), "set_members").alias("set_members"), "substituted")
    got = containing_set(tagged, ["sid", "residue"], "members", sets2, "template", "set_members", cost, ["linked"]).select("sid", "residue", F.col("template").alias("t3"))
    r = r.join(got, ["sid", "residue"], "left")
    warnings = violation(r.where("t3 IS NOT NULL AND template IS NULL"), "glycan_name_normalized", F.col("residue_idx"), F.concat(reference(), F.lit(" -> "), "t3"))
    return r.withColumn("template", F.coalesce("template", "t3")).drop("mapped", "longer", "t1", "t2", "t3"), warnings


def amide_hydrogens(r: DataFrame, p: ParsedPdb, t: Templates) -> DataFrame:
    """(sid, residue, ax, ay, az): H of a peptide nitrogen, opposite the bisector of its bonds to the carbon before and to CA, at the template's length."""
    spots = p.atoms.where(F.col("name").isin("N", "CA", "C")).join(r.where(protein()).select("sid", "residue_idx", "residue", F.col("chain").alias("rc"), "family", "template"), ["sid", "residue_idx"])
    one = lambda n, tag: spots.where(F.col("name") == n).select("sid", "residue", *[F.col(a).alias(f"{tag}{a}") for a in "xyz"])
    nitrogen = spots.where("name = 'N'").select("sid", "residue", "rc", "family", "template", *[F.col(a).alias(f"n{a}") for a in "xyz"])
    before = spots.where("name = 'C'").select("sid", (F.col("residue") + 1).alias("residue"), "rc", *[F.col(a).alias(f"c{a}") for a in "xyz"])
    geometry = t.atoms.where(F.col("name").isin("H", "N")).groupBy("family", "template").agg(*[F.max(F.when(F.col("name") == n, F.col(a))).alias(f"t{n}{a}") for n in ("H", "N") for a in "xyz"])
    j = nitrogen.join(before, ["sid", "residue", "rc"]).join(one("CA", "a"), ["sid", "residue"]).join(F.broadcast(geometry), ["family", "template"])
    n, c, a = vec("n"), vec("c"), vec("a")
    unit = lambda v: tuple(x / F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]) for x in v)
    to_c, to_a = unit(tuple(x - y for x, y in zip(c, n))), unit(tuple(x - y for x, y in zip(a, n)))
    away = unit(tuple(-x - y for x, y in zip(to_c, to_a)))
    length = F.sqrt(distance2(vec("tH"), vec("tN")))
    near = (distance2(n, c) <= 4.0) & (distance2(n, c) > 1e-16) & (distance2(n, a) > 1e-16)
    return j.where(near & F.col("tHx").isNotNull()).select("sid", "residue", *[(x + d * length).alias(f"a{k}") for x, d, k in zip(n, away, "xyz")])


def match_atoms(r: DataFrame, p: ParsedPdb, t: Templates) -> tuple[DataFrame, DataFrame]:
    """(atoms in template order with what the input gives, violations): missing and surplus heavy atoms, unresolved residues."""
    bad = violation(r.where("template IS NULL"), "unsupported_residue", F.col("residue_idx"), F.concat(F.lit("unsupported residue "), reference(), F.lit(": no template")))
    dim = t.atoms.select("family", "template", "ord", F.col("name").alias("atom_name"), "atom_type", F.col("element").alias("number_of"), "charge", *[F.col(a).alias(f"t{a}") for a in "xyz"])
    wanted = r.where("template IS NOT NULL").join(F.broadcast(dim), ["family", "template"])
    given = p.atoms.select("sid", "residue_idx", F.col("name").alias("atom_name"), "serial", "x", "y", "z", F.lit(True).alias("there"))
    both = cut(wanted.join(given, ["sid", "residue_idx", "atom_name"], "left"))
    gone = both.where("there IS NULL AND number_of <> 1").groupBy("sid", "residue_idx", reference().alias("ref")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "atom_name"))), lambda s: s["atom_name"]), ", ").alias("names"))
    bad = bad.unionByName(violation(gone, "missing_heavy_atoms", F.col("residue_idx"), F.concat("ref", F.lit(" lacks these atoms of its template: "), "names")))
    heavy = p.atoms.where(~F.col("element").isin("H", "D")).select("sid", "residue_idx", F.col("name").alias("atom_name"))
    extra = missing_from(heavy, wanted, ["sid", "residue_idx", "atom_name"]).join(r.where("template IS NOT NULL"), ["sid", "residue_idx"])
    bad = bad.unionByName(violation(extra, "unsupported_residue", F.col("residue_idx"), F.concat(F.lit("unsupported residue "), reference(), F.lit(": heavy atom "), "atom_name", F.lit(" is not present in template "), "template")))
    return both, bad


def find_bonds(atoms: DataFrame, r: DataFrame, p: ParsedPdb, t: Templates) -> DataFrame:
    """Canonical bonds (sid, i, j): template, peptide, declared, inferred across residues, disulfides."""
    at = atoms.select("sid", "residue", "name", "atom_idx", "x", "y", "z")
    inside = atoms.select("sid", "residue", "family", "template", F.col("ord"), "atom_idx")
    tb = t.bonds.select("family", "template", "a", "b")
    template = r.where("template IS NOT NULL").select("sid", "residue", "family", "template").join(F.broadcast(tb), ["family", "template"])
    ends = inside.select("sid", "residue", "ord", "atom_idx")
    template = template.join(ends.select("sid", "residue", F.col("ord").alias("a"), F.col("atom_idx").alias("i")), ["sid", "residue", "a"]).join(ends.select("sid", "residue", F.col("ord").alias("b"), F.col("atom_idx").alias("j")), ["sid", "residue", "b"])
    prot = r.where(protein()).select("sid", "residue", "chain")
    follow = with_neighbour(prot, ["sid", "chain"], ["residue"], {"residue": "next"}).where("next = residue + 1")
    c = at.where("name = 'C'").join(follow, ["sid", "residue"]).select("sid", F.col("next").alias("residue"), "chain", F.col("atom_idx").alias("i"), *[F.col(a).alias(f"c{a}") for a in "xyz"])
    n = at.where("name = 'N'").join(prot, ["sid", "residue"]).select("sid", "residue", "chain", F.col("atom_idx").alias("j"), "x", "y", "z")
    peptide = c.join(n, ["sid", "residue", "chain"]).where(distance2(vec(), vec("c")) <= 4.0)
    serial = atoms.where("serial IS NOT NULL").groupBy("sid", "serial").agg(F.max("atom_idx").alias("atom_idx"))
    conect = p.conect.join(serial.toDF("sid", "a", "i"), ["sid", "a"]).join(serial.toDF("sid", "b", "j"), ["sid", "b"])
    place = r.groupBy(*KEY).agg(F.min("residue").alias("residue"))

    def end(df: DataFrame, k: int, out: str) -> DataFrame:
        q = place.select(*[F.col(x).alias(f"q_{x}") for x in KEY], F.col("residue").alias(f"res{k}"))
        df = df.join(q, (df["sid"] == F.col("q_sid")) & (df[f"chain{k}"] == F.col("q_chain")) & (df[f"number{k}"] == F.col("q_number")) & df[f"icode{k}"].eqNullSafe(F.col("q_icode"))).drop(*[f"q_{x}" for x in KEY])
        return df.join(at.select("sid", F.col("residue").alias(f"res{k}"), F.col("name").alias(f"atom{k}"), F.col("atom_idx").alias(out)), ["sid", f"res{k}", f"atom{k}"])

    links = end(end(p.links, 1, "i"), 2, "j")
    ss = p.ssbonds.withColumn("atom1", F.lit("SG")).withColumn("atom2", F.lit("SG"))
    ss = end(end(ss, 1, "i"), 2, "j")
    spark = atoms.sparkSession
    names = spark.createDataFrame([(a, b, c) for x, y, c in CROSS_BONDS for a, b in {(x, y), (y, x)}], "l_name string, r_name string, cutoff double")
    may = at.where(F.col("name").isin(sorted({n for x, y, _ in CROSS_BONDS for n in (x, y)})))
    near = radius_join(may, may, max(c for *_, c in CROSS_BONDS), ["sid"]).where("l_residue < r_residue")
    cross = near.join(F.broadcast(names), ["l_name", "r_name"]).where(F.col("d2") <= F.col("cutoff") * F.col("cutoff")).select("sid", F.col("l_atom_idx").alias("i"), F.col("r_atom_idx").alias("j"))
    return graph.union_edges([template, peptide, conect, links, cross, ss], ["sid"])


def attach_parameters(atoms: DataFrame, bonds: DataFrame, ff: Parameters, options: BuildOptions) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(bonds, angles, dihedrals, exclusions, violations). Lookups run on distinct types, then join back."""
    types = atoms.select("sid", "atom_idx", "atom_type")

    def typed(df: DataFrame, ends: list[str]) -> DataFrame:
        for e in ends:
            df = df.join(types.select("sid", F.col("atom_idx").alias(e), F.col("atom_type").alias(f"t_{e}")), ["sid", e])
        return df

    def lost(df: DataFrame, ends: list[str], kind: str, empty: Column) -> DataFrame:
        name = F.concat_ws("-", *[f"t_{e}" for e in ends])
        return violation(df.where(empty).select("sid", *[f"t_{e}" for e in ends]).distinct(), "missing_parameter", name, F.concat(F.lit(f"no parameter for {kind} atom types "), name))

    b = typed(bonds, ["i", "j"])
    values = pair_lookup(b.select("t_i", "t_j").distinct(), "t_i", "t_j", ff.bonds, ["force", "length"])
    b = b.join(values, ["t_i", "t_j"])
    bad = lost(b, ["i", "j"], "bond", F.col("force").isNull())
    a = typed(graph.two_paths(bonds, ["sid"]).withColumnRenamed("c", "j"), ["i", "j", "k"])
    values = either_direction(a.select("t_i", "t_j", "t_k").distinct(), ["t_i", "t_j", "t_k"], ff.angles, ["t1", "t2", "t3"], ["force", "degrees"])
    a = a.join(values, ["t_i", "t_j", "t_k"])
    bad = bad.unionByName(lost(a, ["i", "j", "k"], "angle", F.col("force").isNull()))
    four, tk = ["t_i", "t_j", "t_k", "t_l"], ["t1", "t2", "t3", "t4"]
    term = ["force", "phase_degrees", "periodicity"]
    q = typed(graph.three_paths(bonds, ["sid"]).toDF("sid", "i", "j", "k", "l"), ["i", "j", "k", "l"])
    values = wildcard_lookup(q, four, ff.torsions, tk, "load_order", term, PROPER)
    q = q.join(values, four, "left")
    bad = bad.unionByName(lost(q, ["i", "j", "k", "l"], "dihedral", F.col("force").isNull()))
    low_first = F.col("j") < F.col("k")
    order = lambda kind, *keys: F.struct(F.lit(kind).alias("kind"), *[k.cast("long").alias(f"o{n}") for n, k in enumerate(keys)])
    found = order(0, F.least("j", "k"), F.greatest("j", "k"), F.when(low_first, F.col("i")).otherwise(F.col("l")), F.when(low_first, F.col("l")).otherwise(F.col("i")), F.col("load_order"))
    proper = q.where("force IS NOT NULL").select("sid", "i", "j", "k", "l", *term, F.lit(False).alias("improper"), found.alias("found"))
    # a triple a < b < d about c is read as (a, b, c, d)
    s = typed(graph.star_triples(bonds, ["sid"]).select("sid", F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("k"), F.col("d").alias("l")), ["i", "j", "k", "l"])
    values = wildcard_lookup(s, four, ff.impropers, tk, "load_order", term, IMPROPER)
    found = order(1, F.col("k"), F.col("i"), F.col("j"), F.col("l"), F.col("load_order"))
    improper = s.join(values, four).select("sid", "i", "j", "k", "l", *term, F.lit(True).alias("improper"), found.alias("found"))
    d = proper.unionByName(improper).withColumn("ord", F.row_number().over(W.partitionBy("sid").orderBy("found")) - 1)
    d = d.select("sid", "ord", "i", "j", "k", "l", "force", "periodicity", F.radians("phase_degrees").alias("phase"), "improper", F.lit(float(options.scee)).alias("scee"), F.lit(float(options.scnb)).alias("scnb"))
    return (
        b.where("force IS NOT NULL").select("sid", "i", "j", "force", "length"),
        a.where("force IS NOT NULL").select("sid", "i", "j", "k", "force", F.radians("degrees").alias("radians")),
        d,
        graph.within_hops(bonds, 3, ["sid"]),
        bad,
    )


def parameterize(p: ParsedPdb, ff: ForceField, options: BuildOptions | None = None, strict: bool = True) -> System:
    """Systems without solvent. With `strict` the first problem of any structure is raised; otherwise problems are in `violations`."""
    o = (options or BuildOptions()).validate()
    t, par = ff.templates, ff.parameters
    p = ParsedPdb(*[cut(x) for x in (p.atoms, p.residues, p.conect, p.links, p.ssbonds, p.warnings, p.violations)])
    r, decisions, ends, warnings = kept_residues(p, o)
    r, more = resolve_templates(cut(r), p, ends, t)
    r = cut(r)
    matched, bad = match_atoms(r, p, t)
    bad = cut(p.violations.unionByName(bad))
    if strict:
        require_none(bad)
    whole = matched.join(amide_hydrogens(r, p, t).withColumn("atom_name", F.lit("H")), ["sid", "residue", "atom_name"], "left")
    placed = place_hydrogens(whole, t)
    lj = par.nonbonded.select(F.col("t").alias("atom_type"), "radius", "epsilon")
    mass = par.masses.select(F.col("t").alias("atom_type"), F.col("mass").alias("m"))
    by_element = F.coalesce(*[F.when(F.col("element") == k, F.lit(v)) for k, v in MASSES.items()], F.lit(0.0))
    atoms = placed.join(F.broadcast(lj), "atom_type", "left").join(F.broadcast(mass), "atom_type", "left").withColumn("mass", F.coalesce("m", by_element))
    atoms = cut(atoms.withColumn("atom_idx", F.row_number().over(W.partitionBy("sid").orderBy("residue", "ord")) - 1))
    bad = bad.unionByName(violation(atoms.where("radius IS NULL").select("sid", "atom_type").distinct(), "missing_parameter", F.col("atom_type"), F.concat(F.lit("no parameter for nonbonded atom types "), "atom_type")))
    bad = bad.unionByName(violation(atoms.where("x IS NULL"), "invalid_pdb", F.col("name"), F.concat(F.lit("too few neighbours have a position to place hydrogen "), "name")))
    edges = cut(find_bonds(atoms, r, p, t))
    bonds, angles, dihedrals, exclusions, lost = attach_parameters(cut(atoms.select("sid", "atom_idx", "atom_type")), edges, par, o)
    bad = cut(bad.unionByName(lost))
    to_residue = atoms.select("sid", F.col("atom_idx"), "residue")
    joined = edges.join(to_residue.toDF("sid", "i", "ri"), ["sid", "i"]).join(to_residue.toDF("sid", "j", "rj"), ["sid", "j"]).select("sid", F.col("ri").alias("i"), F.col("rj").alias("j"))
    nodes = r.select("sid", F.col("residue").alias("id"))
    comp = graph.numbered_components(graph.components(nodes, joined, ["sid"]), ["sid"]).select("sid", F.col("id").alias("residue"), "component")
    spans = atoms.groupBy("sid", "residue").agg(F.min("atom_idx").alias("first_atom"), F.count("*").cast("int").alias("atom_count"))
    residues = r.join(spans, ["sid", "residue"]).join(comp, ["sid", "residue"])
    residues = residues.select("sid", "residue", F.when(protein(), F.col("name")).otherwise(F.col("template")).alias("name"), "number", "icode", "chain", "first_atom", "atom_count", "component")
    info = atoms.groupBy("sid").agg(F.count("*").alias("solute_atoms")).join(residues.groupBy("sid").agg((F.max("component") + 1).alias("components")), "sid")
    zero = lambda n, k: F.lit(0).cast(k).alias(n)
    info = info.select("sid", zero("box_x", "double"), zero("box_y", "double"), zero("box_z", "double"), "solute_atoms", zero("waters", "long"), zero("sodium", "long"), zero("chloride", "long"), F.col("components").cast("long"))
    columns = ["sid", "atom_idx", "name", "atom_type", "element", "residue", "charge", "mass", "radius", "epsilon", "x", "y", "z"]
    system = System(atoms.select(*columns), residues, bonds, angles, dihedrals, exclusions, info, bad, cut(reduce(DataFrame.unionByName, [p.warnings, warnings, more])), decisions).kept()
    if strict:
        require_none(system.violations)
        off = system.charges().where("abs(solute_charge - round(solute_charge)) > 1e-3")
        require_none(violation(off, "non_integral_charge", F.col("sid"), F.format_string("solute charge %.6f is not within tolerance of an integer", "solute_charge")))
    return system


def unsupported(p: ParsedPdb, t: Templates) -> DataFrame:
    """Residues (sid, residue_idx, reference) that no template family, sugar code, water or ion name covers."""
    known = F.broadcast(t.atoms.where("family = 'glycan'").select(F.col("template").alias("name")).distinct())
    named = protein() | F.col("name").isin(WATER) | F.upper("name").isin(FREE_IONS) | F.col("name").isin(sorted(SUGAR_ENDINGS))
    return p.residues.where(~named).join(known, "name", "left_anti").select("sid", "residue_idx", reference().alias("reference"))
