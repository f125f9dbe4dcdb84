import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe import cli
from molframe.errors import MolframeError
from molframe.functions.geometry import torsion, vec
from molframe.options import BuildOptions
from molframe.plans import energy, optimize, report
from molframe.plans.hydrogens import Residue
from molframe.plans.prepare import ForceField, parameterize
from molframe.plans.solvate import choose_spaced, ion_schedule, solvate
from molframe.plans.structure import Structure
from molframe.runtime import cut
from molframe.sinks import bundle, render
from molframe.sources import parameters, pdb, prmtop
from molframe.sources.templates import Templates, read_off
from tests import peptide
from tests.peptide import atom_line


@pytest.fixture(scope="module")
def ff(spark):
    parts = [read_off(spark, f, t) for f, t in peptide.libraries().items()]
    t = parts[0]
    for p in parts[1:]:
        t = t.union(p)
    p = parameters.load(spark, [("frcmod", peptide.frcmod())])
    return ForceField(Templates(cut(t.atoms), cut(t.bonds)), parameters.Parameters(*[cut(getattr(p, n)) for n in ("masses", "bonds", "angles", "torsions", "impropers", "nonbonded")]))


@pytest.fixture(scope="module")
def dry(spark, ff):
    docs = pdb.texts(spark, {"one": peptide.pdb(), "two": peptide.pdb(hydrogens=True)})
    return parameterize(pdb.parse(docs), ff, BuildOptions(add_water=False, add_ions=False))


def test_topology_counts(dry):
    """Known counts of an N-terminal alanine and a C-terminal glycine."""
    count = lambda t: {r.sid: r["count"] for r in t.groupBy("sid").count().collect()}
    assert count(dry.atoms) == {"one": 20, "two": 20}
    assert count(dry.bonds) == {"one": 19, "two": 19}
    assert count(dry.angles) == {"one": 33, "two": 33}
    assert count(dry.dihedrals.where("NOT improper").select("sid", "i", "j", "k", "l").distinct()) == {"one": 40, "two": 40}
    assert count(dry.exclusions.where("i < j")) == {"one": 92, "two": 92}
    assert {r.components for r in dry.info.collect()} == {1}
    assert all(abs(r.charge - round(r.charge)) < 1e-9 for r in dry.charges().collect())
    assert [r.name for r in dry.residues.where("sid = 'one'").orderBy("residue").collect()] == ["ALA", "GLY"]


def test_torsions_accumulate_and_are_ordered(dry):
    t = [(r.i, r.j, r.k, r.l, r.periodicity) for r in dry.dihedrals.where("sid = 'one' AND i = 0 AND l = 11").orderBy("ord").collect()]
    assert t == [(0, 4, 10, 11, 1), (0, 4, 10, 11, 3)]
    order = [r.improper for r in dry.dihedrals.where("sid = 'one'").orderBy("ord").collect()]
    assert order == sorted(order)


def test_rebuilt_hydrogens(dry):
    """Built atoms stand where the ideal ones are, at bond length and clear of each other."""
    want = [p for part in peptide.geometry() for p in part]
    got = {r.atom_idx: (r.x, r.y, r.z) for r in dry.atoms.where("sid = 'one'").collect()}
    for i, p in enumerate(want):
        assert math.dist(got[i], p) < 0.05, i
    amide = math.dist(got[13], got[12])
    assert abs(amide - 1.01) < 0.02


def test_refusals(spark, ff):
    def run(text, **o):
        return parameterize(pdb.parse(pdb.texts(spark, {"s": text})), ff, BuildOptions(**o))

    with pytest.raises(MolframeError, match="lacks these atoms of its template: CB") as e:
        run(peptide.pdb(drop=[("ALA", "CB")]))
    assert e.value.code == "missing_heavy_atoms"
    with pytest.raises(MolframeError, match="not present in template"):
        run(peptide.pdb().replace("CB   ALA", "CQ   ALA").replace("TER", atom_line(90, "CB", "ALA", "A", 1, (9, 9, 9)) + "\nTER"))
    with pytest.raises(MolframeError, match="unsupported residue"):
        run(peptide.pdb().replace("TER", atom_line(90, "C1", "UNK", "B", 1, (9, 9, 9)) + "\nTER"))
    r = report.inspect(pdb.texts(spark, {"gap": peptide.pdb(drop=[("ALA", "CB")]), "odd": peptide.pdb().replace("TER", atom_line(90, "C1", "UNK", "B", 1, (9, 9, 9)) + "\nTER")}), ff, BuildOptions(add_water=False, add_ions=False))
    rows = {x.sid: x for x in r.collect()}
    assert "CB" in rows["gap"].missing_heavy_atoms[0] and rows["odd"].unsupported_residues == ["B/UNK/1 "]


def test_solvent_is_removed_and_names_change(spark, ff):
    from molframe.plans.prepare import kept_residues

    text = "\n".join(
        [
            "SSBOND   1 CYS A    1    CYS A    9",
            atom_line(1, "SG", "CYS", "A", 1, (0, 0, 0), "S"),
            atom_line(2, "SG", "CYS", "A", 2, (30, 0, 0), "S"),
            atom_line(3, "SG", "CYS", "A", 3, (32, 0, 0), "S"),
            atom_line(4, "SG", "CYS", "A", 4, (60, 0, 0), "S"),
            atom_line(5, "ND1", "HIS", "A", 5, (90, 0, 0), "N"),
            atom_line(6, "NE2", "HIS", "A", 5, (92, 0, 0), "N"),
            atom_line(7, "O", "HOH", "W", 6, (89, 0, 0), "O"),
            atom_line(8, "ND1", "HIS", "A", 7, (120, 0, 0), "N"),
            atom_line(9, "ND2", "ASN", "A", 8, (150, 0, 0), "N"),
            atom_line(10, "C1", "NAG", "B", 1, (151, 0, 0), "C"),
            "CONECT    9   10",
        ]
    )
    p = pdb.parse(pdb.texts(spark, {"s": text}), strict=True)
    r, decisions, _, warnings = kept_residues(p, BuildOptions(protonation={"A:7": "HIP"}))
    assert [x.name for x in r.orderBy("residue").collect()] == ["CYX", "CYX", "CYX", "CYS", "HID", "HIP", "NLN", "NAG"]
    assert sorted((x.selector, x.state) for x in decisions.collect()) == [("A:5", "HID"), ("A:7", "HIP")]
    assert {w.code for w in warnings.collect()} == {"existing_solvent_removed", "histidine_state_inferred", "glycan_name_normalized"}


def test_energy_gradient_equals_differences(spark, dry):
    s = dry
    rest = spark.createDataFrame([("one", 3, 0.0, 0.0, 1.0, 2.5), ("one", 77, 0.0, 0.0, 0.0, 1.0)], "sid string, atom_idx int, rx double, ry double, rz double, k double")
    ev = energy.Evaluator(s, energy.EnergyOptions(restraints=rest))
    base = {(r.sid, r.atom_idx): [r.x, r.y, r.z] for r in s.coordinates().collect()}
    rows, picks, h = [], [(3, 0), (4, 1), (10, 2), (12, 0)], 1e-5
    for n, (a, k) in enumerate(picks):
        for sign in (1, -1):
            for (sid, i), p in base.items():
                if sid == "one":
                    q = list(p)
                    q[k] += sign * h if i == a else 0
                    rows.append((sid, 2 * n + (sign < 0), i, *q))
    xyz = spark.createDataFrame(rows, "sid string, pose int, atom_idx int, x double, y double, z double")
    e = [r.total for r in ev.energies(xyz).orderBy("pose").collect()]
    g = {r.atom_idx: (r.gx, r.gy, r.gz) for r in ev.gradients().where("sid = 'one'").collect()}
    for n, (a, k) in enumerate(picks):
        assert g[a][k] == pytest.approx((e[2 * n] - e[2 * n + 1]) / (2 * h), abs=5e-3, rel=1e-5)
    some = s.atoms.where("atom_idx = 3").select("sid", "atom_idx")
    part = energy.Evaluator(s, energy.EnergyOptions(obc2=None), some, active_only=True).gradients().where("gx <> 0").collect()
    assert {r.atom_idx for r in part} == {3}
    with pytest.raises(MolframeError):
        ev.energies(xyz.where("atom_idx > 0"))
    with pytest.raises(MolframeError):
        energy.EnergyOptions(cutoff=-1.0).validate()


def test_energy_equals_plain_sums(dry):
    s = dry
    atoms = {r.atom_idx: r for r in s.atoms.where("sid = 'one'").collect()}
    p = {i: np.array([a.x, a.y, a.z]) for i, a in atoms.items()}
    excluded = {(r.i, r.j) for r in s.exclusions.where("sid = 'one'").collect()}
    four = {(min(r.i, r.l), max(r.i, r.l)) for r in s.dihedrals.where("sid = 'one' AND NOT improper").collect()}
    vdw = coulomb = 0.0
    for i in atoms:
        for j in atoms:
            if i < j and ((i, j) not in excluded or (i, j) in four):
                scee, scnb = (1.2, 2.0) if (i, j) in four else (1, 1)
                r = np.linalg.norm(p[i] - p[j])
                six = ((atoms[i].radius + atoms[j].radius) / r) ** 6
                vdw += math.sqrt(atoms[i].epsilon * atoms[j].epsilon) * (six * six - 2 * six) / scnb
                coulomb += 332.063713299 * atoms[i].charge * atoms[j].charge / (r * scee)
    ev = energy.Evaluator(s, energy.EnergyOptions(obc2=None))
    e = ev.energies().where("sid = 'one'").first()
    assert (e.van_der_waals, e.electrostatics) == (pytest.approx(vdw), pytest.approx(coulomb))
    assert e.bonds == pytest.approx(sum(b.force * (np.linalg.norm(p[b.i] - p[b.j]) - b.length) ** 2 for b in s.bonds.where("sid = 'one'").collect()))
    a, b = (s.atoms.where(f"residue = {k}").select("sid", "atom_idx") for k in (0, 1))
    all_pairs, near = ev.interaction(a, b).where("sid = 'one'").first(), energy.Evaluator(s, energy.EnergyOptions(cutoff=50.0, obc2=None)).interaction(a, b).where("sid = 'one'").first()
    assert all_pairs.pairs == near.pairs and all_pairs.total == pytest.approx(near.total)
    with pytest.raises(MolframeError):
        ev.interaction(a, a)


def test_torsion_sign(spark):
    row = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 1.0)], "ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, dx double, dy double, dz double")
    assert row.select(F.degrees(torsion(vec("a"), vec("b"), vec("c"), vec("d"))).alias("t")).first().t == pytest.approx(90)


def test_solvation(ff, dry):
    o = BuildOptions(padding_angstrom=8.0, salt_molar=0.2)
    s = solvate(dry, ff, o)
    again = solvate(dry, ff, o)
    key = lambda x: [tuple(r) for r in x.atoms.orderBy("sid", "atom_idx").collect()]
    assert key(s) == key(again)
    for info in s.info.collect():
        atoms = s.atoms.where(F.col("sid") == info.sid).orderBy("atom_idx").collect()
        assert [a.atom_idx for a in atoms] == list(range(len(atoms))) and len(atoms) == 20 + 3 * info.waters + info.sodium + info.chloride
        assert info.sodium == info.chloride == round(0.2 * 0.602214076 * info.box_x * info.box_y * info.box_z / 1000)
        xyz = np.array([(a.x, a.y, a.z) for a in atoms])
        solute, oxygen = xyz[:20], xyz[20 : 20 + 3 * info.waters : 3]
        assert np.allclose((solute.min(0) + solute.max(0)) / 2, np.array([info.box_x, info.box_y, info.box_z]) / 2)
        assert (((oxygen[:, None] - solute[None]) ** 2).sum(2) >= 2.4**2).all()
        assert (oxygen >= 0).all() and (oxygen < [info.box_x, info.box_y, info.box_z]).all()
        # every cell of the lattice that is free is there
        cell = [(6.0 * i + 0.24, 6.0 * j, 6.0 * k) for i in range(3) for j in range(3) for k in range(3)]
        box = np.array([info.box_x, info.box_y, info.box_z])
        n = 0
        for t in np.ndindex(*np.ceil(box / 18.774349).astype(int)):
            for c in cell:
                p = np.array(c) + 18.774349 * np.array(t)
                n += bool((p >= 0).all() and (p < box).all() and (((solute - p) ** 2).sum(1) >= 2.4**2).all())
        assert n == info.waters + info.sodium + info.chloride
    assert all(abs(r.charge) < 1e-9 for r in s.charges().collect())
    with pytest.raises(MolframeError, match="far enough from the solute"):
        solvate(dry, ff, BuildOptions(padding_angstrom=3.0, salt_molar=90.0))


def test_ion_schedule_and_spacing():
    assert ion_schedule(4, 2, -2) == [True, True, True, False, True, False]
    assert ion_schedule(1, 3, 2) == [False, False, True, False]
    xyz = np.array([[0, 0, 0], [1.0, 0, 0], [9, 0, 0], [9.5, 0, 0]])
    assert choose_spaced(xyz, np.array([0.0, 1, 2, 3]), np.arange(4), [True, True, False]) == [0, 2, 3]


def sugar(there, extra=()):
    """A carbon with neighbours along ideal tetrahedral directions, as one residue."""
    import pandas as pd

    t = 1.5 / math.sqrt(3)
    spots = {"C1": (0, 0, 0), "O1": (t, t, t), "O5": (t, -t, -t), "C2": (-t, t, -t), "H1": tuple(-x * 1.09 / 1.5 for x in (t, t, -t))}
    names = list(spots)
    rows = pd.DataFrame({"atom_name": names, "number_of": [6, 8, 8, 6, 1], **{f"t{a}": [float(spots[n][k]) for n in names] for k, a in enumerate("xyz")}, **{a: [float(spots[n][k]) if n in there else math.nan for n in names] for k, a in enumerate("xyz")}, "there": [True if n in there else None for n in names]})
    return Residue(rows, [(0, 1), (0, 2), (0, 3), (0, 4)]), spots


def test_sugar_hydrogens_by_surroundings():
    r, spots = sugar(["C1", "O1", "O5", "C2"])
    around = np.array([spots[n] for n in ("C1", "O1", "O5", "C2")], float)
    h = r.sugar_hydrogens(around)[4]
    assert np.linalg.norm(h) == pytest.approx(1.09)
    assert np.dot(h, np.mean([spots[n] for n in ("O1", "O5", "C2")], 0)) < 0
    assert np.allclose(r.by_frame(4), spots["H1"])
    r, _ = sugar(["C1", "O1"])
    h = r.sugar_hydrogens(around[:2])[4]
    cosine = np.dot(h, around[1]) / np.linalg.norm(h) / np.linalg.norm(around[1])
    assert cosine == pytest.approx(-1 / 3)
    r, _ = sugar(["C1", "O1", "O5"])
    h = r.sugar_hydrogens(around[:3])[4]
    assert np.allclose(h / np.linalg.norm(h), -(around[1] + around[2]) / np.linalg.norm(around[1] + around[2]))


def test_files_read_back(spark, dry, tmp_path):
    rows = {(r.sid, r.file): r for r in bundle.texts(dry).collect()}
    t = prmtop.tables(rows["one", "system.prmtop"].text)
    bonds = sorted((r.i, r.j, r.force) for r in dry.bonds.where("sid = 'one'").collect())
    assert [b[:2] for b in sorted((i, j, k) for i, j, k, _ in t["bonds"])] == [b[:2] for b in bonds]
    assert len(t["dihedrals"]) == dry.dihedrals.where("sid = 'one'").count()
    assert sum(d[7] for d in t["dihedrals"]) == dry.dihedrals.where("sid = 'one' AND improper").count()
    assert [a[5] for a in t["atoms"]] == pytest.approx([r.charge for r in dry.atoms.where("sid = 'one'").orderBy("atom_idx").collect()], abs=1e-6)
    s = prmtop.read_sections(rows["one", "system.prmtop"].text)
    assert s["POINTERS"][10] == 92 == len(s["EXCLUDED_ATOMS_LIST"]) and len(s["POINTERS"]) == 31
    xyz, box = prmtop.read_inpcrd(rows["one", "system.inpcrd"].text)
    assert len(xyz) == 20 and box == []
    assert rows["one", "system.gro"].text.splitlines()[1] == "20"
    assert "[ dihedrals ]" in rows["one", "system.top"].text
    reports = spark.createDataFrame([("one", 1), ("two", 2)], "sid string, n int")
    folders = bundle.write_bundles(dry, reports, tmp_path / "out")
    manifest = json.loads((folders[0] / "manifest.json").read_text())
    assert manifest["output_sha256"]["system.top"] == rows["one", "system.top"].sha256
    with pytest.raises(MolframeError):
        bundle.write_bundles(dry, reports, tmp_path / "out")


def test_improper_keeps_its_sign():
    types = {(1.0, 2, 0.0, 1.2, 2.0): 1}
    d = dict(i=5, j=2, k=3, l=0, force=1.0, periodicity=2, phase=0.0, improper=True, scee=1.2, scnb=2.0)
    assert render.torsion_records([d], types)[3] < 0
    p = dict(d, improper=False, l=9)
    assert [x for x in render.torsion_records([p, p], types)] == [15, 6, 9, 27, 1, 15, 6, -9, 27, 1]
    with pytest.raises(ValueError):
        render.component_sizes([{"residue": 0}, {"residue": 1}, {"residue": 0}], [{"residue": 0, "component": 0}, {"residue": 1, "component": 1}])


GLYCO = "\n".join(
    [
        atom_line(1, "N", "ASN", "A", 1, (0, 0, 0), "N"),
        atom_line(2, "ND2", "ASN", "A", 1, (1, 0, 0), "N"),
        atom_line(3, "N", "ALA", "A", 2, (2, 0, 0), "N"),
        atom_line(4, "C1", "NAG", "B", 1, (2.45, 0, 0), "C", record="HETATM"),
        "END",
        "",
    ]
)


def test_structures_are_editable(spark):
    s = Structure(pdb.parse(pdb.texts(spark, {"s": GLYCO}), strict=True))
    s = s.add_bonds(spark.createDataFrame([("s", 4, 2)], "sid string, a long, b long"))
    with pytest.raises(MolframeError):
        s.add_bonds(spark.createDataFrame([("s", 4, 4)], "sid string, a long, b long"))
    site = spark.createDataFrame([("s", "A", 1, None, "ND2", "B", 1, None, "C1")], "sid string, protein_chain string, protein_number int, protein_icode string, protein_atom string, glycan_chain string, glycan_number int, glycan_icode string, glycan_atom string")
    s = s.add_glycosylation_sites(site)
    text = s.to_pdb().first().text
    lines = text.splitlines()
    assert lines.count("TER") == 2 and "CONECT    2    4" in lines and lines[-1] == "END"
    link = next(x for x in lines if x.startswith("LINK"))
    assert (link[12:16], link[17:20], link[42:46], link[47:50], link[73:78], len(link)) == (" ND2", "ASN", "  C1", "NAG", " 1.45", 80)
    again = Structure(pdb.parse(pdb.texts(spark, {"s": text}), strict=True))
    assert again.glycosylation_sites().count() == 1
    assert len(again.glycan_trees().first().residue_ids) == 1
    assert again.to_pdb().first().text == text
    moved = again.set_positions(spark.createDataFrame([("s", 4, 9.0, 8.0, 7.0)], "sid string, serial long, x double, y double, z double"))
    assert moved.atoms().where("serial = 4").first().y == 8.0
    renamed = again.rename_residues(spark.createDataFrame([("s", "A", 2, None, "GLY")], "sid string, chain string, number int, icode string, new_name string"))
    assert [r.name for r in renamed.residues().orderBy("residue_idx").collect()] == ["ASN", "GLY", "NAG"]
    bigger, atoms, residues = again.append(again, "C")
    assert sorted(r.new_serial for r in atoms.collect()) == [5, 6, 7, 8] and sorted(r.new_number for r in residues.collect()) == [1, 2, 3]
    assert bigger.bonds().count() == 2 and bigger.chains().first().chains == ["A", "B", "C"]
    less = again.remove_residues_named(["NAG"])
    assert less.atoms().count() == 3 and less.bonds().count() == 0 and less.parsed.links.count() == 0
    with pytest.raises(MolframeError):
        again.append(again, "CC")


def test_coordinates_round_trip(spark, dry):
    c = dry.coordinates().withColumn("x", F.col("x") + 1)
    assert dry.with_coordinates(c).atoms.where("sid = 'one'").agg(F.sum("x")).first()[0] == pytest.approx(dry.atoms.where("sid = 'one'").agg(F.sum("x")).first()[0] + 20)
    with pytest.raises(ValueError):
        dry.with_coordinates(c.where("atom_idx > 0"))
    with pytest.raises(ValueError):
        dry.with_coordinates(c.withColumn("x", F.lit(float("nan"))))


def test_command_line(spark, tmp_path, capsys):
    for name, text in peptide.libraries().items():
        (tmp_path / f"{name}.lib").write_text(text)
    (tmp_path / "p.frcmod").write_text(peptide.frcmod())
    (tmp_path / "pep.pdb").write_text(peptide.pdb())
    field = [x for n in peptide.libraries() for x in ("--template", f"{n}={tmp_path / n}.lib")] + ["--parameters", f"frcmod={tmp_path / 'p.frcmod'}"]
    out = str(tmp_path / "out")
    assert cli.main(["prepare", str(tmp_path / "pep.pdb"), "-o", out, "--padding", "6", "--no-ions", *field], spark) == 0
    assert "pep: " in capsys.readouterr().out
    assert cli.main(["prepare", str(tmp_path / "pep.pdb"), "-o", out, "--padding", "6", "--no-ions", *field], spark) == 1
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["solute_atoms"] == 20 and manifest["sodium"] == 0 and manifest["waters"] > 0
    assert cli.main(["inspect", str(tmp_path / "pep.pdb"), *field], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["solute_atoms"] == 20


class Quadratic(optimize.Objective):
    dimension = 2

    def value_gradient(self, p):
        return (p[0] - 2) ** 2 + 2 * (p[1] + 1) ** 2, np.array([2 * (p[0] - 2), 4 * (p[1] + 1)])


def test_optimisers(spark):
    seen = []
    out = optimize.lbfgs_minimize(Quadratic(), [0, 0], progress=seen.append)
    assert out.converged and np.allclose(out.point, [2, -1], atol=1e-3)
    assert [p.iteration for p in seen] == list(range(len(out.history))) and seen[0].accepted_steps == 0
    for bad in (lambda: optimize.lbfgs_minimize(Quadratic(), [0]), lambda: optimize.lbfgs_minimize(Quadratic(), [0, 0], optimize.LbfgsConfig(max_iterations=0)), lambda: optimize.GeneticConfig(population_size=1).validate()):
        with pytest.raises(MolframeError):
            bad()
    from molframe.queries import Target

    c = optimize.GeneticConfig(population_size=32, generations=30, seed=random.Random(1).randrange(100))
    one = optimize.genetic_optimize(Target(321), c)
    two = optimize.genetic_optimize(Target(321), c, evaluate=optimize.spark_evaluate(spark, Target(321), 3))
    assert one == two and len(one.history) == one.generations + 1


def test_facade(spark, dry, tmp_path):
    from molframe import io

    (tmp_path / "g.pdb").write_text(GLYCO)
    s = io.read_pdb(spark, str(tmp_path / "g.pdb"))
    assert s.residues().select("sid").distinct().first().sid == "g"
    path = io.write_pdb(s, tmp_path / "out")[0]
    assert path.read_text() == io.read_pdb_str(spark, {"g": path.read_text()}).to_pdb().first().text
    assert io.gro(dry).count() == 2 and io.prmtop(dry).where("text LIKE '%POINTERS%'").count() == 2
