import math
import re

import pytest

from molframe.errors import MolframeError
from molframe.options import BuildOptions
from molframe.sources import parameters, pdb, prmtop, templates
from tests import peptide
from tests.peptide import atom_line


def lines(*x):
    return "\n".join(x) + "\n"


FILE = lines(
    "LINK         ND2 ASN A   1                 C1  NAG B   1     1555   1555  1.45",
    "MODEL        1",
    atom_line(1, "N", "ASN", "A", 1, (0, 0, 0), "N"),
    atom_line(2, "CA", "ASN", "A", 1, (1, 0, 0), "", altloc="B", occ=0.6),
    atom_line(3, "CA", "ASN", "A", 1, (2, 0, 0), "", altloc="A", occ=0.4),
    atom_line(4, "HA", "ASN", "A", 1, (3, 0, 0)),
    atom_line(5, "C1", "NAG", "B", 1, (4, 0, 0), "C", record="HETATM", icode="C"),
    atom_line(6, "1H1", "NAG", "B", 1, (5, 0, 0), "", record="HETATM", icode="C"),
    "LINK         ND2 ASN A   1                 C1  NAG B   1C    1555   1555  1.45",
    "LINK         ND2 ASN A   x                 C1  NAG B   1C    1555   1555  1.45",
    "SSBOND   1 CYS A    3    CYS A    9",
    "CONECT    5    1    6  bad",
    "CONECT    1    5",
    "ENDMDL",
    "MODEL        2",
    atom_line(1, "N", "ASN", "A", 1, (9, 9, 9), "N"),
    "ENDMDL",
    "CONECT    1    2",
)


def test_records_of_the_selected_model(spark):
    docs = pdb.texts(spark, {"s": FILE})
    p = pdb.parse(docs, strict=True)
    atoms = [(r.serial, r.name, r.x, r.element, r.icode) for r in p.atoms.orderBy("pos").collect()]
    assert atoms == [(1, "N", 0.0, "N", None), (3, "CA", 2.0, "C", None), (5, "C1", 4.0, "C", "C"), (6, "1H1", 5.0, "H", "C")]
    assert [(r.name, r.number, r.icode) for r in p.residues.orderBy("residue_idx").collect()] == [("ASN", 1, None), ("NAG", 1, "C")]
    assert sorted((r.a, r.b) for r in p.conect.collect()) == [(1, 5), (5, 6)]
    assert [(r.atom1, r.icode1, r.icode2) for r in p.links.collect()] == [("ND2", None, "C")]
    assert [(r.number1, r.number2) for r in p.ssbonds.collect()] == [(3, 9)]
    assert {r.code for r in p.warnings.collect()} == {"input_hydrogens_rebuilt", "input_glycan_hydrogens_preserved", "alternate_location_selected"}
    assert p.chains().first().chains == ["A", "B"]
    second = pdb.parse(docs, BuildOptions(model=2), strict=True)
    assert [r.x for r in second.atoms.collect()] == [9.0]
    wanted = pdb.parse(docs, BuildOptions(altloc="B"))
    assert wanted.atoms.where("name = 'CA'").first().x == 1.0
    view = pdb.canonical_view(docs, 2).first().text.splitlines()
    assert len(view) == 9 and all(len(x) >= 80 for x in view) and view[-1].startswith("END")


@pytest.mark.parametrize("text, code", [("ATOM      1  N   ALA A   1       0.000\n", "invalid_pdb"), (atom_line("x", "N", "ALA", "A", 1, (0, 0, 0)) + "\n", "invalid_pdb"), ("REMARK\n", "invalid_pdb"), ("MODEL        7\nENDMDL\n", "model_not_found")])
def test_problems_are_rows(spark, text, code):
    docs = pdb.texts(spark, {"s": text})
    assert code in {r.code for r in pdb.parse(docs).violations.collect()}
    with pytest.raises(MolframeError):
        pdb.parse(docs, strict=True)


def test_off_units(spark):
    t = templates.read_off(spark, "n_terminal", peptide.libraries()["n_terminal"])
    a = t.atoms.orderBy("ord").collect()
    assert [(r.name, r.atom_type, r.element, r.charge) for r in a] == peptide.A
    assert [v for r in a for v in (r.x, r.y, r.z)] == pytest.approx([v for p in peptide.geometry()[0] for v in p])
    assert sorted((r.a, r.b) for r in t.bonds.collect()) == sorted(peptide.A_BONDS)
    short = '!entry.Q.unit.atoms table \n "A b" "T" 0 1 0 1 6 0.5\n "C" "T" 0 1 0 2 6 0.5\n "D" "T"\n!entry.Q.unit.positions table \n 1 2 3\n!entry.E.unit.name single str\n "E"\n'
    q = templates.read_off(spark, "f", short).atoms.orderBy("ord").collect()
    assert [(r.name, r.x) for r in q] == [("A b", 0.0), ("C", 0.0)]
    both = templates.overlaid([t, templates.read_off(spark, "n_terminal", peptide.off([("NALA", [("Z", "T", 6, 0.0)], [], [(0.0, 0.0, 0.0)])]))])
    assert [r.name for r in both.atoms.collect()] == ["Z"] and both.bonds.count() == 0


PREP = """title

RNG INT 0
CORRECT OMIT DU BEG
0.0
 1 DUMM DU M 0 -1 -2 0.0 0.0 0.0 0.0
 2 DUMM DU M 1 0 -1 1.0 0.0 0.0 0.0
 3 DUMM DU M 2 1 0 1.0 90.0 0.0 0.0
 4 C1 Cg M 3 2 1 1.5 109.5 60.0 0.1
 5 O5 Os M 4 3 2 1.4 110.0 180.0 -0.4
 6 C2 Cg M 5 4 3 1.4 112.0 60.0 0.2
 7 H2 H1 E 6 5 4 1.09 109.0 120.0 0.1

LOOP
 C1 C2

DONE
STOP
"""


def test_prep_units(spark):
    t = templates.read_prep(spark, "glycan", PREP)
    a = {r.name: r for r in t.atoms.collect()}
    assert [a[n].element for n in ("C1", "O5", "C2", "H2")] == [6, 8, 6, 1]
    assert {tuple(sorted((r.a, r.b))) for r in t.bonds.collect()} == {(0, 1), (1, 2), (2, 3), (0, 2)}
    d = lambda p, q: math.dist((a[p].x, a[p].y, a[p].z), (a[q].x, a[q].y, a[q].z))
    assert d("C1", "O5") == pytest.approx(1.4) and d("C2", "H2") == pytest.approx(1.09)


LEGACY = """PARM header
CT 12.01   0.878
HC 1.008
OX 16.0

CT-HC  340.0   1.09   ! note
CT-CT  310.0   1.526

HC-CT-HC    35.0  109.50

X -CT-CT-X    9    1.40   0.0   3.
HC-CT-CT-HC   1    0.15   0.0  -3.
HC-CT-CT-HC   1    0.25   0.0   1.

X -X -C -O          10.5         180.          2.

CT  CX  C8
OX  OY

MOD4      RE
  CT          1.9080  0.1094             note
  HC          1.4870  0.0157

END
"""


def test_parameters_in_load_order(spark):
    late = "late\nBOND\nHC-CT  341.0   1.10\n\nDIHE\nHC-CT-CT-HC   1    0.35   0.0   2.\n\nNONBON\n  CX   2.0  0.2\n"
    p = parameters.load(spark, [("legacy", LEGACY), ("frcmod", late)])
    assert {(r.t, r.mass) for r in p.masses.collect()} == {("CT", 12.01), ("HC", 1.008), ("OX", 16.0)}
    assert {(r.t1, r.t2): r.force for r in p.bonds.collect()} == {("CT", "HC"): 341.0, ("CT", "CT"): 310.0}
    assert {(r.t1, r.force, r.periodicity) for r in p.torsions.collect()} == {("X", 1.4 / 9, 3), ("HC", 0.15, 3), ("HC", 0.25, 1), ("HC", 0.35, 2)}
    assert p.impropers.first().force == 10.5
    assert {(r.t, r.radius) for r in p.nonbonded.collect()} == {("CT", 1.908), ("HC", 1.487), ("CX", 2.0), ("C8", 1.908)}


def test_options(tmp_path):
    o = BuildOptions()
    assert (o.padding_angstrom, o.salt_molar, o.model) == (12.0, 0.15, 1)
    (tmp_path / "a.toml").write_text('salt_molar = 0.3\n[protonation.residues]\n"A:1" = "HID"\n')
    t = BuildOptions.from_file(tmp_path / "a.toml").overridden(no_water=True, protonation={"A:2": "HIE"})
    assert t.salt_molar == 0.3 and not t.add_ions and not t.add_water and t.protonation == {"A:1": "HID", "A:2": "HIE"}
    (tmp_path / "a.yml").write_text("")
    for bad in (lambda: BuildOptions(padding_angstrom=0).validate(), lambda: BuildOptions(add_water=False).validate(), lambda: BuildOptions(model=0).validate(), lambda: BuildOptions(salt_molar=float("nan")).validate(), lambda: BuildOptions.from_file(tmp_path / "a.yml")):
        with pytest.raises(MolframeError):
            bad()


def test_sections_of_a_topology():
    s = prmtop.read_sections("%FLAG A\n%FORMAT(10I8)\n       1      -2\n%FLAG B\n%FORMAT(5E16.8)\n  1.25000000E+01\n%FLAG C\n%FORMAT(20a4)\nN   CA  \n")
    assert s == {"A": [1, -2], "B": [12.5], "C": ["N", "CA"]}


def test_giant_structures_are_read_by_ranges(spark):
    """The same tables whether a structure is one task or many; two models, alternate locations, insertion codes, two structures."""
    line = "%-6s%5d %-4s%s%3s %s%4d%s   %8.3f%8.3f%8.3f%6.2f%6.2f          %2s"
    lines = []
    for model in (1, 2):
        lines.append("MODEL     %4d" % model)
        for n in range(120):
            lines.append(line % ("ATOM", 121 - n, "CA", " ", "SER", "AB"[n % 2], n // 2, "X" if n % 5 == 0 else " ", n, model, 0.5, 1.0, 0.0, "C"))
            if n % 7 == 0:
                lines.append(line % ("HETATM", 500 + n, "C1", "A", "NAG", "AB"[n % 2], n // 2, " ", n, model, 1.5, 0.4, 0.0, "C"))
                lines.append(line % ("HETATM", 700 + n, "C1", "B", "NAG", "AB"[n % 2], n // 2, " ", n, model, 2.5, 0.6, 0.0, "C"))
        lines.append("CONECT" + "".join("%5d" % (1 + k % 120) for k in range(130)))
        lines.append("ENDMDL")
    plain = [x for x in lines if not x.startswith(("MODEL", "ENDMDL"))][:90]
    docs = pdb.texts(spark, {"one": "\n".join(lines), "two": "\n".join(plain)})
    order = lambda df: sorted(map(repr, df.collect()))
    for model in (1, 2):
        o = BuildOptions(model=model)
        small, large = pdb.parse(docs, o), pdb.parse(docs, o, giant=0)
        for t in ("atoms", "residues", "conect", "violations", "warnings"):
            a, b = getattr(small, t), getattr(large, t)
            assert a.columns == b.columns and order(a) == order(b), (model, t)
        assert large.atoms.count() > 100 and large.conect.where("sid = 'one' AND a <> b").count() == 119
    plain, ranged = (x.atoms._jdf.queryExecution().executedPlan().toString() for x in (small, large))
    rows_by_sid = re.compile(r"windowspecdefinition\(sid#\d+, (line_no|serial|__first)#")
    assert rows_by_sid.search(plain) and not rows_by_sid.search(ranged)
