"""A made-up force field and an alanine-glycine peptide built from ideal internal coordinates."""

from itertools import product

from molframe.sources.templates import place

A = [("N", "NA", 7, 0.10), ("H1", "HN", 1, 0.20), ("H2", "HN", 1, 0.20), ("H3", "HN", 1, 0.20), ("CA", "CA", 6, 0.05), ("HA", "HA", 1, 0.05), ("CB", "CB", 6, -0.05), ("HB1", "HB", 1, 0.05), ("HB2", "HB", 1, 0.05), ("HB3", "HB", 1, 0.05), ("C", "CO", 6, 0.60), ("O", "OD", 8, -0.50)]
A_BONDS = [(0, 1), (0, 2), (0, 3), (0, 4), (4, 5), (4, 6), (6, 7), (6, 8), (6, 9), (4, 10), (10, 11)]
G = [("N", "NA", 7, -0.40), ("H", "HN", 1, 0.30), ("CA", "CA", 6, -0.20), ("HA2", "HA", 1, 0.10), ("HA3", "HA", 1, 0.10), ("C", "CO", 6, 0.70), ("O", "OD", 8, -0.80), ("OXT", "OD", 8, -0.80)]
G_BONDS = [(0, 1), (0, 2), (2, 3), (2, 4), (2, 5), (5, 6), (5, 7)]


def geometry():
    """Positions of the 12 and 8 atoms."""
    n, ca = (0.0, 0.0, 0.0), (1.47, 0.0, 0.0)
    p = {"N": n, "CA": ca, "C": place(ca, n, (0.0, 1.0, 0.0), 1.52, 110, 160)}
    for k, t in (("H1", 60), ("H2", 180), ("H3", 300)):
        p[k] = place(n, ca, p["C"], 1.01, 109.5, t)
    p["CB"] = place(ca, n, p["C"], 1.53, 110, 122)
    p["HA"] = place(ca, n, p["C"], 1.09, 109, -120)
    for k, t in (("HB1", 60), ("HB2", 180), ("HB3", 300)):
        p[k] = place(p["CB"], ca, n, 1.09, 109.5, t)
    p["O"] = place(p["C"], ca, n, 1.23, 120, -20)
    q = {"N": place(p["C"], ca, n, 1.33, 116, 160)}
    q["CA"] = place(q["N"], p["C"], ca, 1.45, 122, 180)
    q["H"] = place(q["N"], p["C"], ca, 1.01, 119, 0)
    q["C"] = place(q["CA"], q["N"], p["C"], 1.52, 110, 150)
    q["HA2"] = place(q["CA"], q["N"], q["C"], 1.09, 109, 120)
    q["HA3"] = place(q["CA"], q["N"], q["C"], 1.09, 109, -120)
    q["O"] = place(q["C"], q["CA"], q["N"], 1.25, 118, 10)
    q["OXT"] = place(q["C"], q["CA"], q["N"], 1.25, 118, 190)
    return [p[a[0]] for a in A], [q[a[0]] for a in G]


def off(units):
    lines = ["!!index array str", *[f' "{u}"' for u, *_ in units]]
    for unit, atoms, bonds, xyz in units:
        lines.append(f"!entry.{unit}.unit.atoms table  str name  str type  int typex  int resx  int flags  int seq  int elmnt  dbl chg")
        lines += [f' "{n}" "{t}" 0 1 131072 {i} {e} {q:.6f}' for i, (n, t, e, q) in enumerate(atoms, 1)]
        lines.append(f"!entry.{unit}.unit.connectivity table  int atom1x  int atom2x  int flags")
        lines += [f" {a + 1} {b + 1} 1" for a, b in bonds] + [" 0 0 0"]
        lines.append(f"!entry.{unit}.unit.positions table  dbl x  dbl y  dbl z")
        lines += [f" {x!r} {y!r} {z!r}" for x, y, z in xyz]
    return "\n".join(lines) + "\n"


def libraries():
    a, g = geometry()
    water = [("O", "OW", 8, -0.834), ("H1", "HW", 1, 0.417), ("H2", "HW", 1, 0.417)]
    sites = [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]
    xyz = [(6.0 * x + dx, 6.0 * y + dy, 6.0 * z) for x, y, z in sites for dx, dy in ((0.0, 0.0), (0.9572, 0.0), (-0.24, 0.9266))]
    box = [w for _ in sites for w in water]
    ions = [("Na+", [("Na+", "Na+", 11, 1.0)], [], [(0.0, 0.0, 0.0)]), ("Cl-", [("Cl-", "Cl-", 17, -1.0)], [], [(0.0, 0.0, 0.0)])]
    return {"n_terminal": off([("NALA", A, A_BONDS, a)]), "c_terminal": off([("CGLY", G, G_BONDS, g)]), "ion": off(ions), "water_box": off([("WBOX", box, [], xyz)])}


def frcmod():
    kinds = ["NA", "HN", "CA", "HA", "CB", "HB", "CO", "OD"]
    mass = {"NA": 14.01, "HN": 1.008, "CA": 12.01, "HA": 1.008, "CB": 12.01, "HB": 1.008, "CO": 12.01, "OD": 16.0, "OW": 16.0, "HW": 1.008, "Na+": 22.99, "Cl-": 35.45}
    lj = {"NA": (1.82, 0.17), "HN": (0.6, 0.0157), "CA": (1.9, 0.11), "HA": (1.4, 0.0157), "CB": (1.9, 0.1), "HB": (1.5, 0.0157), "CO": (1.9, 0.09), "OD": (1.66, 0.21), "OW": (1.7683, 0.152), "HW": (0.0, 0.0), "Na+": (1.37, 0.087), "Cl-": (2.51, 0.036)}
    lines = ["made up", "MASS", *[f"{k:<2} {m}" for k, m in mass.items()], "", "BOND"]
    lines += [f"{a:<2}-{b:<2}  {300 + 10 * i + j}.0   1.4{i}" for i, a in enumerate(kinds) for j, b in enumerate(kinds) if a <= b] + ["HW-OW  553.0   0.9572"]
    lines += ["", "ANGL", *[f"{a:<2}-{b:<2}-{c:<2}   50.0   11{i}.5" for i, a in enumerate(kinds) for b, c in product(kinds, kinds) if a <= c], "HW-OW-HW  100.0  104.52"]
    lines += ["", "DIHE", *[f"X -{b:<2}-{c:<2}-X    4    {i}.50   180.0   2.000" for i, b in enumerate(kinds) for c in kinds if b <= c], "NA-CA-CO-OD   1   0.80     0.0   -1.000", "NA-CA-CO-OD   1   0.08   180.0    3.000"]
    lines += ["", "IMPR", "X -X -CO-OD          10.5   180.0   2.0", "", "NONB", *[f"  {k:<3} {r}  {e}  note" for k, (r, e) in lj.items()], ""]
    return "\n".join(lines)


def atom_line(serial, name, res, chain, number, xyz, element="", record="ATOM", altloc=" ", icode=" ", occ=1.0):
    return f"{record:<6}{serial:>5} {name:<4}{altloc}{res:>3} {chain}{number:>4}{icode}   {xyz[0]:>8.3f}{xyz[1]:>8.3f}{xyz[2]:>8.3f}{occ:>6.2f}  0.00          {element:>2}"


def pdb(hydrogens=False, drop=()):
    a, g = geometry()
    lines, serial = ["REMARK made up"], 0
    for res, number, atoms, xyz in (("ALA", 1, A, a), ("GLY", 2, G, g)):
        for (name, _, element, _), p in zip(atoms, xyz):
            serial += 1
            if (element != 1 or hydrogens) and (res, name) not in drop:
                lines.append(atom_line(serial, name, res, "A", number, p))
    return "\n".join([*lines, "TER", "END", ""])
