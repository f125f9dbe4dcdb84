"""Topology files: sections by name, and the tables that they hold."""

from __future__ import annotations

import math
import re

from molframe.schema import CHARGE_SCALE


def read_sections(text: str) -> dict[str, list]:
    """%FLAG sections: numbers by their FORMAT, strings in fields of its width."""
    out: dict[str, list] = {}
    name, width, kind = None, 0, "a"
    for line in text.splitlines():
        if line.startswith("%FLAG"):
            name = line.split()[1]
            out[name] = []
        elif line.startswith("%FORMAT"):
            m = re.search(r"\((\d+)([aIEF])(\d+)", line)
            kind, width = m[2], int(m[3])
        elif name and not line.startswith("%"):
            parts = [line[i : i + width] for i in range(0, len(line.rstrip("\n")), width)]
            if kind == "a":
                out[name] += [p.strip() for p in parts]
            else:
                out[name] += [int(p) if kind == "I" else float(p) for p in parts if p.strip()]
    return out


def tables(text: str) -> dict[str, list[tuple]]:
    """atoms, bonds, angles and dihedrals with resolved parameters, as rows."""
    s = read_sections(text)
    n = s["POINTERS"][0]
    grouped = lambda names, k: [tuple(v[i : i + k]) for name in names for v in [s.get(name, [])] for i in range(0, len(v), k)]
    starts = s["RESIDUE_POINTER"]
    residue = [sum(1 for x in starts if x - 1 <= i) - 1 for i in range(n)]
    types = len(set(s["ATOM_TYPE_INDEX"]))
    radius, epsilon = [], []
    for i in range(n):
        t = s["ATOM_TYPE_INDEX"][i]
        k = s["NONBONDED_PARM_INDEX"][(t - 1) * types + t - 1] - 1
        a, b = s["LENNARD_JONES_ACOEF"][k], s["LENNARD_JONES_BCOEF"][k]
        radius.append((2 * a / b) ** (1 / 6) / 2 if b else 0.0)
        epsilon.append(b * b / (4 * a) if a else 0.0)
    atoms = [(i, s["ATOM_NAME"][i], s["AMBER_ATOM_TYPE"][i], s["ATOMIC_NUMBER"][i], residue[i], s["CHARGE"][i] / CHARGE_SCALE, s["MASS"][i], radius[i], epsilon[i]) for i in range(n)]
    bonds = [(a // 3, b // 3, s["BOND_FORCE_CONSTANT"][k - 1], s["BOND_EQUIL_VALUE"][k - 1]) for a, b, k in grouped(["BONDS_INC_HYDROGEN", "BONDS_WITHOUT_HYDROGEN"], 3)]
    angles = [(a // 3, b // 3, c // 3, s["ANGLE_FORCE_CONSTANT"][k - 1], s["ANGLE_EQUIL_VALUE"][k - 1]) for a, b, c, k in grouped(["ANGLES_INC_HYDROGEN", "ANGLES_WITHOUT_HYDROGEN"], 4)]
    dihedrals = [
        (a // 3, b // 3, abs(c) // 3, abs(d) // 3, s["DIHEDRAL_FORCE_CONSTANT"][k - 1], int(round(s["DIHEDRAL_PERIODICITY"][k - 1])), s["DIHEDRAL_PHASE"][k - 1], d < 0, s["SCEE_SCALE_FACTOR"][k - 1], s["SCNB_SCALE_FACTOR"][k - 1])
        for a, b, c, d, k in grouped(["DIHEDRALS_INC_HYDROGEN", "DIHEDRALS_WITHOUT_HYDROGEN"], 5)
    ]
    return {"atoms": atoms, "bonds": bonds, "angles": angles, "dihedrals": dihedrals}


def parameter_tables(text: str) -> dict[str, list[tuple]]:
    """Parameters by atom type that a finished topology uses, as `parameters.from_topology` takes them.

    Torsion terms of one type quad are kept in their order, and no term twice."""
    t = tables(text)
    kind = {a[0]: a[2] for a in t["atoms"]}
    out = {"masses": {}, "bonds": {}, "angles": {}, "torsions": {}, "impropers": {}, "nonbonded": {}}
    for a in t["atoms"]:
        out["masses"][a[2]] = (a[2], a[6])
        out["nonbonded"][a[2]] = (a[2], a[7], a[8])
    for i, j, k, r in t["bonds"]:
        p = tuple(sorted((kind[i], kind[j])))
        out["bonds"][p] = (*p, k, r)
    for i, j, k, f, r in t["angles"]:
        p = (kind[i], kind[j], kind[k])
        out["angles"][min(p, p[::-1])] = (*min(p, p[::-1]), f, math.degrees(r))
    for n, (i, j, k, l, f, per, phase, improper, _, _) in enumerate(t["dihedrals"]):
        p = tuple(kind[x] for x in (i, j, k, l))
        p = p if improper else min(p, p[::-1])
        out["impropers" if improper else "torsions"].setdefault((p, f, per, phase), (*p, n, f, math.degrees(phase), per))
    return {k: list(v.values()) for k, v in out.items()}


def read_inpcrd(text: str) -> tuple[list[tuple[float, float, float]], list[float]]:
    """(coordinates, box): 12-column fields after the title and the count."""
    lines = text.splitlines()
    n = int(lines[1].split()[0])
    v = [float(line[i : i + 12]) for line in lines[2:] for i in range(0, len(line.rstrip()), 12)]
    return [tuple(v[i : i + 3]) for i in range(0, 3 * n, 3)], v[3 * n :]
