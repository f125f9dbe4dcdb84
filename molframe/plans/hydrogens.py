"""Positions of atoms that the input does not give.

In order: the input, the local rules for hydrogens of carbohydrates, the peptide amide rule (computed as
columns before), and a frame of the template laid on the nearest given atoms. The last three look at a
residue's bond graph and its surroundings at once and run per structure with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.schema import PROTEIN
from molframe.sources.templates import Templates

TINY = 1e-8
SHELL = (0.8, 1.85)
STEPS = 24


def unit(v):
    n = math.sqrt(float(np.dot(v, v)))
    return v / n if n > TINY else None


def frame(points: list[np.ndarray]) -> np.ndarray | None:
    """Three axes as rows: along the first two points, then in the plane of the third."""
    if len(points) == 1:
        return np.eye(3)
    one = unit(points[1] - points[0])
    if len(points) == 2:
        one = np.array([1.0, 0, 0]) if one is None else one
        side = unit(np.cross(np.array([0, 0, 1.0]) if abs(one[2]) < 0.9 else np.array([0, 1.0, 0]), one))
        side = np.array([0, 1.0, 0]) if side is None else side
        return np.stack([one, side, np.cross(one, side)])
    if one is None:
        return None
    flat = points[2] - points[0]
    two = unit(flat - np.dot(flat, one) * one)
    return None if two is None else np.stack([one, two, np.cross(one, two)])


class Residue:
    """One residue: template atoms with their template and given positions, and the template's bonds."""

    def __init__(self, rows: pd.DataFrame, bonds):
        self.names = rows["atom_name"].tolist()
        self.element = rows["number_of"].to_numpy()
        self.template = rows[["tx", "ty", "tz"]].to_numpy(float)
        self.given = rows[["x", "y", "z"]].to_numpy(float)
        self.there = rows["there"].notna().to_numpy()
        self.near: list[list[int]] = [[] for _ in self.names]
        for a, b in bonds:
            self.near[a].append(b)
            self.near[b].append(a)

    def heavy_parent(self, h: int) -> int | None:
        return next((k for k in self.near[h] if self.element[k] != 1), None)

    def length(self, h: int, parent: int) -> float:
        return float(np.linalg.norm(self.template[h] - self.template[parent]))

    def by_frame(self, h: int) -> np.ndarray | None:
        """The template's hydrogen carried over by the frame of its parent and the given heavy atoms nearest to it in the bond graph."""
        parent = self.heavy_parent(h)
        if parent is None or self.element[h] != 1:
            return None
        seen, line, anchors = {h, parent}, [parent], []
        while line:
            k = line.pop(0)
            if self.element[k] != 1 and self.there[k]:
                anchors.append(k)
            for m in self.near[k]:
                if m not in seen:
                    seen.add(m)
                    line.append(m)
        if not anchors:
            return None
        if len(anchors) <= 2:
            sets = [anchors]
        else:
            sets = [[anchors[0], anchors[i], anchors[j]] for i in range(1, len(anchors)) for j in range(i + 1, len(anchors))]
        for s in sets:
            a, b = frame([self.template[k] for k in s]), frame([self.given[k] for k in s])
            if a is not None and b is not None:
                return self.given[s[0]] + (a @ (self.template[h] - self.template[s[0]])) @ b
        return None

    def sugar_hydrogens(self, around: np.ndarray) -> dict[int, np.ndarray]:
        """Missing hydrogens of a carbohydrate by their parent's surroundings; `around`: all heavy atoms."""
        groups: dict[int, list[int]] = {}
        for h in range(len(self.names)):
            if self.element[h] == 1 and not self.there[h] and (parent := self.heavy_parent(h)) is not None:
                groups.setdefault(parent, []).append(h)
        out = {}
        for parent in sorted(groups):
            if self.there[parent]:
                out.update(self._group(parent, groups[parent], around))
        return out

    def _group(self, parent: int, hs: list[int], around: np.ndarray) -> dict[int, np.ndarray]:
        at = self.given[parent]
        inside = [k for k in self.near[parent] if self.element[k] != 1 and self.there[k]]
        near = [(k, self.given[k]) for k in inside]
        d2 = ((around - at) ** 2).sum(1)
        shell = np.nonzero((d2 > SHELL[0] ** 2) & (d2 < SHELL[1] ** 2))[0]
        if not inside and len(shell):
            near.append((None, around[shell[np.argmin(d2[shell])]]))
        if len(hs) == 1 and len(inside) >= 2:
            for k in shell:
                if all(((around[k] - q) ** 2).sum() > 1e-8 for _, q in near):
                    near.append((None, around[k]))
        got = None
        if len(near) == 1:
            got = self._rotor(parent, hs, near[0], around)
        elif len(hs) == 1 and len(near) >= 2:
            got = self._single(parent, hs[0], [q for _, q in near])
        elif len(hs) == 2 and len(inside) == 2:
            got = self._pair(parent, hs, inside)
        if got is None:
            got = {h: x for h in hs if (x := self.by_frame(h)) is not None}
        return got

    def _single(self, parent: int, h: int, near: list[np.ndarray]):
        at = self.given[parent]
        if len(near) >= 3:
            a, b, c = near[:3]
            way = unit(np.cross(b - a, c - a))
            if way is not None and np.dot(way, (a + b + c) / 3 - at) > 0:
                way = -way
        else:
            to = [unit(q - at) for q in near]
            way = None if any(v is None for v in to) else unit(-sum(to))
        return None if way is None else {h: at + self.length(h, parent) * way}

    def _pair(self, parent: int, hs: list[int], inside: list[int]):
        at, t = self.given[parent], self.template
        u, v = unit(self.given[inside[0]] - at), unit(self.given[inside[1]] - at)
        if u is None or v is None:
            return None
        centre, normal = unit(-u - v), unit(np.cross(u, v))
        tu, tv = unit(t[inside[0]] - t[parent]), unit(t[inside[1]] - t[parent])
        if centre is None or normal is None or tu is None or tv is None:
            return None
        tn = unit(np.cross(tu, tv))
        if tn is None:
            return None
        w = min(1.0, max(0.0, 1 / (3 * math.sqrt((1 + np.dot(u, v)) / 2))))
        out = {}
        for n, h in enumerate(hs):
            th = unit(t[h] - t[parent])
            if th is None:
                return None
            s = float(np.dot(th, tn))
            sign = math.copysign(1, s) if abs(s) > 1e-6 else (1.0 if n == 0 else -1.0)
            way = unit(w * centre + sign * math.sqrt(1 - w * w) * normal)
            if way is None:
                return None
            out[h] = at + self.length(h, parent) * way
        return out

    def _rotor(self, parent: int, hs: list[int], neighbour, around: np.ndarray):
        """The least crowded of STEPS turns of a group on a tetrahedral cone about its one bond; the first of equals."""
        k, q = neighbour
        at, t = self.given[parent], self.template
        axis = unit(q - at)
        told = np.array([1.0, 0, 0]) if k is None else unit(t[k] - t[parent])
        if axis is None or told is None:
            return None

        def across(v):
            one = unit(np.cross(v, np.array([0, 0, 1.0]) if abs(v[2]) < 0.8 else np.array([0, 1.0, 0])))
            two = None if one is None else unit(np.cross(v, one))
            return None if two is None else (one, two)

        real, old = across(axis), across(told)
        to = [unit(t[h] - t[parent]) for h in hs]
        if real is None or old is None or any(v is None for v in to):
            return None
        others = around[[((around - c) ** 2).sum(1) > 1e-8 for c in (at, q)][0] & [((around - c) ** 2).sum(1) > 1e-8 for c in (at, q)][1]]
        axial = -1 / 3
        radial = math.sqrt(1 - axial * axial)
        start = [math.atan2(np.dot(v, old[1]), np.dot(v, old[0])) for v in to]
        best = None
        for step in range(STEPS):
            spots = []
            for h, a in zip(hs, start):
                a += step * 2 * math.pi / STEPS
                spots.append(at + self.length(h, parent) * (axial * axis + radial * (math.cos(a) * real[0] + math.sin(a) * real[1])))
            score = sum(float((np.maximum(((others - s) ** 2).sum(1), 0.25) ** -6.0).sum()) for s in spots)
            if best is None or score < best[0]:
                best = (score, spots)
        return dict(zip(hs, best[1]))


def place_hydrogens(matched: DataFrame, t: Templates, most_bonds: int = 100_000) -> DataFrame:
    """Rows of `matched` with x, y, z filled where they can be. Template bonds go along with the code, their number is checked."""
    bonds: dict[tuple[str, str], list[tuple[int, int]]] = {}
    rows = t.bonds.select("family", "template", "a", "b").limit(most_bonds + 1).collect()
    if len(rows) > most_bonds:
        raise ValueError("too many template bonds")
    for x in rows:
        bonds.setdefault((x.family, x.template), []).append((x.a, x.b))
    proteins = set(PROTEIN)
    columns = ["sid", "residue", "ord", "name", "atom_type", "element", "charge", "serial", "family", "template", "x", "y", "z"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["residue", "ord"], ignore_index=True)
        xyz = pdf[["x", "y", "z"]].to_numpy(float).copy()
        heavy = pdf["there"].notna().to_numpy() & (pdf["number_of"].to_numpy() != 1)
        around = xyz[heavy]
        for _, part in pdf.groupby("residue", sort=False):
            if part["there"].notna().all():
                continue
            res = Residue(part, bonds.get((part["family"].iloc[0], part["template"].iloc[0]), []))
            sugar = {} if part["name"].iloc[0] in proteins else res.sugar_hydrogens(around)
            for h, row in enumerate(part.itertuples()):
                if not res.there[h]:
                    spot = sugar.get(h)
                    if spot is None and not math.isnan(row.ax if row.ax is not None else math.nan):
                        spot = np.array([row.ax, row.ay, row.az])
                    if spot is None:
                        spot = res.by_frame(h)
                    if spot is not None:
                        xyz[row.Index] = spot
        out = pdf.assign(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])
        return pd.DataFrame({"sid": out["sid"], "residue": out["residue"], "ord": out["ord"], "name": out["atom_name"], "atom_type": out["atom_type"], "element": out["number_of"], "charge": out["charge"], "serial": out["serial"].astype("Int64"), "family": out["family"], "template": out["template"], "x": out["x"], "y": out["y"], "z": out["z"]})[columns]

    need = matched.select("sid", "residue", "ord", "name", "atom_name", "atom_type", "number_of", "charge", "serial", "family", "template", "tx", "ty", "tz", "x", "y", "z", "there", "ax", "ay", "az")
    out = need.groupBy("sid").applyInPandas(fill, "sid string, residue int, ord int, name string, atom_type string, element int, charge double, serial long, family string, template string, x double, y double, z double")
    return out.withColumns({a: F.nanvl(F.col(a), F.lit(None).cast("double")) for a in "xyz"})
