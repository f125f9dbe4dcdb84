"""The tables of prepared systems."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.operators import graph
from molframe.runtime import cut
from molframe.schema import GB_RADII, GB_RADIUS_AMIDE_H, GB_RADIUS_ELSE, GB_SCREEN, GB_SCREEN_ELSE


@dataclass
class System:
    """atoms: sid, atom_idx, name, atom_type, element, residue, charge, mass, radius, epsilon, x, y, z
    residues: sid, residue, name, number, icode, chain, first_atom, atom_count, component
    bonds: sid, i, j, force, length; angles: sid, i, j, k, force, radians (j the centre)
    dihedrals: sid, ord, i, j, k, l, force, periodicity, phase, improper, scee, scnb
    exclusions: sid, i, j (both directions); info: sid, box_x, box_y, box_z, solute_atoms, waters, sodium, chloride, components
    """

    atoms: DataFrame
    residues: DataFrame
    bonds: DataFrame
    angles: DataFrame
    dihedrals: DataFrame
    exclusions: DataFrame
    info: DataFrame
    violations: DataFrame
    warnings: DataFrame
    decisions: DataFrame | None = None
    extra: dict = field(default_factory=dict)

    TABLES = ("atoms", "residues", "bonds", "angles", "dihedrals", "exclusions", "info")

    def kept(self) -> System:
        """The same with every table cut off its lineage."""
        return replace(self, **{t: cut(getattr(self, t)) for t in self.TABLES})

    def charges(self) -> DataFrame:
        """(sid, charge, solute_charge)."""
        a = self.atoms.join(self.info.select("sid", "solute_atoms"), "sid")
        return a.groupBy("sid").agg(F.sum("charge").alias("charge"), F.sum(F.when(F.col("atom_idx") < F.col("solute_atoms"), F.col("charge"))).alias("solute_charge"))

    def with_coordinates(self, coordinates: DataFrame) -> System:
        """The same with x, y, z from (sid, atom_idx, x, y, z).

        Every atom must get one finite position: otherwise ValueError."""
        from molframe.functions.geometry import finite

        new = coordinates.select("sid", "atom_idx", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"), F.lit(1).alias("new"))
        both = self.atoms.select("sid", "atom_idx", F.lit(1).alias("old")).join(new, ["sid", "atom_idx"], "full")
        if not both.where("old IS NULL OR new IS NULL").isEmpty() or both.count() != self.atoms.count():
            raise ValueError("there must be exactly one position an atom")
        if not new.where(~finite((F.col("nx"), F.col("ny"), F.col("nz")))).isEmpty():
            raise ValueError("coordinates must contain only finite values")
        moved = self.atoms.join(new.drop("new"), ["sid", "atom_idx"]).withColumns({a: F.col(f"n{a}") for a in "xyz"})
        return replace(self, atoms=moved.select(*self.atoms.columns))

    def coordinates(self) -> DataFrame:
        return self.atoms.select("sid", "atom_idx", "x", "y", "z")

    def write(self, path: str) -> None:
        """One Parquet table each under `path`."""
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")


@dataclass
class Derived(System):
    """A system whose torsions follow from its bonds: every path of three bonds, and every triple around a centre as an improper.

    `torsion` holds force, periodicity, phase, scee and scnb as columns of the ends i, j, k, l. Torsions are as many as bonds times the square of
    the bonds of an atom, so they are made together with the positions of their ends and summed where they are made; `dihedrals`
    remains the table of them, as a plan. `one_four` (sid, i, j, scee, scnb) are the ends of its proper torsions, if made already.
    `torsion_of`, if given, is force, periodicity and phase as a function of i, j, k, l for arrays: sums over torsions then make no row for each (`plans/torsions.py`)."""

    torsion: dict = field(default_factory=dict)
    torsion_of: Callable | None = None
    #: The parameters of a torsion depend on i and l by their remainders by this number and by which is smaller, its periodicity on j and k only; 0 if not so.
    torsion_classes: int = 0
    one_four: DataFrame | None = None
    #: What `graph.reached` gives for the bonds, with ends, if made already.
    blocks: DataFrame | None = None

    def ends(self) -> DataFrame:
        """(sid, i, j, scee, scnb): pairs of atoms at the ends of a proper torsion."""
        if self.one_four is not None:
            return self.one_four
        if self.blocks is not None:
            paths = graph.listed(self.blocks, ["sid"], "ends").withColumnRenamed("j", "l")
        else:
            paths = graph.path_ends(self.bonds.select("sid", "i", "j"), ["sid"]).select("sid", F.col("a").alias("i"), F.col("d").alias("l"))
        return paths.select("sid", "i", F.col("l").alias("j"), *[self.torsion[c].alias(c) for c in ("scee", "scnb")])

    def torsions(self, at: DataFrame) -> DataFrame:
        """Torsions of the poses `at` (sid, pose, atom_idx, x, y, z and more) with all columns of their ends as i_x and so on.

        Only bonds with positions at hand travel, so a torsion is made in the task that uses it."""
        pose = ["sid", "pose"]
        own = [c for c in at.columns if c not in (*pose, "atom_idx")]
        atom = lambda e: at.select(*pose, F.col("atom_idx").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in own])
        bonds = self.bonds.select("sid", "i", "j")
        links = cut(graph.adjacency(bonds, ["sid"]).join(atom("n"), ["sid", "n"]))
        link = lambda c, n: links.select(*pose, F.col("c").alias(c), F.col("n").alias(n), *[F.col(f"n_{x}").alias(f"{n}_{x}") for x in own])
        middle = bonds.select("sid", F.col("i").alias("j"), F.col("j").alias("k")).join(atom("j"), ["sid", "j"]).join(atom("k"), [*pose, "k"])
        walks = middle.join(link("j", "i"), [*pose, "j"]).where("i <> k").join(link("k", "l"), [*pose, "k"]).where("l <> j AND l <> i")
        turned, names = F.col("i") > F.col("l"), lambda e: [e, *[f"{e}_{x}" for x in own]]
        either = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for e, o in zip("ijkl", "lkji") for a, b in zip(names(e), names(o))]
        proper = walks.select(*pose, *either, F.lit(False).alias("improper"))
        star = link("k", "i").join(link("k", "j"), [*pose, "k"]).where("i < j").join(link("k", "l"), [*pose, "k"]).where("j < l").join(atom("k"), [*pose, "k"])
        star = star.select(*proper.columns[:-1], F.lit(True).alias("improper"))
        return proper.unionByName(star).withColumns({c: v for c, v in self.torsion.items() if c not in ("scee", "scnb")})


def _by_element(table: dict[int, float], other: float):
    c = F.lit(None).cast("double")
    for k, v in table.items():
        c = F.when(F.col("element") == k, v).otherwise(c)
    return F.coalesce(c, F.lit(other))


def gb_radius():
    """Radius of the implicit-solvent model by element; amide hydrogens (type H) have their own."""
    return F.when((F.col("element") == 1) & (F.col("atom_type") == "H"), GB_RADIUS_AMIDE_H).otherwise(_by_element(GB_RADII, GB_RADIUS_ELSE))


def gb_screen():
    return _by_element(GB_SCREEN, GB_SCREEN_ELSE)
