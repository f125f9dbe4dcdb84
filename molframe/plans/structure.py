"""Editable structures: accessors, edits as joins, appending, glycosylation sites, PDB text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.errors import MolframeError, require_none, violation
from molframe.functions.geometry import distance2, vec
from molframe.operators.relational import with_neighbour
from molframe.plans.system import System
from molframe.runtime import cut
from molframe.schema import PROTEIN
from molframe.sources.pdb import Later, ParsedPdb

RID = ["chain", "number", "icode"]
#: Order numbers of links start here that were appended or added, not read; those are no metadata by themselves.
APPENDED, ADDED = 10_000_000, 20_000_000


def _same(a: DataFrame, b: DataFrame, prefix: str = "", suffix: str = "") -> Column:
    """Rows of a whose residue columns (chain{suffix}, ...) name b's ({prefix}chain, ...)."""
    on = a["sid"] == b[f"{prefix}sid"]
    for c in RID:
        on = on & a[f"{c}{suffix}"].eqNullSafe(b[f"{prefix}{c}"])
    return on


@dataclass
class Structure:
    """The tables of a parsed file, its glycosylation sites and free annotations (sid, chain, number, icode, label)."""

    parsed: ParsedPdb
    extra_sites: DataFrame | None = None
    annotations: DataFrame | None = None

    # -- accessors ----------------------------------------------------------------------------

    def atoms(self) -> DataFrame:
        """(sid, serial, name, chain, number, icode, residue_name, element, x, y, z), in order of pos."""
        r = self.parsed.residues.select("sid", "residue_idx", F.col("name").alias("residue_name"))
        return self.parsed.atoms.join(r, ["sid", "residue_idx"]).select("sid", "serial", "name", *RID, "residue_name", "element", "x", "y", "z", "pos", "residue_idx")

    def residues(self) -> DataFrame:
        """Residues with `atoms`, the serials in order."""
        a = self.parsed.atoms.groupBy("sid", "residue_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "serial"))), lambda s: s["serial"]).alias("atoms"))
        return self.parsed.residues.join(a, ["sid", "residue_idx"], "left")

    def bonds(self) -> DataFrame:
        return self.parsed.conect

    def chains(self) -> DataFrame:
        return self.parsed.chains()

    def find_atom(self, wanted: DataFrame) -> DataFrame:
        """(sid, chain, number, icode, name) with `serial`: the first such atom."""
        w = wanted.toDF(*[f"w_{c}" for c in wanted.columns])
        a = self.parsed.atoms
        j = a.join(w, _same(a, w, "w_") & (a["name"] == w["w_name"]))
        return j.groupBy("sid", *RID, "name").agg(F.min_by("serial", "pos").alias("serial"))

    def glycosylation_sites(self) -> DataFrame:
        """(sid, ord, protein_*, glycan_*): links of the file with exactly one end in a protein residue, then added sites."""
        p = self.parsed
        out = p.links.where(F.col("ord") < APPENDED)
        for k in (1, 2):
            r = p.residues.select(*[F.col(c).alias(f"q_{c}") for c in ["sid", *RID]], F.col("name").isin(PROTEIN).alias(f"protein{k}"))
            out = out.join(r, _same(out, r, "q_", str(k))).drop("q_sid", *[f"q_{c}" for c in RID])
        end = lambda k: F.struct(*[F.col(f"{c}{k}").alias(c) for c in [*RID, "atom"]])
        one = out.where("protein1 <> protein2").select("sid", F.col("ord").cast("long").alias("ord"), F.when(F.col("protein1"), end(1)).otherwise(end(2)).alias("p"), F.when(F.col("protein1"), end(2)).otherwise(end(1)).alias("g"))
        flat = one.select("sid", "ord", *[F.col(f"{t}.{c}").alias(f"{n}_{c}") for t, n in (("p", "protein"), ("g", "glycan")) for c in [*RID, "atom"]])
        return flat if self.extra_sites is None else flat.unionByName(self.extra_sites.withColumn("ord", F.lit(1 << 40).cast("long")))

    def glycan_trees(self) -> DataFrame:
        """(sid, ord, chain, residue_ids, attachment): every residue of the glycan's chain that is no protein residue."""
        s = self.glycosylation_sites()
        r = self.parsed.residues.where(~F.col("name").isin(PROTEIN)).select("sid", F.col("chain").alias("glycan_chain"), "residue_idx", F.struct(*RID).alias("id"))
        j = s.join(r, ["sid", "glycan_chain"])
        ids = F.transform(F.sort_array(F.collect_list(F.struct("residue_idx", "id"))), lambda x: x["id"])
        return j.groupBy("sid", "ord", "glycan_chain", F.struct(*[F.col(f"protein_{c}").alias(c) for c in RID]).alias("attachment")).agg(ids.alias("residue_ids")).withColumnRenamed("glycan_chain", "chain")

    # -- edits --------------------------------------------------------------------------------

    def _with(self, **tables: Callable[[], DataFrame]) -> Structure:
        """Other tables, given by what makes them: each is made when it is first read."""
        return replace(self, parsed=self.parsed.replaced(**{k: Later(f) for k, f in tables.items()}))

    def set_positions(self, moved: DataFrame) -> Structure:
        """New x, y, z by (sid, serial); unknown serials are refused."""
        a = self.parsed.atoms
        require_none(violation(moved.join(a, ["sid", "serial"], "left_anti"), "invalid_pdb", F.col("serial"), F.concat(F.lit("atom "), F.col("serial").cast("string"), F.lit(" does not exist"))))
        m = moved.select("sid", "serial", *[F.col(c).alias(f"n{c}") for c in "xyz"])
        return self._with(atoms=lambda: a.join(m, ["sid", "serial"], "left").withColumns({c: F.coalesce(f"n{c}", c) for c in "xyz"}).select(*a.columns))

    def rename_residues(self, names: DataFrame) -> Structure:
        """New names by (sid, chain, number, icode, new_name); unknown residues are refused."""
        n = names.toDF(*[f"w_{c}" for c in names.columns])
        r = self.parsed.residues
        missing = n.join(r, _same(r, n, "w_"), "left_anti")
        require_none(violation(missing.withColumnRenamed("w_sid", "sid"), "invalid_pdb", F.col("w_number"), F.concat(F.lit("residue "), "w_chain", F.lit(":"), F.col("w_number").cast("string"), F.coalesce("w_icode", F.lit("")), F.lit(" does not exist"))))
        out = r.join(n, _same(r, n, "w_"), "left").withColumn("name", F.coalesce("w_new_name", "name")).select(*r.columns)
        return self._with(residues=lambda: out)

    def remove_residues_named(self, names: list[str]) -> Structure:
        """Residues of these names go, with their atoms and every declared bond that touches them."""
        p = self.parsed
        gone = cut(p.residues.where(F.col("name").isin(names)))
        g = gone.select(*[F.col(c).alias(f"g_{c}") for c in ["sid", *RID]])
        keep = ["sid", "residue_idx"]

        def clear(df: DataFrame) -> DataFrame:
            for k in ("1", "2"):
                df = df.join(g, _same(df, g, "g_", k), "left_anti")
            return df

        def bonds() -> DataFrame:
            serials = p.atoms.join(gone.select(*keep), keep, "left_semi").select("sid", "serial")
            con = p.conect
            for c in ("a", "b"):
                con = con.join(serials.withColumnRenamed("serial", c), ["sid", c], "left_anti")
            return con.select("sid", "a", "b")

        return self._with(
            residues=lambda: p.residues.join(gone.select(*keep), keep, "left_anti"),
            atoms=lambda: p.atoms.join(gone.select(*keep), keep, "left_anti"),
            conect=bonds,
            links=lambda: clear(p.links),
            ssbonds=lambda: clear(p.ssbonds),
        )

    def append(self, other: Structure, chain: str) -> tuple[Structure, DataFrame, DataFrame]:
        """(structure, atom map, residue map): all of `other` under a new chain, structure by structure.

        Serials go on after the largest, residue numbers after the largest of that chain; declared bonds
        are carried over, a link or disulfide to a missing residue is refused. Metadata is not merged."""
        if len(chain) != 1:
            raise MolframeError("invalid_pdb", "PDB-compatible chain identifiers must contain one character")
        p, q = self.parsed, other.parsed
        top = p.residues.select("sid").distinct().join(p.atoms.groupBy("sid").agg(F.max("serial").alias("s0"), F.max("pos").alias("p0")), "sid", "left")
        top = top.join(p.residues.groupBy("sid").agg(F.max("residue_idx").alias("r0"), F.max(F.when(F.col("chain") == chain, F.col("number"))).alias("n0")), "sid", "left")
        base = q.residues.select("sid").distinct().join(top, "sid", "left").select("sid", F.coalesce("s0", F.lit(0).cast("long")).alias("s0"), F.coalesce("p0", F.lit(-1)).alias("p0"), F.coalesce("r0", F.lit(-1)).alias("r0"), F.coalesce("n0", F.lit(0)).alias("n0"))
        w = W.partitionBy("sid")
        rank = F.row_number().over(w.orderBy("residue_idx"))
        rmap = q.residues.join(base, "sid").select("sid", "residue_idx", *RID, "name", (F.col("n0") + rank).cast("int").alias("new_number"), (F.col("r0") + rank).cast("int").alias("new_idx"))
        rmap = cut(rmap)
        place = F.row_number().over(w.orderBy("residue_idx", "pos"))
        amap = q.atoms.join(base, "sid").select("sid", "serial", "residue_idx", "name", "element", "x", "y", "z", (F.col("s0") + place).alias("new_serial"), (F.col("p0") + place).cast("int").alias("new_pos"))
        amap = cut(amap)
        null = F.lit(None).cast("string").alias("icode")
        residues = rmap.select("sid", F.col("new_idx").alias("residue_idx"), F.lit(chain).alias("chain"), F.col("new_number").alias("number"), null, "name")
        atoms = amap.join(rmap.select("sid", "residue_idx", "new_idx", "new_number"), ["sid", "residue_idx"]).select("sid", F.col("new_serial").alias("serial"), F.col("new_pos").alias("pos"), F.col("new_idx").alias("residue_idx"), "name", F.lit(chain).alias("chain"), F.col("new_number").alias("number"), null, "element", "x", "y", "z")
        s = amap.select("sid", "serial", "new_serial")
        con = lambda: q.conect.join(s.toDF("sid", "a", "na"), ["sid", "a"]).join(s.toDF("sid", "b", "nb"), ["sid", "b"]).select("sid", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))

        def carried(df: DataFrame, what: str) -> DataFrame:
            out, columns = df, df.columns
            for k in ("1", "2"):
                m = rmap.select(*[F.col(c).alias(f"m_{c}") for c in ["sid", *RID]], F.col("new_number").alias(f"to{k}"))
                out = out.join(m, _same(out, m, "m_", k), "left").drop("m_sid", *[f"m_{c}" for c in RID])
            require_none(violation(out.where("to1 IS NULL OR to2 IS NULL"), "invalid_pdb", F.lit(what), F.lit(f"{what} references a missing residue")))
            changed = {f"chain{k}": F.lit(chain) for k in (1, 2)} | {f"number{k}": F.col(f"to{k}") for k in (1, 2)} | {f"icode{k}": F.lit(None).cast("string") for k in (1, 2)} | {"ord": F.col("ord") + APPENDED}
            return out.withColumns(changed).select(*columns)

        # links and disulfides are checked here, whether or not they are read
        links, ssbonds = carried(q.links, "LINK"), carried(q.ssbonds, "SSBOND")
        out = self._with(
            atoms=lambda: p.atoms.unionByName(atoms),
            residues=lambda: p.residues.unionByName(residues),
            conect=lambda: p.conect.unionByName(con()).distinct(),
            links=lambda: p.links.unionByName(links),
            ssbonds=lambda: p.ssbonds.unionByName(ssbonds),
        )
        return out, amap.select("sid", "serial", "new_serial"), rmap.select("sid", *RID, F.lit(chain).alias("new_chain"), "new_number")

    def add_bonds(self, pairs: DataFrame) -> Structure:
        """Declared bonds (sid, a, b) between existing, distinct serials."""
        have = self.parsed.atoms.select("sid", "serial")
        bad = pairs.where("a = b").select("sid", "a")
        for c in ("a", "b"):
            bad = bad.unionByName(pairs.join(have.withColumnRenamed("serial", c), ["sid", c], "left_anti").select("sid", F.col(c).alias("a")))
        require_none(violation(bad, "invalid_pdb", F.col("a"), F.lit("both ends of a bond have to be atoms of the structure, and not the same one")))
        new = pairs.select("sid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self._with(conect=lambda: self.parsed.conect.unionByName(new).distinct())

    def add_glycosylation_sites(self, sites: DataFrame) -> Structure:
        """Sites (sid, protein_*, glycan_*): each is recorded, its link is added unless it is there already."""
        p = self.parsed
        named = {f"{c}{k}": F.col(f"{t}_{c}") for t, k in (("protein", 1), ("glycan", 2)) for c in [*RID, "atom"]}
        link = sites.select("sid", F.lit(ADDED).alias("ord"), *[v.alias(k) for k, v in named.items()])
        on = link["sid"] == p.links["sid"]
        for c in named:
            on = on & link[c].eqNullSafe(p.links[c])
        new = link.join(p.links, on, "left_anti").select(*p.links.columns)
        kept = sites if self.extra_sites is None else self.extra_sites.unionByName(sites)
        return replace(self._with(links=lambda: p.links.unionByName(new)), extra_sites=kept)

    def update_from(self, s: System) -> Structure:
        """Positions of a prepared system's atoms, by residue and atom name; atoms that it added are ignored."""
        r = s.residues.select("sid", "residue", *RID)
        a = s.atoms.join(r, ["sid", "residue"]).select(*[F.col(c).alias(f"w_{c}") for c in ["sid", *RID, "name"]], *[F.col(c).alias(f"n{c}") for c in "xyz"])
        mine = self.parsed.atoms
        j = mine.join(a, _same(mine, a, "w_") & (mine["name"] == a["w_name"]), "left").withColumns({c: F.coalesce(f"n{c}", c) for c in "xyz"})
        return self._with(atoms=lambda: j.select(*mine.columns))

    # -- text ---------------------------------------------------------------------------------

    def to_pdb(self) -> DataFrame:
        """(sid, text): LINK, then atoms with TER where the chain changes, CONECT, END."""
        p = self.parsed
        a = self.atoms()
        record = F.when(F.col("residue_name").isin(PROTEIN), "ATOM  ").otherwise("HETATM")
        line = F.concat(record, F.lpad(F.col("serial").cast("string"), 5, " "), F.lit(" "), F.rpad("name", 4, " "), F.lit(" "), F.lpad("residue_name", 3, " "), F.lit(" "), F.rpad("chain", 1, " "), F.lpad(F.col("number").cast("string"), 4, " "), F.coalesce("icode", F.lit(" ")), F.lit("   "), *[F.format_string("%8.3f", c) for c in "xyz"], F.lit("  1.00  0.00          "), F.lpad("element", 2, " "))
        lines = a.select("sid", F.lit(1).alias("part"), F.col("residue_idx").alias("o1"), F.col("pos").cast("long").alias("o2"), line.alias("line"))
        ends = with_neighbour(p.residues, ["sid"], ["residue_idx"], {"chain": "nxt"}).where("nxt IS NULL OR nxt <> chain").select("sid", F.lit(1).alias("part"), F.col("residue_idx").alias("o1"), F.lit(1 << 60).alias("o2"), F.lit("TER").alias("line"))
        con = p.conect.select("sid", F.lit(2).alias("part"), F.col("a").cast("int").alias("o1"), F.col("b").alias("o2"), F.concat(F.lit("CONECT"), F.lpad(F.col("a").cast("string"), 5, " "), F.lpad(F.col("b").cast("string"), 5, " ")).alias("line"))
        every = lines.unionByName(ends).unionByName(con).unionByName(self._links())
        body = F.transform(F.sort_array(F.collect_list(F.struct("part", "o1", "o2", "line"))), lambda s: s["line"])
        text = every.groupBy("sid").agg(F.concat(F.array_join(body, "\n"), F.lit("\nEND\n")).alias("text"))
        return text

    def _links(self) -> DataFrame:
        p = self.parsed
        out = p.links
        for k in ("1", "2"):
            r = p.residues.select(*[F.col(c).alias(f"q_{c}") for c in ["sid", *RID]], F.col("name").alias(f"res{k}"), F.col("residue_idx").alias(f"idx{k}"))
            out = out.join(r, _same(out, r, "q_", k), "left").drop("q_sid", *[f"q_{c}" for c in RID])
            at = p.atoms.groupBy("sid", F.col("residue_idx").alias(f"idx{k}"), F.col("name").alias(f"atom{k}")).agg(*[F.min_by(c, "pos").alias(f"{c}{k}_") for c in "xyz"])
            out = out.join(at, ["sid", f"idx{k}", f"atom{k}"], "left")
        d = F.sqrt(distance2(tuple(F.col(f"{c}1_") for c in "xyz"), tuple(F.col(f"{c}2_") for c in "xyz")))
        blank = F.lit(" ")
        end = lambda k: (F.lpad(f"atom{k}", 4, " "), F.lit(" "), F.lpad(F.coalesce(f"res{k}", F.lit("")), 3, " "), F.lit(" "), F.rpad(f"chain{k}", 1, " "), F.lpad(F.col(f"number{k}").cast("string"), 4, " "), F.coalesce(f"icode{k}", blank))
        line = F.concat(F.lit("LINK        "), *end(1), F.lit(" " * 15), *end(2), F.lit(" " * 16), F.coalesce(F.format_string("%5.2f", d), F.lit(" " * 5)), F.lit("  "))
        return out.select("sid", F.lit(0).alias("part"), F.col("ord").cast("int").alias("o1"), F.lit(0).cast("long").alias("o2"), F.when(d.isNull(), F.concat(F.substring(line, 1, 73), F.lit(" " * 7))).otherwise(line).alias("line"))
