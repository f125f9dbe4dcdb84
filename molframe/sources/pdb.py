"""PDB text as keyed tables: record scan, model choice, altloc choice, residues, declared connectivity."""

from __future__ import annotations

from collections.abc import Callable
from copy import copy
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.errors import require_none, violation
from molframe.functions.order import total_order
from molframe.functions.text import char_at, field, parsed
from molframe.operators.relational import best_row, first_seen, part_rank, part_state, running_state
from molframe.options import BuildOptions
from molframe.runtime import cut
from molframe.schema import ATOM_FIELDS, LINK_FIELDS, PROTEIN, SSBOND_FIELDS

#: Characters of a text beyond which a structure is no longer read by one task.
GIANT = 50_000_000


class Later:
    """A table that is made and kept (`cut`) when it is first read, so that one that nothing reads is never made."""

    def __init__(self, plan: Callable[[], DataFrame]):
        self.plan, self.df = plan, None

    def made(self) -> DataFrame:
        if self.df is None:
            self.df = cut(self.plan())
        return self.df


@dataclass
class ParsedPdb:
    """Tables of the selected model.

    atoms: sid, serial, pos (rank by serial), residue_idx, name, chain, number, icode, element, x, y, z
    residues: sid, residue_idx, chain, number, icode, name
    conect: sid, a, b (serials); links: sid, ord, ends; ssbonds: sid, ord, ends
    """

    atoms: DataFrame
    residues: DataFrame
    conect: DataFrame
    links: DataFrame
    ssbonds: DataFrame
    warnings: DataFrame
    violations: DataFrame

    def __getattribute__(self, name: str):
        v = object.__getattribute__(self, name)
        return v.made() if isinstance(v, Later) else v

    def replaced(self, **tables) -> ParsedPdb:
        """The same with other tables, or a `Later`; none of them is read."""
        out = copy(self)
        vars(out).update(tables)
        return out

    def chains(self) -> DataFrame:
        return self.residues.groupBy("sid").agg(F.array_sort(F.collect_set("chain")).alias("chains"))


def read_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(sid, text): whole files; the id is the path's last part without its ending."""
    df = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return df.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("sid"), F.col("value").alias("text"))


def texts(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(named.items()), "sid string, text string")


def numbered_lines(docs: DataFrame) -> DataFrame:
    """(sid, line_no from 1, line)."""
    lines = F.split(F.regexp_replace("text", r"\n$", ""), "\n")
    # asked once of a text and not of every line
    lines = F.when(F.col("text").contains("\r"), F.transform(lines, lambda x: F.regexp_replace(x, "\r$", ""))).otherwise(lines)
    return docs.select("sid", F.posexplode(lines).alias("line_no", "line")).select("sid", F.col("line_no") + 1, "line").toDF("sid", "line_no", "line")


def with_models(lines: DataFrame, large: bool = False) -> DataFrame:
    """Lines with `model`: that of the last MODEL record, 0 after ENDMDL and before the first MODEL of a file that has one, else 1; null where MODEL does not parse."""
    is_model, is_end = F.col("line").startswith("MODEL "), F.col("line").startswith("ENDMDL")
    number = parsed(F.col("line"), 10, 14, "int")
    state = F.when(is_model, F.coalesce(number, F.lit(-1))).when(is_end, 0)
    if large:
        has = lines.where(is_model).select("sid", F.lit(0).alias("__outside")).distinct()
        lines = part_state(lines, ["sid"], ["line_no"], state, "model").join(has, "sid", "left")
        outside = F.coalesce("__outside", F.lit(1))
    else:
        lines = running_state(lines, ["sid"], ["line_no"], state, "model")
        outside = F.when(F.max(is_model.cast("int")).over(W.partitionBy("sid")) == 1, 0).otherwise(1)
    return lines.withColumn("model", F.coalesce("model", outside)).drop("__outside").withColumn("marker", is_model | is_end)


def models(lines: DataFrame) -> DataFrame:
    """(sid, models): the numbers of the file's MODEL records, [1] without any."""
    n = F.when(F.col("line").startswith("MODEL "), parsed(F.col("line"), 10, 14, "int"))
    got = lines.groupBy("sid").agg(F.collect_set(n).alias("m"))
    return got.select("sid", F.when(F.size("m") > 0, F.array_sort("m")).otherwise(F.array(F.lit(1))).alias("models"))


def altloc_rank(altloc: Column, requested: str | None) -> Column:
    rank = F.when(altloc.isNull(), 4)
    rank = rank.when(altloc == requested, 3) if requested else rank.when(altloc == "A", 2)
    return rank.otherwise(1)


def _ends(df: DataFrame, fields, icodes) -> DataFrame:
    line = F.col("line")
    ok = F.lit(True)
    for n, a, b, k in fields:
        if k == "int":
            ok = ok & parsed(line, a, b, k).isNotNull()
    cols = [parsed(line, a, b, k).alias(n) for n, a, b, k in fields]
    return df.where(ok).select("sid", F.col("line_no").alias("ord"), *cols, *[char_at(line, i).alias(n) for n, i in icodes])


def parse(docs: DataFrame, options: BuildOptions | None = None, strict: bool = False, giant: int = GIANT, keep: bool = False) -> ParsedPdb:
    """Tables of `docs` (sid, text). Problems become violations; with `strict` the first is raised. With `keep` texts are gone through twice and the tables kept.

    Where a text has over `giant` characters, models, ranks and residue numbers are found by ranges of a structure's lines and atoms; else a structure is one task."""
    o = options or BuildOptions()
    lines = numbered_lines(docs)
    large = not docs.where(F.length("text") > giant).isEmpty()
    line = F.col("line")

    def of(*kinds: str) -> DataFrame:
        """Lines of these kinds with their model; the markers go along, and no other line does."""
        some = reduce(lambda x, y: x | y, [line.startswith(k) for k in ("MODEL ", "ENDMDL", *kinds)])
        return with_models(lines.where(some), large)

    mine = lambda *kinds: of(*kinds).where(F.col("model") == o.model).where(~F.col("marker"))
    tagged, records = of(), mine("ATOM  ", "HETATM")
    raw = records.select("sid", "line_no", F.length("line").alias("len"), *[parsed(line, a, b, k).alias(n) for n, a, b, k in ATOM_FIELDS], char_at(line, 26).alias("icode"), char_at(line, 16).alias("altloc"))
    guess = F.upper(F.coalesce(F.nullif(F.regexp_extract("name", r"^[0-9]*(.)", 1), F.lit("")), F.lit("X")))
    raw = raw.withColumn("element", F.when(F.col("element") == "", guess).otherwise(F.col("element"))).withColumn("occupancy", F.coalesce("occupancy", F.lit(0.0)))
    number_ok = F.col("serial").isNotNull() & F.col("number").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    bad = raw.where((F.col("len") < 54) | ~number_ok)
    why = F.when(F.col("len") < 54, "ends before its coordinates").when(F.col("serial").isNull(), "has no serial that parses").when(F.col("number").isNull(), "has no residue number that parses").otherwise("has a coordinate that does not parse")
    problems = violation(bad, "invalid_pdb", F.col("line_no"), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" "), why))
    problems = problems.unionByName(violation(models(lines).where(~F.array_contains("models", o.model)), "model_not_found", F.lit(o.model), F.lit(f"there is no MODEL {o.model}")))
    problems = problems.unionByName(violation(tagged.where("model = -1 AND marker"), "invalid_pdb", F.col("line_no"), F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" has a MODEL without a number"))))

    hydrogen = F.upper("element").isin("H", "D")
    protein = F.col("residue_name").isin(PROTEIN)
    good = raw.where((F.col("len") >= 54) & number_ok)
    kept = good.where(~(hydrogen & protein))
    key = ["sid", "chain", "number", "icode", "name"]
    order = [altloc_rank(F.col("altloc"), o.altloc).desc(), total_order(F.col("occupancy")).desc(), F.col("altloc").asc_nulls_first(), "line_no"]
    chosen = best_row(kept, key, order, "candidates")
    by = ["serial", "chain", "number", "icode", "name"]
    if large:
        ordered = part_rank(chosen, ["sid"], by, "pos").withColumn("pos", F.col("pos").cast("int"))
    else:
        ordered = chosen.withColumn("pos", F.row_number().over(W.partitionBy("sid").orderBy(*by)) - 1)
    rkey = ["sid", "chain", "number", "icode"]
    if large:
        residues = first_seen(ordered, rkey[:1], rkey[1:], "pos", {"name": F.col("residue_name")}, "residue_idx", True).select("sid", "residue_idx", "chain", "number", "icode", "name")
        r = residues.select(F.col("sid").alias("__s"), F.col("chain").alias("__c"), F.col("number").alias("__n"), F.col("icode").alias("__i"), "residue_idx")
        same = (F.col("sid") == F.col("__s")) & (F.col("chain") == F.col("__c")) & (F.col("number") == F.col("__n")) & F.col("icode").eqNullSafe(F.col("__i"))
        atoms = ordered.join(r, same)
    else:
        # the rows lie by structure already, so residues are numbered where they lie
        residues = first_seen(ordered, rkey[:1], rkey[1:], "pos", {"name": F.col("residue_name")}, "residue_idx").select("sid", "residue_idx", "chain", "number", "icode", "name")
        atoms = ordered.withColumn("__first", F.min("pos").over(W.partitionBy(*rkey))).withColumn("residue_idx", F.dense_rank().over(W.partitionBy("sid").orderBy("__first")) - 1)
        # as by the join of before, no atom without a chain or a number is in a residue
        if keep:
            atoms = cut(atoms.select("sid", "serial", "pos", "residue_idx", "name", "chain", "number", "icode", "element", "x", "y", "z", "__first", "residue_name"))
            residues = atoms.where("pos = __first").select("sid", "residue_idx", "chain", "number", "icode", F.col("residue_name").alias("name"))
        atoms = atoms.where("chain IS NOT NULL AND number IS NOT NULL")
    atoms = atoms.select("sid", "serial", "pos", "residue_idx", "name", "chain", "number", "icode", "element", "x", "y", "z")

    chunks = F.transform(F.sequence(F.lit(7), F.greatest(F.length("line"), F.lit(7)), F.lit(5)), lambda i: F.trim(F.substring("line", i, F.lit(5))).try_cast("long"))
    serials = F.filter(chunks, lambda x: x.isNotNull())
    others = mine("CONECT", "LINK  ", "SSBOND")
    if keep:
        others = cut(others.select("sid", "line_no", "line"))
    only = lambda kind: others.where(line.startswith(kind))
    stars = only("CONECT").select("sid", serials.alias("s")).where(F.size("s") > 1)
    conect = stars.select("sid", F.col("s")[0].alias("f"), F.explode(F.slice("s", F.lit(2), F.size("s") - 1)).alias("t")).select("sid", F.least("f", "t").alias("a"), F.greatest("f", "t").alias("b")).distinct()
    links = _ends(only("LINK  "), LINK_FIELDS, [("icode1", 26), ("icode2", 56)])
    ssbonds = _ends(only("SSBOND"), SSBOND_FIELDS, [("icode1", 21), ("icode2", 35)])

    empty = docs.select("sid").join(ordered.select("sid").distinct(), "sid", "left_anti")
    problems = problems.unionByName(violation(empty, "invalid_pdb", F.col("sid"), F.lit("nothing but hydrogen, or nothing, is in the model")))
    counts = good.groupBy("sid").agg(F.count_if(hydrogen & protein).alias("dropped"), F.count_if(hydrogen & ~protein).alias("kept"))
    text = lambda c, s: F.concat(F.col(c).cast("string"), F.lit(s))
    warnings = violation(counts.where("dropped > 0"), "input_hydrogens_rebuilt", F.col("sid"), text("dropped", " hydrogens of proteins are left out and placed anew"))
    warnings = warnings.unionByName(violation(counts.where("kept > 0"), "input_glycan_hydrogens_preserved", F.col("sid"), text("kept", " hydrogens of sugars keep their places where the template has them")))
    place = F.concat(F.col("chain"), F.lit(":"), F.col("number").cast("string"), F.coalesce("icode", F.lit(" ")), F.lit(" "), F.col("name"), F.lit(": selected "), F.coalesce("altloc", F.lit(" ")))
    warnings = warnings.unionByName(violation(ordered.where("candidates > 1"), "alternate_location_selected", F.col("name"), place))
    if keep:
        conect, links, ssbonds = (Later(lambda t=t: t) for t in (conect, links, ssbonds))
        if large:
            atoms, residues = cut(atoms), cut(residues)
    if strict:
        require_none(problems)
    return ParsedPdb(atoms, residues, conect, links, ssbonds, warnings, problems)


def canonical_view(docs: DataFrame, model: int = 1) -> DataFrame:
    """(sid, text): the coordinates of one model, then the connectivity of all, lines padded to 80, END."""
    tagged, line = with_models(numbered_lines(docs)), F.col("line")
    atom = (line.startswith("ATOM  ") | line.startswith("HETATM")) & (F.col("model") == model)
    link = line.startswith("CONECT") | line.startswith("LINK  ") | line.startswith("SSBOND")
    padded = F.when(F.length("line") < 80, F.rpad("line", 80, " ")).otherwise(F.col("line"))
    kept = tagged.where(~F.col("marker") & (atom | link)).select("sid", F.struct(link.cast("int").alias("part"), "line_no", padded.alias("line")).alias("r"))
    joined = kept.groupBy("sid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("body"))
    end = F.lit("END".ljust(80) + "\n")
    return docs.select("sid").join(joined, "sid", "left").select("sid", F.coalesce(F.concat("body", F.lit("\n"), end), end).alias("text"))
