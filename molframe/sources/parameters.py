"""Force-field parameters from legacy parameter files and frcmod files, as dimension tables in load order.

Masses, bonds, angles and nonbonded values: the last loaded wins. Torsions and impropers accumulate: every
row of every file stays, in load order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.operators.lookup import with_aliases
from molframe.operators.relational import block_ids, last_wins, running_state
from molframe.sources.pdb import numbered_lines, texts

#: Section words and the widths of the typed prefixes.
SECTIONS = {"MASS": "mass", "BOND": "bond", "ANGL": "angle", "ANGLE": "angle", "DIHE": "dihedral", "IMPR": "improper", "IMPROPER": "improper", "NONB": "nonbond", "NONBON": "nonbond"}
WIDTHS = {2: 5, 3: 8, 4: 11}
LEGACY = ["mass", "bond", "angle", "dihedral", "improper"]


@dataclass
class Parameters:
    """masses(t, mass); bonds(t1, t2, force, length); angles(t1..t3, force, degrees);
    torsions, impropers(t1..t4, load_order, force, phase_degrees, periodicity); nonbonded(t, radius, epsilon)."""

    masses: DataFrame
    bonds: DataFrame
    angles: DataFrame
    torsions: DataFrame
    impropers: DataFrame
    nonbonded: DataFrame


def _typed(n: int) -> tuple[Column, Column]:
    """(types, leading numbers) of a line with a prefix of n types; types are null where the prefix does not fit."""
    w = WIDTHS[n]
    types = F.transform(F.split(F.substring("row", 1, w), "-"), lambda t: F.trim(t))
    fits = (F.length("row") >= w) & (F.size(types) == n) & ~F.exists(types, lambda t: t == "")
    words = F.split(F.trim(F.substring(F.col("row"), w + 1, 1000)), r"\s+")
    numbers = F.transform(words, lambda x: x.try_cast("double"))
    stop = F.array_position(F.transform(numbers, lambda x: x.isNull().cast("int")), 1)
    lead = F.when(stop > 0, F.slice(numbers, F.lit(1), (stop - 1).cast("int"))).otherwise(numbers)
    return F.when(fits, types), lead


def _rows(lines: DataFrame) -> DataFrame:
    """(file, line_no, section, row): text before `!`, without blanks at its end; marks and empty rows go."""
    row = F.rtrim(F.split("line", "!")[0])
    out = lines.withColumn("row", row)
    return out.where((F.trim("row") != "") & ~F.ltrim("row").startswith("MOD4") & (F.trim("row") != "END"))


def _frcmod(lines: DataFrame) -> DataFrame:
    word = F.trim("line")
    named = F.coalesce(*[F.when(word == k, F.lit(v)) for k, v in SECTIONS.items()])
    tagged = running_state(lines.where("line_no > 1"), ["sid"], ["line_no"], named, "section")
    return _rows(tagged.where(named.isNull() & F.col("section").isNotNull()))


def _legacy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, aliases): blank-line blocks by place; the sixth names aliases, it and later ones with nonbonded rows hold those."""
    blank = F.trim("line") == ""
    text = lines.withColumn("blank", blank)
    starts = running_state(text, ["sid"], ["line_no"], F.when(F.col("blank"), F.col("line_no")), "gap")
    starts = starts.where("NOT blank").withColumn("gap", F.coalesce("gap", F.lit(0)))
    body = starts.join(starts.groupBy("sid", "gap").agg(F.min("line_no").alias("begin")), ["sid", "gap"]).select("sid", "line_no", "line", "begin")
    body = block_ids(body, ["sid"], ["line_no"], F.col("line_no") == F.col("begin"), "block").withColumn("block", F.col("block") - 1)
    words = F.split(F.trim("line"), r"\s+")
    nonbond = (F.size(words) >= 3) & ~words[0].isin("MOD4", "RE", "END") & F.try_element_at(words, F.lit(2)).try_cast("double").isNotNull() & F.try_element_at(words, F.lit(3)).try_cast("double").isNotNull()
    late = body.where("block >= 5").groupBy("sid", "block").agg(F.max((nonbond | F.ltrim("line").startswith("MOD4")).cast("int")).alias("nb")).where("nb = 1")
    section = F.coalesce(*[F.when(F.col("block") == i, F.lit(s)) for i, s in enumerate(LEGACY)])
    early = body.where("block < 5 AND NOT (block = 0 AND line_no = begin)").select("sid", "line_no", "line", section.alias("section"))
    rows = early.unionByName(body.join(late, ["sid", "block"]).select("sid", "line_no", "line", F.lit("nonbond").alias("section")))
    alias = body.where("block = 5").select("line_no", words[0].alias("source"), F.explode(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).alias("alias"))
    return _rows(rows), last_wins(alias, ["alias"], "line_no")


def load(spark: SparkSession, files: list[tuple[str, str]]) -> Parameters:
    """Parameters of files (kind, text) in load order; kind is `legacy` or `frcmod`."""
    rows, aliases = None, None
    for i, (kind, text) in enumerate(files):
        lines = numbered_lines(texts(spark, {str(i): text}))
        if kind == "legacy":
            got, named = _legacy(lines)
            named = named.withColumn("load", F.lit(i))
            aliases = named if aliases is None else aliases.unionByName(named)
        else:
            got = _frcmod(lines)
        got = got.select((F.lit(i) * 10_000_000 + F.col("line_no")).cast("long").alias("load_order"), "section", "row")
        rows = got if rows is None else rows.unionByName(got)
    words = F.split(F.trim("row"), r"\s+")
    num = lambda i: F.try_element_at(words, F.lit(i)).try_cast("double")
    part = lambda s: rows.where(F.col("section") == s)
    masses = part("mass").where(num(2).isNotNull()).select(words[0].alias("t"), num(2).alias("mass"), "load_order")

    def typed(section: str, n: int, least: int, values: dict[str, Column]) -> DataFrame:
        t, v = _typed(n)
        got = part(section).select("load_order", t.alias("t"), v.alias("v")).where(F.col("t").isNotNull() & (F.size("v") >= least))
        return got.select(*[F.col("t")[i].alias(f"t{i + 1}") for i in range(n)], "load_order", *[c.alias(k) for k, c in values.items()])

    v = F.col("v")
    bonds = typed("bond", 2, 2, {"force": v[0], "length": v[1]}).select(F.least("t1", "t2").alias("t1"), F.greatest("t1", "t2").alias("t2"), "load_order", "force", "length")
    angles = typed("angle", 3, 2, {"force": v[0], "degrees": v[1]})
    torsions = typed("dihedral", 4, 4, {"force": v[1] / F.greatest(F.abs(v[0]), F.lit(1.0)), "phase_degrees": v[2], "periodicity": F.round(F.abs(v[3])).cast("int")})
    impropers = typed("improper", 4, 3, {"force": v[0], "phase_degrees": v[1], "periodicity": F.round(F.abs(v[2])).cast("int")})
    nonbonded = part("nonbond").where((F.size(words) >= 3) & ~words[0].isin("MOD4", "RE", "END") & num(2).isNotNull() & num(3).isNotNull()).select(words[0].alias("t"), num(2).alias("radius"), num(3).alias("epsilon"), "load_order")
    nonbonded = last_wins(nonbonded, ["t"], "load_order")
    if aliases is not None:
        nonbonded = with_aliases(nonbonded, last_wins(aliases, ["alias"], "load"), "t")
    return Parameters(last_wins(masses, ["t"], "load_order"), last_wins(bonds, ["t1", "t2"], "load_order"), last_wins(angles, ["t1", "t2", "t3"], "load_order"), torsions, impropers, nonbonded)


def from_topology(spark: SparkSession, tables: dict[str, list[tuple]]) -> Parameters:
    """Parameters given as Python rows, for instance those resolved in a finished topology."""
    return Parameters(
        spark.createDataFrame(tables.get("masses", []), "t string, mass double"),
        spark.createDataFrame(tables.get("bonds", []), "t1 string, t2 string, force double, length double"),
        spark.createDataFrame(tables.get("angles", []), "t1 string, t2 string, t3 string, force double, degrees double"),
        spark.createDataFrame(tables.get("torsions", []), "t1 string, t2 string, t3 string, t4 string, load_order long, force double, phase_degrees double, periodicity int"),
        spark.createDataFrame(tables.get("impropers", []), "t1 string, t2 string, t3 string, t4 string, load_order long, force double, phase_degrees double, periodicity int"),
        spark.createDataFrame(tables.get("nonbonded", []), "t string, radius double, epsilon double"),
    )
