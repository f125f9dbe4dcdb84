"""Texts of structures and their edits: only what is read is made, and no generated method is too large for the JVM to compile."""

import re

from molframe import system_queries as q
from molframe.plans import structure
from molframe.sources import pdb
from tests.conftest import DATA


def test_lines_as_by_format_string(spark):
    from pyspark.sql import functions as F

    values = [(0.0,), (1.5,), (-0.5,), (9999.999,), (12345.678,), (-1234.5,), (0.0005,), (float("nan"),), (float("inf"),), (1e300,), (None,)]
    df = spark.createDataFrame(values, "x double")
    for r in df.select(q._fixed(F.col("x")).alias("a"), F.format_string("%8.3f", "x").alias("b")).collect():
        assert r.a == r.b
    df = spark.createDataFrame([(1, "N"), (123456, "CA1"), (-3, "HHHHH"), (None, None)], "i int, s string")
    for r in df.select(q._wide("i", 5).alias("a"), F.format_string("%5d", "i").alias("b"), q._wide("s", 4, False).alias("c"), F.format_string("%-4s", "s").alias("d")).collect():
        assert (r.a, r.c) == (r.b, r.d)


def test_lines_are_compiled_and_sorted_by_a_number(spark, monkeypatch):
    """The JVM compiles no method of over 8,000 bytes, and Spark sorts structs within structs with a new ordering for each comparison."""
    seen = []
    monkeypatch.setattr(q, "cut", lambda df: seen.append(df) or df)
    monkeypatch.setattr(q, "_made", {})
    was = spark.conf.get("spark.sql.codegen.wholeStage")
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        q._docs(spark, DATA)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = seen[0]._jdf.queryExecution().explainString(mode)
        assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000
        assert "struct<m:" not in text
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", was)


def test_returns_at_the_ends_of_lines(spark):
    docs = pdb.texts(spark, {"a": "x\r\ny\n", "b": "x\ny\r", "c": "x\n\ny", "d": ""})
    got = {(r.sid, r.line_no): r.line for r in pdb.numbered_lines(docs).collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("b", 1): "x", ("b", 2): "y", ("c", 1): "x", ("c", 2): "", ("c", 3): "y", ("d", 1): ""}


def test_tables_are_made_when_they_are_read(spark, monkeypatch):
    s = q._structure(spark, DATA)
    made = []
    monkeypatch.setattr(pdb, "cut", lambda df: made.append(df.columns) or df)
    out, _, _ = s.append(s, "Z")
    before = [m for m in made if m != s.parsed.links.columns and m != s.parsed.ssbonds.columns]
    assert out.bonds().count() > 0 and out.bonds().count() > 0
    assert "x" not in sum(made, []) and made.count(out.bonds().columns) - before.count(out.bonds().columns) <= 2
    kept = structure.Structure(s.parsed.replaced(links=pdb.Later(lambda: 1 / 0)))
    assert kept.remove_residues_named(["MAN"]).atoms().count() > 0
