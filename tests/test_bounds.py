"""Operators whose work or memory is to grow with their rows, against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from molframe.operators import graph, lookup, radius


def test_edges_are_contracted_as_they_come(spark, monkeypatch):
    """a task holds a bounded number of edges, or twice its forest; stars are those of all edges at once."""
    r = random.Random(8)
    edges = [(a, b) for a, b in ((r.randrange(400), r.randrange(400)) for _ in range(3000)) if a < b and a % 5 == b % 5]
    df = spark.createDataFrame(edges, "u long, v long").coalesce(1)
    monkeypatch.setattr(graph, "_joined", _bounded(graph._joined, 1000))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted((x.u, x.v) for x in graph.contracted(df, most=100).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    root = list(range(400))
    for _ in range(20):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == sorted((x, i) for i, x in enumerate(root) if x != i)
    rooted = graph.components(spark.range(400), df.select(F.col("v").alias("i"), F.col("u").alias("j")).unionAll(df.select(F.col("u").alias("i"), F.col("v").alias("j"))))
    assert {x.id: x.root for x in rooted.collect()} == dict(enumerate(root))


def _bounded(joined, most):
    def kept(a, b, n):
        assert len(a) <= most, "too many edges at once"
        return joined(a, b, n)

    return kept


def test_nearest_begins_with_small_cubes(spark, monkeypatch):
    """pairs that are looked at grow with the points of a crowd, not with their square; far ones, ties and points in one place are as before."""
    r = random.Random(5)
    rows = [(i, *(r.uniform(0, 1) for _ in range(3))) for i in range(1500)] + [(1500, 1.9, 0.5, 0.5), (1501, 9.0, 9.0, 9.0), (1502, 0.5, 0.5, 0.5), (1503, 0.5, 0.5, 0.5), (1504, 0.5, 0.5, 0.5)]
    p = spark.createDataFrame(rows, "id int, x double, y double, z double")
    seen, join = [], radius.radius_join
    monkeypatch.setattr(radius, "radius_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    got = {x.id: (x.other, x.d2) for x in radius.nearest(p, p.withColumnRenamed("id", "other"), "id", "other", 1.0).collect()}
    xyz = np.array([q[1:] for q in rows])
    want = {}
    for i, a in enumerate(xyz):
        d = ((a - xyz) ** 2).sum(1)
        d[i] = np.inf
        k = int(np.argmin(d))  # the first of equals
        if d[k] <= 1.0:
            want[i] = (k, d[k])
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()} and 1501 not in got and got[1500][1] > 0.7
    assert all(math.isclose(got[i][1], want[i][1], abs_tol=1e-12) for i in want)
    assert sum(df.count() for df in seen) < 100 * len(rows)


def test_angles_of_a_centre_by_tiles(spark):
    """the same sums for every size of a tile; a neighbour in the centre's place counts as the SQL has it, 0 degrees."""
    r = random.Random(6)
    xyz = {i: [r.uniform(0, 1) for _ in range(3)] for i in range(25)}
    xyz[24] = xyz[3]
    edges = [(i, j) for i in xyz for j in xyz if i < j and (i == 3 or r.random() < 0.4)]
    near = {c: [b if a == c else a for a, b in edges if c in (a, b)] for c in xyz}
    want = {}
    for c, ns in near.items():
        total, n = 0.0, 0
        for k, i in enumerate(ns):
            for j in ns[k + 1 :]:
                u, v = (np.array(xyz[e]) - np.array(xyz[c]) for e in (i, j))
                w = np.linalg.norm(u) * np.linalg.norm(v)
                total, n = total + (math.degrees(math.acos(max(-1, min(1, u @ v / w)))) if w else 0.0), n + 1
        if n:
            want[c] = (n, total)
    p = spark.createDataFrame([(i, *v) for i, v in xyz.items()], "id long, x double, y double, z double")
    e = spark.createDataFrame(edges, "i long, j long")
    for tile in (4, 1024):
        got = {x.c: (x.n, x.degrees) for x in graph.centre_angles(p, e, tile=tile).collect()}
        assert got.keys() == want.keys() and all(got[c][0] == want[c][0] and math.isclose(got[c][1], want[c][1], abs_tol=1e-5) for c in want)


def test_equal_members_are_looked_up_once(spark):
    """costs are taken for distinct members, in whatever order an item has them."""
    looked = spark.sparkContext.accumulator(0)

    def paid(n):
        looked.add(1)
        return n

    cost = F.udf(paid, "int")
    items = spark.createDataFrame([(i, [["a", "b"], ["b", "a", "b"], ["c"], ["z"]][i % 4], [1, None][i % 2]) for i in range(400)], "id int, members array<string>, more int")
    sets = spark.createDataFrame([("s", ["a", "b", "c"], 3), ("t", ["a", "b"], 2), ("r", ["c"], 3)], "name string, held array<string>, n int")
    got = {x.id: (x.name, x.cost) for x in lookup.containing_set(items, ["id"], "members", sets, "name", "held", cost(F.col("n")), ["more"]).collect()}
    assert got == {i: ("t", 2) if i % 4 < 2 else ("r", 3) for i in range(400) if i % 4 != 3}
    assert 0 < looked.value < 40
