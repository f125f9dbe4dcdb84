"""Operators that the queries show only in part, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from molframe.functions.text import read_records, write_records
from molframe.operators import graph, lookup, radius, relational


def test_global_rank(spark):
    r = random.Random(4)
    values = r.sample(range(10**6), 500) + [-5, 10**7]
    got = relational.global_rank(spark.createDataFrame([(v,) for v in values], "v long"), "v", "n", 7)
    assert [(x.v, x.n) for x in got.orderBy("v").collect()] == [(v, i) for i, v in enumerate(sorted(values))]
    assert relational.global_rank(spark.createDataFrame([], "v long"), "v", "n").count() == 0
    seen = relational.first_seen(spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, o int"), [], ["k"], "o", {}, "n")
    assert {(x.k, x.n) for x in seen.collect()} == {("b", 0), ("a", 1)}


def test_ranks_and_state_by_ranges(spark):
    """Three parts, one of a null key, over many ranges; states come seldom, so most ranges take theirs from one before."""
    r = random.Random(8)
    rows = [(s, i, r.choice([None] * 30 + [7, 8])) for s in ("a", "b", None) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "s string, o int, v int")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = relational.part_state(relational.part_rank(df, ["s"], ["o"], "n"), ["s"], ["o"], F.col("v"), "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = set()
    for s in ("a", "b", None):
        state = None
        for n, (_, o, v) in enumerate(sorted((x for x in rows if x[0] == s), key=lambda x: x[1])):
            state = state if v is None else v
            want.add((s, o, n, state))
    assert {(x.s, x.o, x.n, x.t) for x in got} == want and len(got) == len(rows)
    assert relational.part_rank(df.where("false"), ["s"], ["o"], "n").count() == 0


@pytest.mark.parametrize("most", [4096, 4])
def test_radius_join_equals_all_pairs(spark, most):
    r = random.Random(9)
    rows = [(s, i, r.uniform(-3, 3), r.uniform(-3, 3), r.uniform(-1, 1)) for s in ("a", "b") for i in range(60)] + [("a", 60, 0.0, 0.0, 0.0), ("a", 61, 1.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "sid string, id int, x double, y double, z double")
    got = {(x.sid, x.i, x.j) for x in radius.radius_pairs(p, 1.0, "id", ["sid"], most).collect()}
    d2 = lambda u, v: sum((a - b) ** 2 for a, b in zip(u[2:], v[2:]))
    assert got == {(u[0], u[1], v[1]) for u in rows for v in rows if u[0] == v[0] and u[1] < v[1] and d2(u, v) <= 1.0}
    assert ("a", 60, 61) in got
    far = radius.without_near(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.6, "id", ["sid"])
    assert {(x.sid, x.id) for x in far.collect()} == {(u[0], u[1]) for u in rows if u[1] % 2 == 0 and all(d2(u, v) >= 0.36 for v in rows if u[0] == v[0] and v[1] % 2)}


def test_crowded_cells_are_split(spark):
    """Half of the points in one cube: pairs are the same, and no key of the join holds more than `most` of a side (or little more, by chance)."""
    r = random.Random(2)
    rows = [(i, *(r.uniform(0, 0.9) for _ in range(3))) for i in range(300)] + [(i, *(r.uniform(0, 9) for _ in range(3))) for i in range(300, 600)]
    p = spark.createDataFrame(rows, "id int, x double, y double, z double")
    plain = radius.radius_pairs(p, 1.0, "id")
    got = radius.radius_pairs(p, 1.0, "id", most=40)
    order = lambda df: sorted((x.i, x.j, round(x.d2, 9)) for x in df.collect())
    assert order(got) == order(plain) and len(order(got)) > 40_000
    cells = [radius._cells(p, 1.0, o).drop("x", "y", "z") for o in (False, True)]
    a, b, on = radius._salted(*cells, ["__kx", "__ky", "__kz"], 40)
    for side in (a, b):
        assert side.groupBy(*on).count().agg(F.max("count")).first()[0] < 80
    assert radius.all_pairs(p.withColumn("s", F.lit(1)), "id", ["s"], 5).select("i", "j").distinct().count() == 600 * 599 // 2


def test_pair_list_by_part(spark):
    """A third of the parts moves: theirs are made anew, those of the others stay as they are."""
    r = random.Random(6)
    rows = [(s, i, *(r.uniform(0, 4) for _ in range(3))) for s in range(9) for i in range(30)]
    p = spark.createDataFrame(rows, "sid int, id int, x double, y double, z double")
    v = radius.PairList(p, 1.0, 0.4, "id", ["sid"])
    near = p.withColumn("x", F.when(F.col("sid") % 3 == 0, F.col("x") * 1.5).otherwise(F.col("x") + 0.1)).where("sid <> 8 OR id <> 3")
    assert {x.sid for x in v.stale(near).collect()} == {0, 3, 6, 8}
    w = v.updated(near)
    order = lambda df: sorted((x.sid, x.i, x.j, x.d2) for x in df.collect())
    stale = "sid % 3 = 0 OR sid = 8"
    assert order(w.pairs.where(f"NOT ({stale})")) == order(v.pairs.where(f"NOT ({stale})"))
    assert order(w.pairs.where(stale)) == order(radius.radius_pairs(near.where(stale), 1.4, "id", ["sid"]))
    assert not w.needs_rebuild(near.where(stale).unionByName(p.where(f"NOT ({stale})"))) and v.updated(p) is v
    # every pair within the cutoff is in the list, whatever moved
    assert {x[:3] for x in order(radius.radius_pairs(near, 1.0, "id", ["sid"]))} <= {x[:3] for x in order(w.pairs)}
    gone = w.updated(near.where("sid <> 1"))
    assert {x.sid for x in gone.pairs.select("sid").distinct().collect()} == {0, 2, 3, 4, 5, 6, 7, 8}


def test_components_by_part(spark):
    edges = spark.createDataFrame([("p", 1, 2), ("p", 2, 3), ("p", 9, 8), ("q", 1, 3), ("q", 5, 5)] + [("r", i, i + 1) for i in range(60)], "sid string, i long, j long")
    nodes = spark.createDataFrame([(s, i) for s, n in (("p", 10), ("q", 6), ("r", 61)) for i in range(n)], "sid string, id long")
    rows = graph.numbered_components(graph.components(nodes, edges, ["sid"]), ["sid"]).collect()
    root = {(x.sid, x.id): x.root for x in rows}
    assert root["p", 3] == 1 and root["p", 9] == 8 and root["p", 4] == 4 and root["q", 3] == 1 and root["q", 5] == 5
    assert {root["r", i] for i in range(61)} == {0}
    assert max(x.component for x in rows if x.sid == "p") == 6


@pytest.mark.parametrize("partitions", [1, 7])
def test_components_of_random_graphs(spark, partitions):
    """Against a plain search, with edges of several parts in one partition and of one part in several."""
    r = random.Random(partitions)
    edges = [(s, r.randrange(-50, 50), r.randrange(-50, 50)) for s in ("a", "b", None, "c") for _ in range(45)] + [("long", i, i + 1) for i in range(200)]
    df = spark.createDataFrame(edges, "sid string, i long, j long").repartition(partitions)
    near = {}
    for s, a, b in edges:
        near.setdefault((s, a), set()).add((s, b))
        near.setdefault((s, b), set()).add((s, a))
    want = {}
    for start in sorted(near, key=lambda x: (str(x[0]), x[1])):
        if start not in want:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = start[1]
                    todo += near[x]
    flat = graph.canonical(df, ["sid"]).select("sid", F.col("i").alias("u"), F.col("j").alias("v"))
    assert {(x.sid, x.u, x.v) for x in graph.contracted(flat.coalesce(1), ["sid"]).collect()} == {(s, root, i) for (s, i), root in want.items() if root != i}
    nodes = spark.createDataFrame([x for x in near if x[0] is not None], "sid string, id long")
    got = {(x.sid, x.id): x.root for x in graph.components(nodes, df.where("sid IS NOT NULL"), ["sid"]).collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None}


def test_wildcards_prefer_the_most_exact_and_keep_ties(spark):
    q = spark.createDataFrame([("A", "B", "C", "D"), ("A", "B", "B", "A"), ("Z", "Z", "Z", "Z")], "a string, b string, c string, d string")
    k = spark.createDataFrame([(0, "X", "B", "C", "X"), (1, "D", "C", "B", "A"), (2, "A", "B", "C", "D"), (3, "X", "B", "B", "X"), (4, "X", "B", "B", "X")], "o int, w string, x string, y string, z string")
    got = lookup.wildcard_lookup(q, list("abcd"), k, ["w", "x", "y", "z"], "o", [])
    assert sorted((r.a + r.b + r.c + r.d, r.o) for r in got.collect()) == [("ABBA", 3), ("ABBA", 4), ("ABCD", 1), ("ABCD", 2)]


def test_short_lines_have_empty_fields(spark):
    layout = [("a", 0, 3, "int"), ("b", 3, 6, "string"), ("c", 8, 12, "double")]
    lines = spark.createDataFrame([(1, " 12xyz   1.5"), (2, "  7xy"), (3, "bad")], "n int, line string")
    assert [tuple(r) for r in read_records(lines, layout).orderBy("n").collect()] == [(1, 12, "xyz", 1.5), (2, 7, "", None), (3, None, "", None)]
    back = write_records(read_records(lines.where("n = 1"), layout), layout, "line", 1).first().line
    assert back == " 12xyz   1.5"


def test_pair_list(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "id int, x double, y double, z double")
    v = radius.PairList(p, 1.0, 0.5, "id")
    assert v.pairs.count() == 4 and not v.needs_rebuild(p.withColumn("x", F.col("x") + 0.2))
    assert v.needs_rebuild(p.withColumn("x", F.col("x") + 0.3)) and v.needs_rebuild(p.where("id > 0"))
    with pytest.raises(ValueError):
        radius.PairList(p, 0.0, 0.5, "id")
