"""Registered queries: each applies one operator shape to the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe import system_queries
from molframe.functions import geometry as geo
from molframe.functions.mixing import splitmix64, unsigned_order
from molframe.functions.order import total_order
from molframe.functions.text import read_records, write_records
from molframe.operators import graph, lookup, radius, relational
from molframe.plans import optimize
from molframe.plans.solvate import PER_NM3, choose_spaced
from molframe.sinks import render

QUERIES: dict = dict(system_queries.QUERIES)
SQL: dict[str, str] = dict(system_queries.SQL)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _points(spark: SparkSession, d: str) -> DataFrame:
    """The first three dimensions of the embeddings as points, with a charge and a size made of the label and the id."""
    e = _t(spark, d, "embeddings")
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("id"), *xyz, F.col("label"), ((F.col("vec_id") % 5) - 2).cast("double").alias("q"))


P = "SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label, ((vec_id % 5) - 2)::DOUBLE AS q FROM embeddings"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
EDGES = f"SELECT a.id AS i, b.id AS j, {D2} AS d2 FROM p a JOIN p b ON a.id < b.id AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE"
ADJ = "SELECT i AS c, j AS n FROM e UNION ALL SELECT j, i FROM e"


def _edges(spark: SparkSession, d: str, r: float = 0.03) -> DataFrame:
    return radius.radius_pairs(_points(spark, d), r, "id").select("i", "j")


# -- scans, ordered and ranked operators --------------------------------------------------------


LAYOUT = [("orderkey", 6, 18, "long"), ("line", 18, 22, "int"), ("flag", 23, 25, "string"), ("quantity", 25, 37, "double"), ("tax", 37, 45, "double")]


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, l_returnflag AS flag, round(l_quantity, 2) AS quantity, round(l_tax, 2) AS tax FROM lineitem")
def fixed_width_roundtrip(spark, d):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    return read_records(write_records(li, LAYOUT, "record", 2), LAYOUT, "record")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS section,
    (sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER w)::BIGINT AS block
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def running_section_id(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    e = relational.running_state(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "section")
    return relational.block_ids(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "block").select("event_id", "section", "block")


_RANK = "CASE l_returnflag WHEN 'N' THEN 3 WHEN 'R' THEN 2 ELSE 1 END DESC, l_quantity DESC, l_linenumber, l_partkey, l_suppkey"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity, n AS candidates FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RANK}) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn = 1""")
def ranked_dedup(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    rank = F.when(F.col("l_returnflag") == "N", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1)
    best = relational.best_row(li, ["l_orderkey"], [rank.desc(), F.col("l_quantity").desc(), "l_linenumber", "l_partkey", "l_suppkey"], "candidates")
    return best.drop("l_suppkey")


@query("""SELECT o_orderpriority, o_orderstatus, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY f) - 1)::INTEGER AS seen, first_customer FROM (
    SELECT o_orderpriority, o_orderstatus, min(o_orderkey) AS f, arg_min(o_custkey, o_orderkey) AS first_customer FROM orders GROUP BY ALL)""")
def first_seen_group(spark, d):
    o = _t(spark, d, "orders")
    return relational.first_seen(o, ["o_orderpriority"], ["o_orderstatus"], "o_orderkey", {"first_customer": F.col("o_custkey")}, "seen")


@query("""SELECT o_orderkey, row_number() OVER w = 1 AS is_first, row_number() OVER w = count(*) OVER (PARTITION BY o_custkey) AS is_last
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def terminal_flags(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return relational.end_flags(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "is_first", "is_last").select("o_orderkey", "is_first", "is_last")


@query("""SELECT o_orderkey, next_key FROM (SELECT o_orderkey, o_totalprice, lead(o_orderkey) OVER w AS next_key, lead(o_totalprice) OVER w AS next_price
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE abs(next_price - o_totalprice) <= 50000""")
def adjacent_pairs(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    n = relational.with_neighbour(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"o_orderkey": "next_key", "o_totalprice": "next_price"})
    return n.where(F.abs(F.col("next_price") - F.col("o_totalprice")) <= 50000).select("o_orderkey", "next_key")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_filter(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.missing_from(_t(spark, d, "customer").select("c_custkey", "c_name"), o, ["c_custkey"])


@query("""SELECT l_shipmode AS t, arg_max(l_orderkey, l_partkey) AS v FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_orderkey, l_orderkey * 100 + l_linenumber AS l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1) GROUP BY 1""")
def last_wins(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("t"))
    one = relational.best_row(li, ["l_orderkey", "l_linenumber"], ["l_partkey"])
    return relational.last_wins(one.select("t", F.col("l_orderkey").alias("v"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("load")), ["t"], "load")


# -- lookups ------------------------------------------------------------------------------------


@query("""WITH k AS (SELECT least(a.n_nationkey, b.n_nationkey) AS t1, greatest(a.n_nationkey, b.n_nationkey) AS t2 FROM nation a JOIN nation b ON (a.n_nationkey + b.n_nationkey) % 3 = 0 AND a.n_nationkey <= b.n_nationkey)
    SELECT o_orderkey, c_nationkey AS n1, o_orderkey % 25 AS n2, (t1 * 100 + t2)::BIGINT AS force FROM orders JOIN customer ON o_custkey = c_custkey
    LEFT JOIN k ON t1 = least(c_nationkey, o_orderkey % 25) AND t2 = greatest(c_nationkey, o_orderkey % 25)""")
def canonical_pair_lookup(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    params = n.select(F.col("k").alias("t1")).join(n.select(F.col("k").alias("t2")), (F.col("t1") + F.col("t2")) % 3 == 0).where("t1 <= t2").withColumn("force", F.col("t1") * 100 + F.col("t2"))
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("n1"), (F.col("o_orderkey") % 25).alias("n2"))
    return lookup.pair_lookup(o, "n1", "n2", params, ["force"])


@query("""WITH q AS (SELECT DISTINCT p_brand AS a, p_type AS b, (p_size % 4)::VARCHAR AS c FROM part),
    k AS (SELECT p_brand AS t1, p_type AS t2, (p_size % 4)::VARCHAR AS t3, min(p_partkey) AS v FROM part WHERE p_size > 25 GROUP BY ALL),
    r AS (SELECT (p_size % 4)::VARCHAR AS t1, p_type AS t2, p_brand AS t3, min(p_partkey) AS v FROM part GROUP BY ALL), u AS (SELECT * FROM k UNION ALL SELECT * FROM r)
    SELECT a, b, c, coalesce(f.v, g.v) AS v FROM q LEFT JOIN u f ON a = f.t1 AND b = f.t2 AND c = f.t3 LEFT JOIN u g ON c = g.t1 AND b = g.t2 AND a = g.t3""")
def either_direction_lookup(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size", (F.col("p_size") % 4).cast("string").alias("s"))
    q = p.select(F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.col("s").alias("c")).distinct()
    k = p.where("p_size > 25").groupBy(F.col("p_brand").alias("t1"), F.col("p_type").alias("t2"), F.col("s").alias("t3")).agg(F.min("p_partkey").alias("v"))
    r = p.groupBy(F.col("s").alias("t1"), F.col("p_type").alias("t2"), F.col("p_brand").alias("t3")).agg(F.min("p_partkey").alias("v"))
    return lookup.either_direction(q, ["a", "b", "c"], k.unionByName(r), ["t1", "t2", "t3"], ["v"])


PATTERNS = [("X", "ECONOMY", "X", "X"), ("Brand#2", "X", "1", "X"), ("Brand#2", "ECONOMY", "1", "X"), ("X", "SMALL", "2", "X"), ("X", "PROMO", "X", "b"), ("a", "X", "X", "Brand#4"), ("X", "X", "X", "X"), ("Brand#2", "ECONOMY", "X", "a"), ("X", "SMALL", "X", "a")]
_VALUES = ", ".join(f"({i}, {', '.join(repr(x) for x in p)})" for i, p in enumerate(PATTERNS))
_QUADS = "SELECT DISTINCT p_brand AS t1, p_type AS t2, (p_size % 4)::VARCHAR AS t3, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS t4 FROM part"


def _fit(perm: str) -> str:
    return " AND ".join(f"(k{i} = 'X' OR k{i} = t{p})" for i, p in enumerate(perm, 1))


def _wildcard(perms: list[str]) -> str:
    fits = " OR ".join(f"({_fit(p)})" for p in perms)
    score = " + ".join(f"(k{i} <> 'X')::INT" for i in range(1, 5))
    return f"""WITH q AS ({_QUADS}), k(load_order, k1, k2, k3, k4) AS (VALUES {_VALUES}), m AS (SELECT q.*, load_order, {score} AS s FROM q JOIN k ON {fits})
    SELECT t1, t2, t3, t4, load_order, load_order * 10 AS v FROM (SELECT *, rank() OVER (PARTITION BY t1, t2, t3, t4 ORDER BY s DESC) AS r FROM m) WHERE r = 1"""


def _wild(spark, d, permutations) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_brand").alias("t1"), F.col("p_type").alias("t2"), (F.col("p_size") % 4).cast("string").alias("t3"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("t4"))
    k = spark.createDataFrame([(i, *x, i * 10) for i, x in enumerate(PATTERNS)], "load_order int, k1 string, k2 string, k3 string, k4 string, v int")
    return lookup.wildcard_lookup(p, ["t1", "t2", "t3", "t4"], k, ["k1", "k2", "k3", "k4"], "load_order", ["v"], permutations)


@query(_wildcard(["1234", "4321"]))
def wildcard_best_rank(spark, d):
    return _wild(spark, d, lookup.PROPER)


@query(_wildcard(["".join(str(i + 1) for i in p) for p in lookup.IMPROPER]))
def wildcard_improper(spark, d):
    return _wild(spark, d, lookup.IMPROPER)


@query("""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(p_type))) AS members FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    s AS (SELECT p_brand AS name, list_distinct(list(p_type)) AS sets, count(*) AS n FROM part GROUP BY 1)
    SELECT l_orderkey, arg_min(name, (n::BIGINT * 1000 + substr(name, 7)::BIGINT)) AS name, min(n)::BIGINT AS cost FROM o JOIN s ON list_has_all(sets, members) GROUP BY 1""")
def set_containment_best(spark, d):
    part = _t(spark, d, "part")
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = li.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey").groupBy("l_orderkey").agg(F.collect_set("p_type").alias("members"))
    s = part.groupBy(F.col("p_brand").alias("brand")).agg(F.collect_set("p_type").alias("sets"), F.count("*").alias("n")).withColumn("name", F.substring("brand", 7, 9).cast("long"))
    best = lookup.containing_set(o, ["l_orderkey"], "members", s.select("name", "sets", "n"), "name", "sets", F.col("n"))
    return best.select("l_orderkey", F.concat(F.lit("Brand#"), F.col("name").cast("string")).alias("name"), "cost")


@query("""WITH RECURSIVE a AS (SELECT p_partkey::VARCHAR AS alias, (p_partkey - 1)::VARCHAR AS source FROM part WHERE p_partkey % 5 <> 0),
    v AS (SELECT p_partkey::VARCHAR AS k, p_retailprice AS value, 0 AS depth FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT alias, value, depth + 1 FROM v JOIN a ON source = k WHERE depth < 4)
    SELECT k, value FROM v""")
def alias_closure(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_partkey", F.col("p_retailprice").alias("value"))
    a = p.where("p_partkey % 5 <> 0").select(F.col("k").alias("alias"), (F.col("p_partkey") - 1).cast("string").alias("source"))
    return lookup.with_aliases(p.where("p_partkey % 5 = 0").select("k", "value"), a, "k")


# -- space --------------------------------------------------------------------------------------


@query(f"WITH p AS ({P}) SELECT a.id AS i, b.id AS j, round({D2}, 12) AS d2 FROM p a JOIN p b ON a.id < b.id AND {D2} <= 0.05::DOUBLE * 0.05::DOUBLE")
def radius_self_join(spark, d):
    return radius.radius_pairs(_points(spark, d), 0.05, "id").withColumn("d2", F.round("d2", 12))


@query(f"""WITH p AS ({P}) SELECT a.id AS id, count(*) AS pairs, round(sum(a.q * b.q / sqrt({D2})), 6) AS energy
    FROM p a JOIN p b ON a.label % 2 = 0 AND b.label % 2 = 1 AND {D2} <= 0.08::DOUBLE * 0.08::DOUBLE GROUP BY 1""")
def radius_bipartite(spark, d):
    p = _points(spark, d)
    j = radius.radius_join(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.08)
    return j.groupBy(F.col("l_id").alias("id")).agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("l_q") * F.col("r_q") / F.sqrt("d2")), 6).alias("energy"))


@query(f"WITH p AS ({P}) SELECT a.id, a.label FROM p a WHERE a.label % 2 = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label % 2 = 1 AND {D2} < 0.06::DOUBLE * 0.06::DOUBLE)")
def radius_anti(spark, d):
    p = _points(spark, d)
    return radius.without_near(p.where("label % 2 = 0"), p.where("label % 2 = 1"), 0.06, "id").select("id", "label")


@query(f"""WITH p AS ({P}) SELECT least(a.id, b.id) AS i, greatest(a.id, b.id) AS j, round(min({D2}), 12) AS d2 FROM p a JOIN p b ON a.label = 0 AND a.id <> b.id AND {D2} <= 0.06::DOUBLE * 0.06::DOUBLE GROUP BY 1, 2""")
def radius_selected(spark, d):
    return radius.selected_pairs(_points(spark, d), F.col("label") == 0, 0.06, "id").withColumn("d2", F.round("d2", 12))


@query(f"WITH p AS ({P}) SELECT a.id, arg_min(b.id, {D2}) AS other, round(min({D2}), 12) AS d2 FROM p a JOIN p b ON a.id <> b.id AND {D2} <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY 1")
def nearest_argmin(spark, d):
    p = _points(spark, d)
    return radius.nearest(p, p.withColumnRenamed("id", "other"), "id", "other", 0.1).withColumn("d2", F.round("d2", 12))


@query(f"""WITH p AS ({P}), m AS (SELECT id, x + CASE WHEN id % 40 = 0 THEN 0.02::DOUBLE ELSE 0.001::DOUBLE END AS nx, x FROM p)
    SELECT max(CASE WHEN (nx - x) * (nx - x) > 0.005::DOUBLE * 0.005::DOUBLE THEN 1 ELSE 0 END) = 1 AS rebuild, (SELECT count(*) FROM p a JOIN p b ON a.id < b.id AND {D2} <= 0.06::DOUBLE * 0.06::DOUBLE) AS pairs FROM m""")
def verlet_list(spark, d):
    p = _points(spark, d)
    v = radius.PairList(p, 0.05, 0.01, "id")
    moved = p.withColumn("x", F.col("x") + F.when(F.col("id") % 40 == 0, 0.02).otherwise(0.001))
    return v.pairs.agg(F.lit(v.needs_rebuild(moved)).alias("rebuild"), F.count("*").alias("pairs"))


@query(f"""WITH p AS ({P}), m AS (SELECT id, label, CASE WHEN label % 3 = 0 THEN x * 1.5 ELSE x + 0.001::DOUBLE END AS x, y, z FROM p),
    stale AS (SELECT p.label, max(CASE WHEN (m.x - p.x) * (m.x - p.x) > 0.005::DOUBLE * 0.005::DOUBLE THEN 1 ELSE 0 END) = 1 AS stale FROM p JOIN m USING (id) GROUP BY 1),
    q AS (SELECT p.id, p.label, CASE WHEN stale THEN m.x ELSE p.x END AS x, p.y, p.z FROM p JOIN m USING (id) JOIN stale ON stale.label = p.label)
    SELECT stale.label, stale, count(a.id) AS pairs, round(coalesce(sum({D2}), 0), 6) AS total FROM stale LEFT JOIN (q a JOIN q b ON a.label = b.label AND a.id < b.id AND {D2} <= 0.1::DOUBLE * 0.1::DOUBLE) ON a.label = stale.label GROUP BY 1, 2""")
def verlet_by_part(spark, d):
    """A third of the structures moves: their pairs are made anew, those of the others are kept as they were."""
    p = _points(spark, d)
    v = radius.PairList(p, 0.09, 0.01, "id", ["label"])
    moved = p.withColumn("x", F.when(F.col("label") % 3 == 0, F.col("x") * 1.5).otherwise(F.col("x") + 0.001))
    stale = v.stale(moved).select("label", F.lit(True).alias("stale"))
    n = v.updated(moved).pairs.groupBy("label").agg(F.count("*").alias("pairs"), F.sum("d2").alias("total"))
    every = p.select("label").distinct().join(stale, "label", "left").join(n, "label", "left")
    return every.select("label", F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("pairs", F.lit(0)).alias("pairs"), F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


_CROWD = "CASE WHEN c_custkey % 2 = 0 THEN 50.0 ELSE 1.0 END"


@query(f"""WITH p AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal / 1000 / {_CROWD} AS x, (c_custkey * 37 % 1000) / 100.0::DOUBLE / {_CROWD} AS y, (c_custkey * 91 % 1000) / 100.0::DOUBLE / {_CROWD} AS z FROM customer)
    SELECT a.nation, count(*) AS pairs, round(sum({D2}), 3) AS total FROM p a JOIN p b ON a.id < b.id AND {D2} <= 0.3::DOUBLE * 0.3::DOUBLE GROUP BY 1""")
def radius_crowded(spark, d):
    """Half of the points in one cube: its pairs are dealt over as many keys as it takes."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.when(F.col("c_custkey") % 2 == 0, 50.0).otherwise(1.0)
    p = c.select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_acctbal") / 1000 / k).alias("x"), (F.col("c_custkey") * 37 % 1000 / 100.0 / k).alias("y"), (F.col("c_custkey") * 91 % 1000 / 100.0 / k).alias("z"))
    # the nation goes along with its point, so that pairs are summed where they are made
    near = radius.radius_join(p, p, 0.3, most=512).where("l_id < r_id")
    return near.groupBy(F.col("l_c_nationkey").alias("nation")).agg(F.count("*").alias("pairs"), F.round(F.sum("d2"), 3).alias("total"))


_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


@query(f"""SELECT l_linestatus, l_orderkey, l_linenumber, l_partkey, row_number() OVER w - 1 AS place, last_value(CASE WHEN l_quantity > 45 THEN l_partkey END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS state
    FROM lineitem WINDOW w AS (PARTITION BY l_linestatus ORDER BY {_LINES})""")
def ranks_and_state_of_large_parts(spark, d):
    """Places and the running state within two parts that hold the whole table, by ranges of a part."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linestatus", *_LINES.split(", "), "l_quantity")
    placed = relational.part_rank(li, ["l_linestatus"], _LINES.split(", "), "place")
    out = relational.part_state(placed, ["l_linestatus"], ["place"], F.when(F.col("l_quantity") > 45, F.col("l_partkey")), "state")
    return out.select("l_linestatus", "l_orderkey", "l_linenumber", "l_partkey", "place", "state")


@query(f"WITH p AS ({P}) SELECT label, count(*) AS pairs, round(sum({D2}), 6) AS total FROM (SELECT a.label, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS bby, a.z AS az, b.z AS bz FROM p a JOIN p b ON a.label = b.label AND a.id < b.id) GROUP BY 1".replace(D2, "(ax - bx) * (ax - bx) + (ay - bby) * (ay - bby) + (az - bz) * (az - bz)"))
def all_pairs_by_group(spark, d):
    return radius.all_pairs(_points(spark, d), "id", ["label"]).groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.sum("d2"), 6).alias("total"))


# -- graphs -------------------------------------------------------------------------------------


@query(f"""WITH p AS ({P}) SELECT a.id AS i, b.id AS j FROM p a JOIN p b ON a.id < b.id AND {D2} <= 0.03::DOUBLE * 0.03::DOUBLE
    UNION SELECT a.id, b.id FROM p a JOIN p b ON a.id < b.id AND a.label = b.label AND {D2} <= 0.05::DOUBLE * 0.05::DOUBLE""")
def edge_canonicalize(spark, d):
    p = _points(spark, d)
    same = radius.radius_join(p, p, 0.05).where("l_label = r_label").select(F.col("l_id").alias("i"), F.col("r_id").alias("j"))
    return graph.union_edges([_edges(spark, d), same])


@query(f"""WITH RECURSIVE p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}), r AS (SELECT id AS n, id AS m FROM p UNION SELECT adj.n, r.m FROM r JOIN adj ON adj.c = r.n),
    c AS (SELECT n AS id, min(m) AS root FROM r GROUP BY 1) SELECT id, root, (dense_rank() OVER (ORDER BY root) - 1)::INTEGER AS component FROM c""")
def components(spark, d):
    return graph.numbered_components(graph.components(_points(spark, d), _edges(spark, d, 0.05)))


@query(f"WITH p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}) SELECT a.n AS i, a.c, b.n AS k FROM adj a JOIN adj b ON a.c = b.c AND a.n < b.n")
def two_paths(spark, d):
    return graph.two_paths(_edges(spark, d, 0.05))


@query(f"""WITH p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}), w AS (SELECT h.n AS a, e.i AS b, e.j AS c, t.n AS d FROM e JOIN adj h ON h.c = e.i AND h.n <> e.j JOIN adj t ON t.c = e.j AND t.n <> e.i AND t.n <> h.n)
    SELECT DISTINCT CASE WHEN a < d THEN a ELSE d END AS a, CASE WHEN a < d THEN b ELSE c END AS b, CASE WHEN a < d THEN c ELSE b END AS c, CASE WHEN a < d THEN d ELSE a END AS d FROM w""")
def three_paths(spark, d):
    return graph.three_paths(_edges(spark, d, 0.05))


@query(f"WITH p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}) SELECT x.n AS a, y.n AS b, x.c, z.n AS d FROM adj x JOIN adj y ON x.c = y.c AND x.n < y.n JOIN adj z ON z.c = y.c AND y.n < z.n")
def star_triples(spark, d):
    return graph.star_triples(_edges(spark, d, 0.05))


@query(f"""WITH p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}), one AS (SELECT c AS i, n AS j FROM adj), two AS (SELECT i, n AS j FROM one JOIN adj ON adj.c = j WHERE i <> n),
    three AS (SELECT i, n AS j FROM two JOIN adj ON adj.c = j WHERE i <> n) SELECT * FROM one UNION SELECT * FROM two UNION SELECT * FROM three""")
def khop_exclusions(spark, d):
    """Pairs within three edges, by rows of bits: walks between them are many more."""
    return graph.within_three(_edges(spark, d, 0.05))


@query("""SELECT o_custkey, count(*) AS n, max(CASE WHEN k < b THEN 1 ELSE 0 END) AS interleaved FROM (
    SELECT o_custkey, o_orderkey % 7 AS k, lag(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) GROUP BY 1""")
def component_sizes(spark, d):
    """The topology writer's sizes of components; components that interleave are refused."""
    o = _t(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey", (F.col("o_orderkey") % 7).alias("k")).alias("o"))

    def sizes(batches):
        for pdf in batches:
            out = []
            for c, rows in zip(pdf["o_custkey"], pdf["rows"]):
                atoms = [{"residue": i} for i in range(len(rows))]
                try:
                    out.append((c, sum(render.component_sizes(atoms, [{"residue": i, "component": r["k"]} for i, r in enumerate(rows)])), 0))
                except ValueError:
                    out.append((c, len(rows), 1))
            yield pd.DataFrame(out, columns=["o_custkey", "n", "interleaved"])

    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("rows")).mapInPandas(sizes, "o_custkey long, n long, interleaved int")


# -- energies -----------------------------------------------------------------------------------


@query("SELECT label, round(min(embedding[1]::DOUBLE), 9) AS lo, round(max(embedding[1]::DOUBLE), 9) AS hi, round(max(embedding[1]::DOUBLE) - min(embedding[1]::DOUBLE) + 24, 9) AS box, round((max(embedding[1]::DOUBLE) - min(embedding[1]::DOUBLE) + 24) * 0.5 - (min(embedding[1]::DOUBLE) + max(embedding[1]::DOUBLE)) * 0.5, 9) AS shift FROM embeddings GROUP BY 1")
def bounding_box(spark, d):
    from molframe.plans.solvate import box

    p = _points(spark, d).withColumn("sid", F.col("label"))
    ends = p.groupBy("sid").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = box(p, 12.0).join(ends, "sid")
    return b.select(F.col("sid").alias("label"), *[F.round(c, 9).alias(n) for c, n in (("lo", "lo"), ("hi", "hi"), ("box_x", "box"), ("shift_x", "shift"))])


@query("""WITH b AS (SELECT r_regionkey AS sid, 20.0 + 9 * r_regionkey AS bx, 30.0::DOUBLE AS byy, 10.0 + 11 * r_regionkey AS bz FROM region)
    SELECT sid, ix, iy, iz FROM b, range(0, 8) a(ix), range(0, 8) c(iy), range(0, 8) e(iz) WHERE ix < ceil(bx / 18.774349) AND iy < ceil(byy / 18.774349) AND iz < ceil(bz / 18.774349)""")
def lattice_tiles(spark, d):
    from molframe.plans.solvate import tiles

    b = _t(spark, d, "region").select(F.col("r_regionkey").alias("sid"), (20.0 + 9 * F.col("r_regionkey")).alias("box_x"), F.lit(30.0).alias("box_y"), (10.0 + 11 * F.col("r_regionkey")).alias("box_z"))
    return tiles(b).select("sid", *[F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"])


@query(f"""WITH c AS (SELECT c_nationkey AS sid, sum(c_acctbal) AS v, (count(*) % 9 - 4)::BIGINT AS net FROM customer GROUP BY 1), k AS (SELECT *, round(0.15 * {PER_NM3} * (abs(v) / 1000.0))::BIGINT AS pairs FROM c)
    SELECT sid, net, pairs + greatest(-net, 0) AS sodium, pairs + greatest(net, 0) AS chloride FROM k""")
def ion_counts(spark, d):
    from molframe.plans.solvate import ion_counts as counted

    c = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("sid")).agg(F.sum("c_acctbal").alias("v"), (F.count("*") % 9 - 4).cast("double").alias("solute_charge"))
    return counted(c.select("sid", F.abs("v").alias("box_x"), F.lit(1.0).alias("box_y"), F.lit(1.0).alias("box_z")), c.select("sid", "solute_charge"), 0.15)


@query("""SELECT p_type, p_brand, (row_number() OVER (PARTITION BY p_type ORDER BY f))::INTEGER AS idx FROM (SELECT p_type, p_brand, min(p_partkey) AS f FROM part GROUP BY ALL)""")
def type_dictionary(spark, d):
    """The topology writer's numbers of values by first appearance."""

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p_partkey")
        got = render.first_appearance(pdf.to_dict("records"), "p_brand")
        return pd.DataFrame({"p_type": pdf["p_type"].iloc[0], "p_brand": [k for k, in got], "idx": list(got.values())})

    return _t(spark, d, "part").select("p_partkey", "p_type", "p_brand").groupBy("p_type").applyInPandas(number, "p_type string, p_brand string, idx int")


@query("""WITH t AS (SELECT p_brand AS t, arg_min(p_retailprice, p_partkey) / 1000 AS radius, arg_min(p_size, p_partkey)::DOUBLE AS epsilon FROM part GROUP BY 1)
    SELECT a.t AS first, b.t AS second, round(sqrt(a.epsilon * b.epsilon) * pow(a.radius + b.radius, 12), 2) AS acoef, round(2 * sqrt(a.epsilon * b.epsilon) * pow(a.radius + b.radius, 6), 4) AS bcoef FROM t a JOIN t b ON a.t >= b.t""")
def pair_table(spark, d):
    """The topology writer's tables of pairs of types."""
    t = _t(spark, d, "part").groupBy(F.col("p_brand").alias("atom_type")).agg((F.min_by("p_retailprice", "p_partkey") / 1000).alias("radius"), F.min_by("p_size", "p_partkey").cast("double").alias("epsilon"))

    def tables(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["atom_type"])
        index, a, b = render.pair_tables(pdf.to_dict("records"), names)
        n = len(names)
        return pd.DataFrame([(names[i], names[j], round(a[index[i * n + j] - 1], 2), round(b[index[j * n + i] - 1], 4)) for i in range(n) for j in range(i + 1)], columns=["first", "second", "acoef", "bcoef"])

    return t.withColumn("sid", F.lit("all")).groupBy("sid").applyInPandas(tables, "first string, second string, acoef double, bcoef double")  # one row a type


@query(f"""WITH p AS ({P}), e AS ({EDGES.replace('0.03', '0.05')}), adj AS ({ADJ}), t AS (SELECT a.n AS i, a.c, b.n AS k FROM adj a JOIN adj b ON a.c = b.c AND a.n < b.n),
    v AS (SELECT t.*, a.x - b.x AS ux, a.y - b.y AS uy, a.z - b.z AS uz, d.x - b.x AS vx, d.y - b.y AS vy, d.z - b.z AS vz FROM t JOIN p a ON a.id = i JOIN p b ON b.id = c JOIN p d ON d.id = k)
    SELECT c, count(*) AS n, round(sum(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy + uz * vz) / (sqrt(ux * ux + uy * uy + uz * uz) * sqrt(vx * vx + vy * vy + vz * vz))))))), 5) AS degrees FROM v GROUP BY 1""")
def angle_sum(spark, d):
    """Pairs of a centre's neighbours are summed where they are made."""
    return graph.centre_angles(_points(spark, d), _edges(spark, d, 0.05)).withColumn("degrees", F.round("degrees", 5))


# -- configuration, reports, hashes -----------------------------------------------------------------


_ROUND = "(xor({z}, {z} // {shift}::UHUGEINT) * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT"


@query(f"""WITH a AS (SELECT o_orderkey, (o_orderkey::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS z FROM orders),
    b AS (SELECT o_orderkey, {_ROUND.format(z='z', shift=1 << 30, k=0xBF58476D1CE4E5B9)} AS z FROM a), c AS (SELECT o_orderkey, {_ROUND.format(z='z', shift=1 << 27, k=0x94D049BB133111EB)} AS z FROM b),
    e AS (SELECT o_orderkey, xor(z, z // {1 << 31}::UHUGEINT)::HUGEINT AS z FROM c)
    SELECT o_orderkey, (CASE WHEN z >= 9223372036854775808::HUGEINT THEN z - 18446744073709551616::HUGEINT ELSE z END)::BIGINT AS mixed, (z - 9223372036854775808::HUGEINT)::BIGINT AS rank_key FROM e""")
def tie_hash(spark, d):
    """Splitmix of each order key, and the number that sorts as the unsigned one."""
    o = _t(spark, d, "orders").select("o_orderkey")
    return o.select("o_orderkey", splitmix64(F.col("o_orderkey")).alias("mixed"), unsigned_order(splitmix64(F.col("o_orderkey"))).alias("rank_key"))


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CASE (o_orderkey // 4) % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'infinity'::DOUBLE WHEN 2 THEN '-infinity'::DOUBLE WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 ELSE o_totalprice::DOUBLE - 150000 END AS v, CASE WHEN (o_orderkey // 4) % 7 = 3 THEN 0 ELSE 1 END AS sign FROM orders)
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY v, sign, o_orderkey) AS rising, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY v DESC, sign DESC, o_orderkey) AS falling FROM x""")
def float_total_order(spark, d):
    """Places by the total order of numbers among which are NaN, both infinities and both zeros."""
    k = F.floor(F.col("o_orderkey") / 4) % 7
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, -0.0).when(k == 4, 0.0).otherwise(F.col("o_totalprice").cast("double") - 150000)
    rows = _t(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("part"), total_order(v).alias("key"))
    w = W.partitionBy("part")
    return rows.select("o_orderkey", F.row_number().over(w.orderBy("key", "o_orderkey")).alias("rising"), F.row_number().over(w.orderBy(F.col("key").desc(), "o_orderkey")).alias("falling"))


@query("SELECT count(*) AS n, sum(CASE WHEN isnan(x) OR isinf(x) OR x IS NULL THEN 1 ELSE 0 END)::BIGINT AS bad FROM (SELECT CASE WHEN l_linenumber = 3 THEN 'nan'::DOUBLE WHEN l_linenumber = 5 THEN 'infinity'::DOUBLE ELSE l_tax END AS x FROM lineitem)")
def coordinate_validation(spark, d):
    li = _t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 5, F.lit(float("inf"))).otherwise(F.col("l_tax")).alias("x"))
    return li.agg(F.count("*").alias("n"), F.count_if(~geo.finite((F.col("x"),) * 3)).alias("bad"))


# -- sequential and iterative operators; the tests hold them against plain loops --------------------------


def _turns(n: int) -> str:
    """CTEs of n turns: each takes, of the sites not taken, the best that is 0.3 or more from all taken, or else the best; then the least hash."""
    out = []
    for t in range(n):
        taken = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(t)) or "SELECT * FROM h WHERE false"
        near = f"EXISTS (SELECT 1 FROM ({taken}) c WHERE c.label = h.label AND (c.x - h.x) * (c.x - h.x) + (c.y - h.y) * (c.y - h.y) + (c.z - h.z) * (c.z - h.z) < 0.3::DOUBLE * 0.3::DOUBLE)"
        free = f"NOT EXISTS (SELECT 1 FROM ({taken}) c WHERE c.label = h.label AND c.id = h.id)"
        out.append(f"t{t} AS MATERIALIZED (SELECT * FROM h WHERE {free} QUALIFY row_number() OVER (PARTITION BY label ORDER BY {near}, {'q' if t % 2 == 0 else '-q'}, tie) = 1)")
    return ", ".join(out)


@query(f"""WITH p AS ({P}), a AS (SELECT *, (id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS m FROM p),
    b AS (SELECT * REPLACE ({_ROUND.format(z='m', shift=1 << 30, k=0xBF58476D1CE4E5B9)} AS m) FROM a), c AS (SELECT * REPLACE ({_ROUND.format(z='m', shift=1 << 27, k=0x94D049BB133111EB)} AS m) FROM b),
    h AS MATERIALIZED (SELECT label, id, x, y, z, q, xor(m, m // {1 << 31}::UHUGEINT) AS tie FROM c), {_turns(4)}
    SELECT label, turn::BIGINT AS turn, id FROM (SELECT label, 0 AS turn, id FROM t0 UNION ALL SELECT label, 1, id FROM t1 UNION ALL SELECT label, 2, id FROM t2 UNION ALL SELECT label, 3, id FROM t3)""")
def greedy_spaced_selection(spark, d):
    """Four spaced sites a label, rising and falling potential in turn (the engine's own choice, one group a label)."""
    p = _points(spark, d).select("label", "id", "x", "y", "z", "q", unsigned_order(splitmix64(F.col("id"))).alias("tie"))

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        plan = [True, False, True, False][: len(pdf)]
        got = choose_spaced(pdf[["x", "y", "z"]].to_numpy(), pdf["q"].to_numpy(), pdf["tie"].to_numpy(), plan, 0.3)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "turn": np.arange(len(got)), "id": pdf["id"].to_numpy()[got]})

    return p.groupBy("label").applyInPandas(pick, "label int, turn long, id long")


class Well(optimize.Objective):
    """Sum of k (x - c)**2 with k = 1, 2."""

    dimension = 2

    def __init__(self, c):
        self.c, self.k = np.asarray(c, float), np.array([1.0, 2.0])

    def value_gradient(self, point):
        d = point - self.c
        return float((self.k * d * d).sum()), 2 * self.k * d


@query("SELECT n_nationkey AS sid, n_nationkey::DOUBLE AS x, 0.0::DOUBLE - n_nationkey::DOUBLE AS y, true AS converged FROM nation")
def lbfgs_quadratic(spark, d):
    starts = _t(spark, d, "nation").select(F.col("n_nationkey").alias("sid"), F.array(F.lit(0.0), F.lit(0.0)).alias("point"))
    out = optimize.minimize_groups(starts, lambda pdf: Well([pdf["sid"].iloc[0], -pdf["sid"].iloc[0]]))
    return out.select("sid", F.round(F.col("point")[0], 2).alias("x"), (F.round(F.col("point")[1], 2) + 0.0).alias("y"), "converged")


class Target(optimize.GeneticProblem):
    """Find an integer."""

    def __init__(self, goal: int):
        self.goal = goal

    def generate(self, rng):
        return int(rng.integers(0, 1000))

    def crossover(self, first, second, rng):
        return (first + second) // 2

    def mutate(self, state, rng, rate):
        return state + int(rng.integers(-20, 21)) if rng.random() < rate else state

    def evaluate(self, state):
        return float(abs(state - self.goal))

    def is_solution(self, state, score):
        return score == 0


@query("SELECT r_regionkey AS sid, 100 + 37 * r_regionkey AS found FROM region")
def ga_integer_target(spark, d):
    goals = _t(spark, d, "region").select(F.col("r_regionkey").alias("sid"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["sid"].iloc[0])
        out = optimize.genetic_optimize(Target(100 + 37 * k), optimize.GeneticConfig(population_size=64, generations=200, mutation_rate=0.5, seed=k))
        return pd.DataFrame({"sid": [k], "found": [out.best_state]})

    return goals.groupBy("sid").applyInPandas(solve, "sid int, found int")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """All energy terms of systems made from the vectors."""
    return system_queries.energy_components(spark, d)
