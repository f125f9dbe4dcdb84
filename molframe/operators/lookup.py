"""Parameter lookups: unordered pairs, either direction, wildcards with the best rank, set containment, aliases.

Lookups run on distinct keys against dimensions, so their cost does not grow with the number of atoms.
Wildcards are equi-joins: a query is expanded into its masked forms (each subset of places replaced by X)
in every allowed permutation, which a pattern equals in at most one mask.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.operators.relational import best_with_ties

#: Places that a torsion and an improper may be read in (the third place of an improper is its centre).
PROPER = [(0, 1, 2, 3), (3, 2, 1, 0)]
IMPROPER = [(0, 1, 2, 3), (1, 0, 2, 3), (0, 3, 2, 1), (3, 1, 2, 0), (1, 3, 2, 0), (3, 0, 2, 1)]
WILDCARD = "X"
SEP = "\u0001"


def pair_lookup(df: DataFrame, a: str, b: str, params: DataFrame, values: Sequence[str], pa: str = "t1", pb: str = "t2") -> DataFrame:
    """Left join on the unordered pair; values are null where there is none."""
    p = params.select(F.least(pa, pb).alias("__a"), F.greatest(pa, pb).alias("__b"), *values)
    return df.join(p, (F.least(a, b) == F.col("__a")) & (F.greatest(a, b) == F.col("__b")), "left").drop("__a", "__b")


def either_direction(df: DataFrame, key: Sequence[str], params: DataFrame, pkey: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join on the key as it stands, else reversed; the forward form is preferred."""
    out = df
    for tag, columns in (("f", key), ("r", list(reversed(key)))):
        p = params.select(*[F.col(k).alias(f"__{tag}{i}") for i, k in enumerate(pkey)], F.struct(*values).alias(f"__{tag}"))
        on = None
        for i, k in enumerate(columns):
            e = F.col(k) == F.col(f"__{tag}{i}")
            on = e if on is None else on & e
        out = out.join(p, on, "left").drop(*[f"__{tag}{i}" for i in range(len(key))])
    best = F.coalesce("__f", "__r")
    return out.select(*df.columns, *[best[v].alias(v) for v in values])


def wildcard_lookup(queries: DataFrame, key: Sequence[str], patterns: DataFrame, pkey: Sequence[str], order: str, values: Sequence[str], permutations=PROPER) -> DataFrame:
    """(key, order, values) for every pattern that fits a query with the most places other than X, ties included.

    A pattern counts once however many permutations fit. Queries without a fit give no row."""
    asked = queries.select(*key).distinct()
    n = len(key)
    forms = [F.concat_ws(SEP, *[F.lit(WILDCARD) if mask >> i & 1 else F.col(key[p]) for i, p in enumerate(perm)]) for perm in permutations for mask in range(1 << n)]
    spread = asked.select(*key, F.explode(F.array_distinct(F.array(*forms))).alias("__form"))
    fixed = sum(((F.col(k) != WILDCARD).cast("int") for k in pkey[1:]), (F.col(pkey[0]) != WILDCARD).cast("int"))
    p = patterns.select(F.concat_ws(SEP, *pkey).alias("__form"), F.col(order).alias("__order"), fixed.alias("__fixed"), *[F.col(v).alias(f"__v_{v}") for v in values])
    hits = spread.join(p, "__form").drop("__form").dropDuplicates([*key, "__order"])
    best = best_with_ties(hits, key, F.col("__fixed"))
    return best.select(*key, F.col("__order").alias(order), *[F.col(f"__v_{v}").alias(v) for v in values])


def containing_set(items: DataFrame, sid: Sequence[str], members: str, sets: DataFrame, name: str, set_members: str, cost, extra: Sequence[str] = ()) -> DataFrame:
    """(sid, name): the set that holds all members, of least (cost, name). `sets` is a small dimension.

    `cost` is a column over both sides. Sets are found by an equi-join on one member (a set that holds all
    of them holds the least one), so no pair of an item and a set is made that shares nothing. Distinct members with their
    `extra` columns are looked up once, however many items have them."""
    own = items.select(*sid, F.array_sort(F.array_distinct(members)).alias(members), *extra)
    key = [F.hash(members, *extra).alias("__h"), members, *extra]
    asked = own.select(*key).distinct()
    s = sets.select(name, set_members, *[c for c in sets.columns if c not in {name, set_members}], F.explode(set_members).alias("__m"))
    fit = asked.withColumn("__m", F.array_min(members)).join(s, "__m").where(F.size(F.array_except(members, set_members)) == 0)
    best = fit.groupBy("__h", members, *extra).agg(F.min(F.struct(cost.alias("cost"), F.col(name).alias("name"))).alias("b"))
    found = best.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(["__h", members, *extra])], "b")
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(["__h", members, *extra])]
    return own.select(*sid, *key).join(found, on).select(*sid, F.col("b.name").alias(name), F.col("b.cost").alias("cost"))


def with_aliases(values: DataFrame, aliases: DataFrame, key: str, rounds: int = 4) -> DataFrame:
    """Values of aliases copied from their sources, `rounds` deep; an existing value is never replaced."""
    out = values
    for _ in range(rounds):
        got = aliases.join(out.withColumnRenamed(key, "source"), "source").select(F.col("alias").alias(key), *[c for c in values.columns if c != key])
        out = out.unionByName(got.join(out.select(key), key, "left_anti").dropDuplicates([key]))
    return out
