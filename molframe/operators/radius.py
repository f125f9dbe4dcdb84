"""Radius joins by cells: space is cut into cubes of the radius' side, one side visits the 27 cubes around
its own, and an equi-join on the cube leaves only near pairs for the distance test.

A crowded cube would be a hot key, so cubes are counted first. One that holds over `most` points of a side has that side dealt over as many
salts as it takes and the other side repeated for each, so a key never has more than `most` points of either side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.geometry import distance2, vec
from molframe.runtime import cut

#: Points of one side that a key may hold.
MOST = 4096
AXES = ("x", "y", "z")


def _cells(df: DataFrame, side: float, offsets: bool) -> DataFrame:
    k = [F.floor(F.col(a) / side).cast("long").alias(f"__k{a}") for a in AXES]
    df = df.select("*", *k)
    if not offsets:
        return df
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for a in AXES:
        df = df.withColumn("__d", F.explode(steps)).withColumn(f"__k{a}", F.col(f"__k{a}") + F.col("__d")).drop("__d")
    return df


def _salted(a: DataFrame, b: DataFrame, on: list[str], most: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the salts of crowded keys, and the columns to join on. Counts are sums by key, so a crowded one is added up within tasks first."""
    n = a.groupBy(*on).agg(F.count("*").alias("__n"), F.lit(0).cast("long").alias("__m")).unionByName(b.groupBy(*on).agg(F.lit(0).cast("long").alias("__n"), F.count("*").alias("__m")))
    n = n.groupBy(*on).agg(F.sum("__n").alias("__n"), F.sum("__m").alias("__m")).where(f"__n > {most} OR __m > {most}")
    # a crowd that visits a cube without a partner is dealt out too, or its key would be one task's
    hot = cut(n.select(*on, *[F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int").alias(t) for c, t in (("__n", "__s"), ("__m", "__t"))]))
    if hot.isEmpty():
        return a, b, on

    def dealt(df: DataFrame, own: str, other: str, salt: str, copy: str, ident: list[str]) -> DataFrame:
        df = df.join(hot, on, "left").withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*ident), F.col(own)), F.lit(0)).cast("int"))
        return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))).drop("__s", "__t")

    left, right = ([c for c in df.columns if c not in on] for df in (a, b))
    return dealt(a, "__s", "__t", "__u", "__v", left), dealt(b, "__t", "__s", "__v", "__u", right), [*on, "__u", "__v"]


#: Tiles that rows are dealt over before these grow.
TILES = 8


def tiles(rows: Column, tile: int, most: int) -> Column:
    """How many tiles `rows` rows are dealt over: of about `tile` rows, but of an eighth of the rows where that is more, up to `most`.

    Rows travel once for each tile, so with tiles of a fixed few rows what travels would grow with the square of the rows."""
    return F.ceil(rows / F.greatest(F.lit(float(tile)), F.least(F.lit(float(most)), rows / TILES))).cast("int")


def radius_join(left: DataFrame, right: DataFrame, radius: float, part: Sequence[str] = (), strict: bool = False, most: int = MOST) -> DataFrame:
    """Pairs within `radius` (below it if `strict`) in the same `part`. Columns: part, l_*, r_*, d2."""
    keep_l, keep_r = [c for c in left.columns if c not in part], [c for c in right.columns if c not in part]
    a = _cells(left, radius, False).select(*part, *[F.col(c).alias(f"l_{c}") for c in keep_l], *[f"__k{x}" for x in AXES])
    b = _cells(right, radius, True).select(*part, *[F.col(c).alias(f"r_{c}") for c in keep_r], *[f"__k{x}" for x in AXES])
    a, b, on = _salted(a, b, [*part, *[f"__k{x}" for x in AXES]], most)
    d2 = distance2(vec("l_"), vec("r_"))
    limit = float(radius) * float(radius)
    hits = a.join(b, on).withColumn("d2", d2).where(F.col("d2") < limit if strict else F.col("d2") <= limit)
    return hits.drop(*[f"__k{x}" for x in AXES], "__u", "__v")


def radius_pairs(points: DataFrame, radius: float, ident: str, part: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Each unordered pair within `radius` once: (part, i, j, d2) with i < j; `ident` is unique in its part."""
    p = points.select(*part, F.col(ident).alias("id"), *AXES)
    return radius_join(p, p, radius, part, most=most).where("l_id < r_id").select(*part, F.col("l_id").alias("i"), F.col("r_id").alias("j"), "d2")


def all_pairs(points: DataFrame, ident: str, part: Sequence[str], tiles: int = 1) -> DataFrame:
    """The whole upper triangle within each part, for energies without a cutoff; quadratic by definition. With `tiles` the pairs of a part are dealt over tiles ** 2 keys."""
    p = points.select(*part, F.col(ident).alias("i"), *[F.col(a).alias(f"l_{a}") for a in AXES])
    q = points.select(*part, F.col(ident).alias("j"), *[F.col(a).alias(f"r_{a}") for a in AXES])
    on = list(part)
    if tiles > 1:
        every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
        p = p.withColumn("__a", F.pmod(F.xxhash64("i"), F.lit(tiles)).cast("int")).withColumn("__b", every)
        q = q.withColumn("__b", F.pmod(F.xxhash64("j"), F.lit(tiles)).cast("int")).withColumn("__a", every)
        on += ["__a", "__b"]
    return p.join(q, on).where("i < j").select(*part, "i", "j", distance2(vec("l_"), vec("r_")).alias("d2"))


def selected_pairs(points: DataFrame, chosen: Column, radius: float, ident: str, part: Sequence[str] = ()) -> DataFrame:
    """Pairs within `radius` with at least one chosen end, each once."""
    p = points.select(*part, F.col(ident).alias("id"), *AXES, chosen.alias("on"))
    near = radius_join(p.where("on"), p, radius, part).where("l_id <> r_id")
    return near.select(*part, F.least("l_id", "r_id").alias("i"), F.greatest("l_id", "r_id").alias("j"), "d2").dropDuplicates([*part, "i", "j"])


def without_near(left: DataFrame, right: DataFrame, radius: float, ident: str, part: Sequence[str] = ()) -> DataFrame:
    """Rows of `left` with no point of `right` strictly within `radius`."""
    near = radius_join(left.select(*part, ident, *AXES), right.select(*part, *AXES), radius, part, strict=True)
    hit = near.select(*part, F.col(f"l_{ident}").alias(ident)).distinct()
    return left.join(hit, [*part, ident], "left_anti")


def _seen(points: DataFrame, side: float, part: Sequence[str]) -> float:
    """How many points share the cube of a point, on average over points."""
    n = _cells(points.select(*part, *AXES), side, False).groupBy(*part, *[f"__k{a}" for a in AXES]).agg(F.count("*").cast("double").alias("n"))
    return n.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("m")).first()[0] or 0.0


def nearest(left: DataFrame, right: DataFrame, ident: str, rident: str, radius: float, part: Sequence[str] = (), few: float = 8.0) -> DataFrame:
    """(part, ident, rident, d2): the nearest point of `right` within `radius` but the point itself; ties by its id.

    A point that has another within a smaller radius has its nearest one there. So where cubes of `radius` hold more than a `few` points the search begins
    with a smaller radius, which is doubled for those that have found none: pairs grow with the points and not with their square."""
    key = [*part, ident]
    todo, other = left.select(*key, *AXES), right.select(*part, F.col(rident).alias("__r"), *AXES)
    crowd = _seen(right, radius, part)
    halvings = math.ceil(math.log2(crowd / few) / 3) if crowd > few else 0
    out = None
    for step in range(halvings, -1, -1):
        # those that search visit the cubes around theirs, as they become fewer
        near = radius_join(other, todo, radius / 2**step, part).where(F.col(f"r_{ident}") != F.col("l___r"))
        best = near.groupBy(*part, F.col(f"r_{ident}").alias(ident)).agg(F.min(F.struct("d2", F.col("l___r").alias("r"))).alias("b"))
        best = best.select(*key, F.col("b.r").alias(rident), F.col("b.d2").alias("d2"))
        if step:
            best = cut(best)
            todo = cut(todo.join(best.select(*key), key, "left_anti"))
        out = best if out is None else out.unionByName(best)
    return out


class PairList:
    """A Verlet list: pairs within cutoff + skin and the coordinates that they were made from, by `part`.

    A part whose points moved by more than half the skin, or came or went, is made anew by `updated`; the pairs of all others are kept."""

    def __init__(self, points: DataFrame, cutoff: float, skin: float, ident: str, part: Sequence[str] = ()):
        if cutoff <= 0 or skin < 0:
            raise ValueError("a pair list needs a cutoff above zero and a skin of zero or more")
        self.cutoff, self.skin, self.ident, self.part = cutoff, skin, ident, list(part)
        self.reference = cut(points.select(*part, ident, *AXES))
        self.pairs = cut(radius_pairs(self.reference, cutoff + skin, ident, part))

    def _moves(self, points: DataFrame) -> DataFrame:
        """Rows of points that moved too far, came or went."""
        now = points.select(*self.part, self.ident, *[F.col(a).alias(f"n{a}") for a in AXES], F.lit(1).alias("__new"))
        both = self.reference.withColumn("__old", F.lit(1)).join(now, [*self.part, self.ident], "full")
        moved = distance2(vec(), vec("n")) > (self.skin / 2) ** 2
        return both.where(F.col("__old").isNull() | F.col("__new").isNull() | moved)

    def needs_rebuild(self, points: DataFrame) -> bool:
        """Whether any part has to be made anew."""
        return not self._moves(points).isEmpty()

    def stale(self, points: DataFrame) -> DataFrame:
        """(part): the parts to be made anew, those that are new or gone included."""
        return self._moves(points).select(*self.part).distinct()

    def updated(self, points: DataFrame) -> PairList:
        """A new list for `points`: stale parts made anew, pairs and reference of the others as they are. This one stays valid."""
        if not self.part:
            return PairList(points, self.cutoff, self.skin, self.ident) if self.needs_rebuild(points) else self
        old = cut(self.stale(points))
        if old.isEmpty():
            return self
        out = PairList.__new__(PairList)
        out.cutoff, out.skin, out.ident, out.part = self.cutoff, self.skin, self.ident, self.part
        fresh = points.select(*self.part, self.ident, *AXES).join(old, self.part, "left_semi")
        out.reference = cut(self.reference.join(old, self.part, "left_anti").unionByName(fresh))
        made = radius_pairs(out.reference.join(old, self.part, "left_semi"), self.cutoff + self.skin, self.ident, self.part)
        out.pairs = cut(self.pairs.join(old, self.part, "left_anti").unionByName(made))
        return out
