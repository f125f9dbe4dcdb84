"""Order-aware relational operators: running state, ranked choice, first-seen ids, neighbours in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.runtime import cut


def running_state(df: DataFrame, part: Sequence[str], order: Sequence, state: Column, out: str) -> DataFrame:
    """`out`: the last state that is not null up to a row, in order within its partition."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.last(state, ignorenulls=True).over(w))


def block_ids(df: DataFrame, part: Sequence[str], order: Sequence, starts: Column, out: str) -> DataFrame:
    """`out`: how many rows up to this one start a block."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.sum(starts.cast("int")).over(w))


def best_row(df: DataFrame, key: Sequence[str], order: Sequence, candidates: str | None = None) -> DataFrame:
    """The first row of each key in order; `candidates` counts the rows it was chosen from."""
    w = W.partitionBy(*key)
    ranked = df.withColumn("__rn", F.row_number().over(w.orderBy(*order)))
    if candidates:
        ranked = ranked.withColumn(candidates, F.count("*").over(w))
    return ranked.where("__rn = 1").drop("__rn")


def best_with_ties(df: DataFrame, key: Sequence[str], score: Column) -> DataFrame:
    """All rows of each key with its highest score."""
    return df.withColumn("__rk", F.rank().over(W.partitionBy(*key).orderBy(score.desc()))).where("__rk = 1").drop("__rk")


def global_rank(df: DataFrame, order: str, out: str, cuts: int = 64) -> DataFrame:
    """`out`: the place of each row from 0 by the numeric column `order`, whose values are distinct.

    A window without a partition would put all rows into one task. Here approximate quantiles cut the values
    into ranges, rows are numbered within their range, and the sizes of the ranges before (at most `cuts` + 1
    numbers) are added."""
    got = df.select(F.percentile_approx(order, [i / cuts for i in range(1, cuts)], 10_000).alias("q")).first().q
    at = F.lit(0)
    for q in sorted(set(got or [])):
        at = at + (F.col(order) >= F.lit(q)).cast("int")
    placed = df.withColumn("__part", at)
    sizes = {r["__part"]: r["count"] for r in placed.groupBy("__part").count().collect()}
    before, n = [], 0
    for k in range(max(sizes, default=0) + 1):
        before.append(n)
        n += sizes.get(k, 0)
    offset = F.element_at(F.array(*[F.lit(v).cast("long") for v in before]), F.col("__part") + 1)
    rank = F.row_number().over(W.partitionBy("__part").orderBy(order)) - 1
    return placed.withColumn(out, (rank + offset).cast("int" if n < 1 << 31 else "long")).drop("__part")


def ranged(df: DataFrame, part: Sequence[str], order: Sequence) -> DataFrame:
    """`df` cut into ranges of (part, order), with the number of each row's range as `__range`; kept, so that the ranges stay as they are."""
    return cut(df.repartitionByRange(*part, *order).withColumn("__range", F.spark_partition_id()))


def part_rank(df: DataFrame, part: Sequence[str], order: Sequence, out: str) -> DataFrame:
    """`out`: the place of each row from 0 in its part, by `order` (ascending, nulls first), for parts of any size.

    Rows are numbered within their range of the part, and the sizes of the ranges before are added, so a part is as many tasks as it has
    ranges; only the sizes, a number for each range, meet by part. Rows that tie in all of `order` are numbered in no fixed order."""
    rows, key = ranged(df, part, order), [*part, "__range"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*part).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    here = _matched(rows, sizes.withColumn("__before", before).drop("__n"), key)
    return here.withColumn(out, (F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1 + F.col("__before")).cast("long")).drop("__range", "__before")


def part_state(df: DataFrame, part: Sequence[str], order: Sequence[str], state: Column, out: str) -> DataFrame:
    """`running_state` for parts of any size: within a range of the part, and where that has none yet, the last one of the ranges before."""
    rows, key = ranged(df.withColumn("__state", state), part, order), [*part, "__range"]
    last = F.max_by("__state", F.when(F.col("__state").isNotNull(), F.struct(*order)))
    carried = F.last("__last", ignorenulls=True).over(W.partitionBy(*part).orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
    ends = rows.groupBy(*key).agg(last.alias("__last")).withColumn("__carried", carried).drop("__last")
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = _matched(rows, ends, key)
    return here.withColumn(out, F.coalesce(F.last("__state", ignorenulls=True).over(w), "__carried")).drop("__range", "__carried", "__state")


def _matched(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each row of `left` with the row of `right` of its key; null keys match each other."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in key})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in key])
    return left.join(r, on).drop(*[f"__r_{k}" for k in key])


def first_seen(df: DataFrame, part: Sequence[str], key: Sequence[str], order: str, picks: dict[str, Column], out: str, large: bool = False) -> DataFrame:
    """One row per (part, key) with a dense id `out` from 0 by first appearance; `picks` are taken from its first row. `large` parts are numbered by ranges."""
    aggs = [F.min_by(c, F.col(order)).alias(n) for n, c in picks.items()]
    grouped = df.groupBy(*part, *key).agg(F.min(order).alias("__first"), *aggs)
    if not part:
        return global_rank(grouped, "__first", out).drop("__first")
    if large:
        return part_rank(grouped, part, ["__first"], out).withColumn(out, F.col(out).cast("int")).drop("__first")
    return grouped.withColumn(out, F.row_number().over(W.partitionBy(*part).orderBy("__first")) - 1).drop("__first")


def end_flags(df: DataFrame, part: Sequence[str], order: Sequence, first: str, last: str) -> DataFrame:
    """Flags of the first and the last row of each partition."""
    w = W.partitionBy(*part)
    n = F.row_number().over(w.orderBy(*order))
    return df.withColumn("__n", n).withColumn(first, F.col("__n") == 1).withColumn(last, F.col("__n") == F.count("*").over(w)).drop("__n")


def with_neighbour(df: DataFrame, part: Sequence[str], order: Sequence, columns: dict[str, str], offset: int = 1) -> DataFrame:
    """Columns of the row `offset` places on (back if negative), under new names."""
    w = W.partitionBy(*part).orderBy(*order)
    pick = (lambda c: F.lead(c, offset)) if offset > 0 else (lambda c: F.lag(c, -offset))
    return df.withColumns({new: pick(old).over(w) for old, new in columns.items()})


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row per key: the one loaded last. A map-side aggregate, not a sort."""
    rest = [c for c in df.columns if c not in {*key, order}]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__v"))
    return best.select(*key, "__v.*")


def missing_from(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `left` without a partner; keys compare null-safe."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in key]).distinct()
    on = None
    for k in key:
        e = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = e if on is None else on & e
    return left.join(r, on, "left_anti")
