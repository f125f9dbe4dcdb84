"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w out of W is to give w / W of `target_rows` rows; its rate is that over its number
of rows. Every document gets a uniform number from a hash of its id and the seed, inverts the Poisson
distribution of its source's rate at it, and is exploded by the count. Copies are dealt by a hash of
(id, copy, seed) into shards and sorted by it in each shard: read by (shard, shuffle_key) they are in a
global random order that does not depend on partitions or retries.

Rates over PART are split into equal independent parts, so the inverted table stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import table

PART = 32.0
SHARDS = 4096
WIDE = 52


def uniform(*parts: Column) -> Column:
    """52 bits of md5 of the parts as text, as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, WIDE // 4), 16, 10).cast("long")


def _cumulative(rate: Column) -> Column:
    """P(X <= k), k = 0, 1, ...: as far as the tail is under 2**-52."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, source_col: str = "source") -> DataFrame:
    """One row per source: s, parts, cdf. `weights`: relative target weights; sources that it does not
    name get 1 (without it, all sources are equal). `target_rows`: rows wanted in all (default: as many
    as there are). A null source is a source of its own, named by the empty text."""
    if weights and (min(weights.values()) < 0):
        raise ValueError("weights must not be negative")
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("s")).agg(F.count("*").alias("n"))
    w = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]), F.col("s")), F.lit(1.0))
    sizes = sizes.select("s", "n", w.alias("w"))
    total = sizes.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    wanted = total.n if target_rows is None else target_rows
    out = sizes.select("s", (F.col("w") / F.lit(float(total.w or 1)) * F.lit(int(wanted or 0)) / F.col("n")).alias("rate"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    return out.select("s", "rate", parts.alias("parts"), _cumulative(F.col("rate") / parts).alias("cdf"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: int | None = None, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", most_sources: int = 10_000) -> DataFrame:
    """All columns of `docs` with copy (from 1), shard and shuffle_key, each row as often as drawn.

    Equal ids draw the same count. The table of rates is broadcast if it has at most `most_sources`
    rows and joined by shuffle otherwise. Columns of those names in `docs` are replaced."""
    r = rates(docs, weights, target_rows, source_col).select(F.col("s").alias("__s"), F.col("parts").alias("__parts"), F.col("cdf").alias("__cdf"))
    small = docs.select(F.coalesce(F.col(source_col), F.lit("")).alias("s")).distinct().limit(most_sources + 1).count() <= most_sources
    own = docs.drop("copy", "shard", "shuffle_key")
    joined = own.withColumn("__s", F.coalesce(F.col(source_col), F.lit(""))).join(F.broadcast(r) if small else r, "__s")
    draw = lambda i: F.size(F.filter("__cdf", lambda c: c <= uniform(F.col(id_col), F.lit(seed), i) / float(1 << WIDE)))
    one = F.struct(F.transform(F.sequence(F.lit(1), F.col("__parts")), draw).alias("d"))
    n = F.aggregate(one["d"], F.lit(0), lambda a, b: a + b)
    copies = joined.withColumn("__n", n).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    key = uniform(F.col(id_col), F.lit(seed), F.lit("place"), F.col("copy"))
    dealt = copies.drop("__s", "__parts", "__cdf", "__n").withColumn("shuffle_key", key).withColumn("shard", (F.col("shuffle_key") / (1 << WIDE) * SHARDS).cast("int"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "shuffle_key", id_col)


def op7(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return mix(docs, {"src0": 2.0}).select("doc_id", "source", "text", F.col("copy").cast("int").alias("copy"), "shard", "shuffle_key")


OP7_SQL = f"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
w AS (SELECT s, n, CASE WHEN s = 'src0' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM n),
r AS (SELECT s, w / (SELECT sum(w) FROM w) * (SELECT sum(n) FROM n) / n AS rate FROM w),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 24)),
u AS (
  SELECT doc_id, source, text, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42:1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents),
c AS (SELECT u.*, (SELECT count(*) FROM cdf WHERE cdf.s = coalesce(u.source, '') AND cdf.c <= u.u) AS n FROM u),
x AS (
  SELECT doc_id, source, text, copy::INTEGER AS copy,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':42:place:' || copy::VARCHAR), 1, 13))::BIGINT AS shuffle_key
  FROM (SELECT doc_id, source, text, unnest(range(1, n + 1)) AS copy FROM c))
SELECT doc_id, source, text, copy, floor(shuffle_key / 4503599627370496.0::DOUBLE * {SHARDS})::INTEGER AS shard, shuffle_key FROM x
"""
