"""URL filters by host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is a host and a path. It fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's. Every url is expanded into the pairs of its host suffixes, of those numbers of labels that
rules have, and of its path's prefixes of those lengths that rules have; both sides are joined on a short hash prefix of the pair alone. Only
of what meets is the pair cut out of the url again and its full digest taken, which decides. The longest fitting rule wins (host and path together, then host, then text).

Equal urls are judged once. Rules are broadcast if there are at most `most_rules` of them; beyond that the
expressions are pre-aggregated, joined by shuffle and the rules salted, so a hot suffix is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.llm.common import table

#: The rules of the query, in order.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
PREFIX_BITS = 32
MOST_RULES = 200_000
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules(spark: SparkSession, rows=RULES) -> DataFrame:
    return spark.createDataFrame(list(rows), "host string, path string, action string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to / ? # or the end, A-Z lower-cased; the path from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path).cast("binary"), 256)


def _short(digest: Column, bits: int = PREFIX_BITS) -> Column:
    return F.conv(F.substring(digest, 1, bits // 4), 16, 10).cast("long")


def judge(pages: DataFrame, rule_rows: DataFrame, url_col: str = "url", default: str = "allow", most_rules: int = MOST_RULES, prefix_bits: int = PREFIX_BITS) -> DataFrame:
    """All columns of `pages` with host, path, rule (null if none fits) and verdict; own columns of these names are replaced.

    Null urls and urls without `://` have an empty host and path and fit no rule; very long hosts and paths are judged whole. Rules of equal host and
    path: `block` wins. Null hosts or paths of rules count as empty and fit nothing; null actions are dropped. Repeated rows are judged
    once and each get their verdict, a null id is no matter. `prefix_bits`, a multiple of 4, changes how many pairs meet, never the verdict."""
    r = rule_rows.where("action IS NOT NULL").groupBy(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("rh"), F.coalesce("path", F.lit("")).alias("rp")).agg(F.max("action").alias("act")).where("rh <> ''")
    dots = lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))
    sizes = r.agg(F.count("*").alias("n"), F.collect_set(F.length("rp")).alias("l"), F.collect_set(dots(F.col("rh")) + 1).alias("labels")).first()
    lengths = sorted(sizes.l)
    small = sizes.n <= most_rules
    own = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("__u"))
    urls = own.select(F.coalesce(F.col(url_col), F.lit("")).alias("__u")).distinct().select("__u", host.alias("h"), path.alias("p"))
    # a suffix of each number of labels that a rule has, so a host of many labels costs no more than its length for each
    labels = F.filter(F.array(*[F.lit(x) for x in sorted(sizes.labels)]).cast("array<int>"), lambda k: k <= dots(F.col("h")) + 1)
    ends = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda x: x <= F.length("p"))
    expanded = urls.where("h <> ''").select("__u", "h", "p", F.explode(labels).alias("labels")).select("__u", "h", "p", "labels", F.explode(ends).alias("size"))
    suffix = lambda h: F.call_function("substring_index", h, F.lit("."), -F.col("labels"))
    pair = lambda h, p: _digest(suffix(h), p.substr(F.lit(1), F.col("size")))
    e = expanded.select("__u", "labels", "size", _short(pair(F.col("h"), F.col("p")), prefix_bits).alias("k"))
    keyed = r.withColumn("rd", _digest(F.col("rh"), F.col("rp"))).withColumn("rk", _short(F.col("rd"), prefix_bits))
    if small:
        hits = e.join(F.broadcast(keyed), F.col("k") == F.col("rk"))
    else:
        e = e.withColumn("salt", F.pmod(F.xxhash64("__u"), F.lit(SALTS)).cast("int"))
        salted = keyed.withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = e.join(salted, (F.col("k") == F.col("rk")) & (F.col("salt") == F.col("rs")))
    rank = F.struct((F.length("rh") + F.length("rp")).alias("a"), F.length("rh").alias("b"), F.concat("rh", "rp").alias("rule"), F.col("act").alias("act"))
    # the digests are compared in the sum, as a condition would be taken into the join's key
    best = hits.groupBy("__u").agg(F.max(F.when(pair(*host_and_path(F.col("__u"))) == F.col("rd"), rank)).alias("best"))
    out_host, out_path = host_and_path(F.col(url_col))
    joined = own.withColumn("__u", F.coalesce(F.col(url_col), F.lit(""))).join(best, "__u", "left")
    return joined.select(*own.columns, out_host.alias("host"), out_path.alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.act", F.lit(default)).alias("verdict"))


def op5(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules(spark)).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH a AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT row_number() OVER () AS i, page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM a),
r(rh, rp, act) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT i, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(act, length(rh) + length(rp)) AS act
  FROM b JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM b LEFT JOIN m USING (i)
"""
