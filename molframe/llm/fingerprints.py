"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

Terms are the words of a text ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), weighted by their counts. For every
sample j a term t of weight w draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of (t, j), takes
k = floor(ln w / r + b) and ln a = ln c - r (k - b) - r; the sample is the term and k of least a. Two texts
share a sample with probability sum(min(w)) / sum(max(w)), the generalised Jaccard similarity. As a is a
function of (t, j, k) alone, the least ln a itself stands for the sample, so a signature is SAMPLES
minima, which Spark aggregates before any shuffle and within generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from molframe.llm.common import table

SAMPLES = 32
WORDS = "[\\x20\\x09-\\x0D]+"
BUCKET_ROWS = 1_000
MOST_BUCKETS = 100_000
CUTS = 128


def _unit(h: Column, shift: int) -> Column:
    """21 bits of a hash as a number in (0, 1)."""
    return (F.shiftrightunsigned(h, shift).bitwiseAND(0x1FFFFF) + 0.5) / float(1 << 21)


def samples(term: Column, log_weight: Column, n: int = SAMPLES) -> list[Column]:
    """ln a of a term of that weight, for each of n samples."""
    out = []
    for j in range(n):
        h, g = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
        r = -F.log(_unit(h, 0) * _unit(h, 21))
        b = _unit(h, 42)
        log_c = F.log(-F.log(_unit(g, 0) * _unit(g, 21)))
        out.append(log_c - r * (F.floor(log_weight / r + b) - b + 1.0))
    return out


def signatures(df: DataFrame, keys: list[str], text_col: str, carried: dict[str, Column] | None = None, n: int = SAMPLES) -> DataFrame:
    """(keys, sig array<double>, carried) per distinct keys; keys must identify a text. Blank and null texts: a signature of nulls.

    `carried`: non-negative longs of a text (or null). They travel as words that start with a space, which
    no word does, so the two aggregations hold numbers only and stay in generated code. If `df` is already
    dealt by some of `keys` this adds no shuffle."""
    carried = carried or {}
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    notes = [F.coalesce(F.concat(F.lit(f" {chr(48 + i)}"), c.cast("string")), F.lit("")) for i, c in enumerate(carried.values())]
    words = df.select(*keys, F.explode(F.concat(F.split(text, WORDS), F.array(*notes)) if notes else F.split(text, WORDS)).alias("w")).where("w <> ''")
    noted = F.substring("w", 1, 1) == " "
    lane = F.when(noted, F.ascii(F.substring("w", 2, 1)) - 48).otherwise(-1)
    terms = words.select(*keys, lane.alias("lane"), F.when(noted, F.substring("w", 3, 30).cast("long")).otherwise(F.xxhash64("w")).alias("t"))
    counted = terms.groupBy(*keys, "lane", "t").agg(F.log(F.count("*")).alias("lw"))
    far = F.when(F.col("lane") < 0, 0.0).otherwise(1e300)
    drawn = [F.min(x + far).alias(f"s{j}") for j, x in enumerate(samples(F.col("t"), F.col("lw"), n))]
    got = counted.groupBy(*keys).agg(*drawn, *[F.max(F.when(F.col("lane") == i, F.col("t"))).alias(k) for i, k in enumerate(carried)])
    return got.select(*keys, F.array(*[F.when(F.col(f"s{j}") < 1e299, F.col(f"s{j}")) for j in range(n)]).alias("sig"), *carried)


def likeness(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """Share of equal samples: estimates the generalised Jaccard similarity; two blank texts are alike."""
    same = [a[j].eqNullSafe(b[j]).cast("int") for j in range(n)]
    return sum(same[1:], same[0]) / float(n)


def printable(sig: Column, n: int = SAMPLES) -> Column:
    """8 hex digits a sample."""
    part = lambda j: F.lpad(F.hex(F.shiftrightunsigned(F.xxhash64(F.coalesce(sig[j], F.lit(0.0)), F.lit(j)), 32)), 8, "0")
    return F.lower(F.concat(*[part(j) for j in range(n)]))


def _tie(text: Column) -> Column:
    """The order of equal ids: a hash of the text."""
    return F.xxhash64(text)


def ranges(ids: DataFrame, id_col: str, tie_col: str, rows: int = BUCKET_ROWS) -> tuple[Column, int]:
    """(bucket of a row, number of buckets): rising with (id, tie), about `rows` rows each, at most about MOST_BUCKETS.

    Approximate quantiles cut the ids into at most CUTS parts of equal size, each part is cut evenly by
    value. So the expression stays short, and gaps or dense runs of ids do not fill a bucket. An id that is
    several quantiles, as one that a third of the rows have, is a part of its own, cut evenly by the tie.
    Null ids are such a part too, below the others."""
    x = F.col(id_col)
    got = ids.select(F.count("*").alias("all"), F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    wanted = min(MOST_BUCKETS, max(1, -(-got.n // rows)))
    parts = min(CUTS, wanted)
    q = ids.select(F.percentile_approx(x, [i / parts for i in range(parts + 1)], 10_000).alias("q")).first().q if got.n else [0, 0]
    inner = -(-wanted // parts)
    own = {v for v in q if q.count(v) > 2}
    # parts by their least id: those of one id, and the gaps between
    cuts = sorted({got.lo or 0, *q[1:-1], *[v + 1 for v in own if v < (got.hi or 0)]})
    ends = [*cuts[1:], (got.hi or 0) + 1]
    cells = [inner * q.count(v) if v in own else inner for v in cuts]
    first = [sum(cells[:i]) for i in range(len(cells))]
    share = F.col(tie_col).cast("double") / float(1 << 64) + 0.5

    def cell(i: int) -> Column:
        at = share if cuts[i] in own else (x.cast("double") - float(cuts[i])) / float(ends[i] - cuts[i])
        return F.greatest(F.lit(0), F.least(F.floor(at * float(cells[i])).cast("int"), F.lit(cells[i] - 1))) + first[i]

    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return cell(lo)
        mid = (lo + hi + 1) // 2
        return F.when(x >= cuts[mid], part(mid, hi)).otherwise(part(lo, mid - 1))

    nulls = max(1, min(MOST_BUCKETS, -(-(got["all"] - got.n) // rows)))
    null = F.greatest(F.lit(0), F.least(F.floor(share * float(nulls)).cast("int"), F.lit(nulls - 1))) - nulls
    return F.when(x.isNull(), null).otherwise(part(0, len(cuts) - 1)), sum(cells) + nulls


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = BUCKET_ROWS) -> DataFrame:
    """(b, rn, ghost, id, text, next): the next text in descending id order, after the last one the first.

    The ids are cut into ranges, the rows dealt by range, and the first row of each range is repeated at
    the end of the range before it (`ghost`), so the texts move once and no task sees more than its range.
    Equal ids follow each other in the order of a hash of their texts; null ids come last."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("tie", _tie(F.col("text")))
    bucket, n = ranges(d.select("id", "tie"), "id", "tie", rows)
    own = d.select("id", "tie", "text", bucket.alias("b"))
    # one row a range, at most about MOST_BUCKETS: small enough for one task and for a broadcast
    down, every = W.partitionBy(F.lit(0)).orderBy(F.col("b").desc()), W.partitionBy(F.lit(0))
    firsts = own.groupBy("b").agg(F.max(F.struct("id", "tie")).alias("m"))
    firsts = firsts.select(F.col("b").alias("fb"), F.col("m.id").alias("mi"), F.col("m.tie").alias("mt"), F.coalesce(F.lag("b").over(down), F.min("b").over(every)).alias("to"))
    same = (F.col("b") == F.col("fb")) & F.col("id").eqNullSafe(F.col("mi")) & (F.col("tie") == F.col("mt"))
    extra = own.join(F.broadcast(firsts), same).select("id", "tie", "text", F.col("to").alias("b"), F.lit(True).alias("ghost"))
    w = W.partitionBy("b").orderBy("ghost", F.col("id").desc_nulls_last(), F.col("tie").desc(), "text")
    dealt = own.withColumn("ghost", F.lit(False)).unionByName(extra).repartition(n, "b")
    return dealt.select("*", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next")).select("b", "rn", "ghost", "id", "text", "next")


def edit(text: Column, nxt: Column) -> Column:
    """`text` whose last third is replaced by as many first characters of `nxt`, or all of it."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - third), F.substring(nxt, F.lit(1), third))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES, rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty, and empty or blank texts are alike (1.0). Equal ids are ordered by a hash of their text. One
    document alone is its own next one. Further columns of `docs` are not used."""
    rows_ = with_next(docs, id_col, text_col, rows)
    e = edit(F.col("text"), F.coalesce("next", "text"))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("x")), F.struct(F.lit(1).alias("v"), e.alias("x")))
    head = rows_.select("b", "rn", "ghost", "id", F.char_length("text").cast("long").alias("n_chars"), F.explode(F.when(F.col("ghost"), F.slice(both, 1, 1)).otherwise(both)).alias("z"))
    sha = F.when(F.col("z.v") == 1, F.sha2(F.col("z.x").cast("binary"), 256))
    head = head.select("b", "rn", "ghost", "id", "n_chars", "z.v", sha.alias("sha"), F.col("z.x").alias("x"))
    carried = {"ghost": F.col("ghost").cast("long"), "pos": F.when(F.col("id") >= 0, F.col("id")), "neg": F.when(F.col("id") < 0, -(F.col("id") + 1)), "n_chars": F.col("n_chars")}
    carried |= {f"h{i}": F.conv(F.substring("sha", 1 + 13 * i, 13), 16, 10).cast("long") for i in range(5)}
    sig = signatures(head, ["b", "rn", "v"], "x", carried, n)
    digits = F.lower(F.concat(*[F.lpad(F.hex(f"h{i}"), 13 if i < 4 else 12, "0") for i in range(5)]))
    per = sig.groupBy("b", "rn").agg(
        (F.max("ghost") == 1).alias("ghost"), F.max(F.coalesce(F.col("pos"), -F.col("neg") - 1)).alias("id"), F.max("n_chars").alias("n_chars"), F.max(digits).alias("sha"),
        F.max(F.when(F.col("v") == 0, F.col("sig"))).alias("s0"), F.max(F.when(F.col("v") == 1, F.col("sig"))).alias("s1"),
    )
    nxt = F.coalesce(F.lead("s0").over(W.partitionBy("b").orderBy("rn")), F.col("s0"))
    out = per.withColumn("s2", nxt).where("NOT ghost")
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), printable(F.col("s0"), n).alias("fingerprint"), printable(F.col("s1"), n).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1"), n).alias("near_edited"), likeness(F.col("s0"), F.col("s2"), n).alias("near_next"),
    )


def op10(spark, sf_dir) -> DataFrame:
    return fingerprint(table(spark, sf_dir, "documents"))
