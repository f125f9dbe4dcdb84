"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII bytes of the lower-cased text. A document's features
are the distinct hashed words, pairs of neighbours and pairs with one word skipped. Per-coordinate
learning rates and L1 leave few weights other than zero; only those are broadcast (at most 2**BITS).

The model is fitted in one task on a bounded, hash-sampled share of the labelled rows (`positives`,
`negatives`: the bounds on the expected numbers).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import fold, lean, only, slices, table, text_buffers

BITS = 20
BLOCK_BYTES = 1 << 20
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, pair and skip pair, repeats included."""
    h = xxhash.xxh64_intdigest
    counts, hashes, flat = [], [], data.tobytes().translate(_WORDS)
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        w = flat[i:j].split()
        counts.append(len(w))
        hashes += map(h, w)
    x = np.array(hashes, np.uint64)
    row = np.repeat(np.arange(len(counts)), counts)
    shift = np.uint64(64 - BITS)
    rows, feats = [row], [(x * _M[0]) >> shift]
    for gap, m in ((1, _M[1]), (2, _M[2])):
        if len(x) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            feats.append((((x[:-gap] * _M[0]) ^ (x[gap:] >> np.uint64(1))) * m >> shift)[same])
    return np.concatenate(rows), np.concatenate(feats).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.1, epochs: int = 4) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) that are not zero."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    rate = lambda v: (beta + np.sqrt(v)) / alpha + l2
    for _ in range(epochs):
        for f, y in examples:
            zf, nf = z[f], n[f]
            w = np.where(np.abs(zf) <= l1, 0.0, -(zf - np.sign(zf) * l1) / rate(nf))
            b = -zb / rate(nb)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30)))
            g = p - y
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / alpha * w
            n[f] = nf + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate(n))
    keep = np.nonzero(w)[0]
    return keep, w[keep], float(-zb / rate(nb))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", positives: int = 2500, negatives: int = 5000) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a hash-sampled share of the ids in `labels` whose expected size `positives` and `negatives` bound.

    Contradictory labels of an id: toxic wins; null labels and null ids are ignored; a null text counts as
    empty; of an id with several rows one text is taken. The sampled ids are broadcast (their number is bounded), so texts move only if sampled. Without
    a row the weights are empty and every score is 0.5."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    u = F.xxhash64(F.col("i").cast("string"), F.lit("toxicity"))
    part = F.pmod(u, F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("y") == 1, min(1.0, positives / max(1, sizes.get(1, 0)))).otherwise(min(1.0, negatives / max(1, sizes.get(0, 0))))
    ids = known.where(part < share).select("i", "y", u.alias("u"))
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # one row an id: of repeated ids the text with the least hash
    one = rows.join(F.broadcast(ids), "i").groupBy("i", "y", "u").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    picked = one.select("t", "y", "u").repartition(1).sortWithinPartitions("u", "t")

    def train(batches):
        only("toxicity")
        examples = []
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            ys = batch.column(1).to_pylist()
            for i, j in slices(off, BLOCK_BYTES):
                row, f = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                both = np.unique(row * (1 << BITS) + f)
                at = np.searchsorted(both >> BITS, np.arange(j - i + 1))
                examples += [(both[at[k] : at[k + 1]] & ((1 << BITS) - 1), ys[i + k]) for k in range(j - i)]
        keep, w, b = ftrl(examples)
        yield pa.RecordBatch.from_arrays([pa.array([keep.tobytes()]), pa.array([w.tobytes()]), pa.array([b])], ["f", "w", "b"])

    got = picked.mapInArrow(train, "f binary, w binary, b double").collect()
    if not got or not sizes:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(got[0].f, np.int64), np.frombuffer(got[0].w, np.float64), got[0].b


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with `score`, the probability of label 1. Null and empty texts get the bias alone; very long ones are read whole."""
    lean(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)  # at most 2**BITS weights
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text_col in keep else [F.col(text_col).alias("t")]))
    at = keep.index(text_col) if text_col in keep else len(keep)  # the text travels once
    schema = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        only("toxicity")
        f, w, b = held.value
        dense = np.zeros(1 << BITS)
        dense[f] = w
        live = dense != 0
        for batch in batches:
            s = np.full(batch.num_rows, b)
            data, off = text_buffers(batch.column(at))
            for i, j in slices(off, BLOCK_BYTES):
                row, feat = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                on = live[feat]
                both = np.unique(row[on] * (1 << BITS) + feat[on])
                s[i:j] += np.bincount(both >> BITS, dense[both & ((1 << BITS) - 1)], j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1 / (1 + np.exp(-np.clip(s, -60, 60))))], [*[f"k{i}" for i in range(len(keep))], "score"])

    return rows.mapInArrow(run, f"{schema}, score double").select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score")


def seen(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.select("doc_id", "toxic").where(fold("doc_id") != 0)


def op9(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, seen(table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
