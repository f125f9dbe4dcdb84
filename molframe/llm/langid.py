"""Language ID by nearest centroid.

A text becomes a vector of hashed byte n-grams (n = 2, 3) over its lower-cased letters, weighted by
sqrt(tf) * idf and brought to length one. Each language has several spherical k-means centroids; the
nearest by cosine gives the language, and a text too far from every centroid is rejected.

Corpus statistics (document frequencies) cover every training row. The centroids are fitted on a
hash-sampled share of about `per_language` rows of each language (a documented bound), each language in a
task of its own; the driver holds the centroids, `centroids` * DIMS floats a language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import fold, lean, only, slices, text_buffers

DIMS = 8192
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 192
#: A text is rejected if its cosine, raised for texts of under ENOUGH n-grams, is below this share of the 0.1 % quantile
#: of the training rows' own.
REJECTION = 0.5
ENOUGH = 64

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(data: np.ndarray, off: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """float32 matrix (rows, dims) of n-gram counts of the texts in `data` cut at `off`."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    b = _FOLD[data]
    if len(b) == 0:
        return np.zeros((n, dims), np.float32)
    first = np.ones(len(b), bool)
    first[1:] = row[1:] != row[:-1]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | first[1:]
    b, row = b[keep].astype(np.uint32), row[keep] * dims
    two = (b[:-1] << 8) | b[1:]
    same = row[:-1] == row[1:]
    spread = lambda x, k: ((x * np.uint32(k)) >> np.uint32(32 - int(math.log2(dims)))).astype(np.int64)
    cells = [(row[:-1] + spread(two, 2654435761))[same]]
    if len(b) > 2:
        three = (two[:-1] << 8) | b[2:]
        cells.append((row[:-2] + spread(three, 2246822519))[same[:-1] & same[1:]])
    return np.bincount(np.concatenate(cells), minlength=n * dims).reshape(n, dims).astype(np.float32)


def blocks(col: pa.Array):
    """(first row, count matrix) for pieces of a text column that fit in memory; one row is never cut."""
    data, off = text_buffers(col)
    for i, j in slices(off, BLOCK_BYTES):
        for k in range(i, j, BLOCK_ROWS):
            m = min(j, k + BLOCK_ROWS)
            yield k, gram_counts(data[off[k] : off[m]], off[k : m + 1] - off[k])


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    v /= np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-12)[:, None]
    return v


def evidence(cosine: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Cosines as rejection sees them: texts of under ENOUGH n-grams have low ones in any language, about as the root of their number."""
    n = np.maximum(counts.sum(1), 1)
    return cosine / np.sqrt(np.minimum(1.0, n / ENOUGH))


def spherical_kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one; starts from rows picked farthest-first, so it is deterministic."""
    picked = [int(np.argmax(v @ v.mean(0)))]
    near = v @ v[picked[0]]
    while len(picked) < min(k, len(v)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked].copy()
    for _ in range(rounds):
        to = np.argmax(v @ c.T, 1)
        for i in range(len(c)):
            if (to == i).any():
                m = v[to == i].sum(0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: float

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, cosine, whether it is too far) of each row."""
        sim = vectors(counts, self.idf) @ self.centroids.T
        best = np.argmax(sim, 1)
        cosine = np.clip(sim[np.arange(len(best)), best], 0, 1)
        return self.owner[best], cosine, evidence(cosine, counts) < self.least


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = 600, centroids: int = 4) -> LanguageModel:
    """Fit on the rows of `train` that have a text and a label.

    `per_language` bounds the expected number of rows of a language that its task fits on (as vectors of
    DIMS cells). Rows with null texts or labels are ignored; with no row left the
    model has no centroid and every text is rejected."""
    lean(train.sparkSession)
    rows = train.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)

    def frequencies(batches):
        only("langid")
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, m in blocks(batch.column(0)):
                df += (m > 0).sum(0)
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], df]))], ["g", "n"])

    df = {r.g: r.n for r in rows.select("t").mapInArrow(frequencies, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    idf = np.array([math.log((1 + n) / (1 + df.get(g, 0))) + 0.05 for g in range(DIMS)], np.float32)
    # by id and text, so rows without an id are sampled like others; repeated rows count once
    u = F.pmod(F.xxhash64(F.coalesce(F.col("i").cast("string"), F.lit("")), "t", F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    if not sizes:
        return LanguageModel([], idf, np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), 1.0)
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])

    def sampled(batches):
        only("langid")
        for batch in batches:
            for k, m in blocks(batch.column(0)):
                cells = [np.nonzero(x)[0].astype(np.int32) for x in m]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, len(m)), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([x[c].astype(np.float32).tobytes() for x, c in zip(m, cells)], pa.binary())], ["l", "c", "v"])

    def clustered(tab: pa.Table) -> pa.Table:
        """The centroids of one language and the cosines of its sampled rows to their nearest; about per_language rows."""
        only("langid")
        name = tab.column("l")[0].as_py()
        x = np.zeros((tab.num_rows, DIMS), np.float32)
        for r, c, w in zip(x, tab.column("c"), tab.column("v")):
            r[np.frombuffer(c.as_py(), np.int32)] = np.frombuffer(w.as_py(), np.float32)
        order = sorted(range(len(x)), key=lambda i: x[i].tobytes())
        x = x[order]
        x = x[x.any(1)]
        v = vectors(x, idf)
        c = spherical_kmeans(v, centroids) if len(v) else np.zeros((0, DIMS), np.float32)
        own = evidence((v @ c.T).max(1), x).astype(np.float64) if len(v) else np.zeros(0)
        return pa.table({"l": [name], "c": [c.astype(np.float32).tobytes()], "own": [own.tobytes()]}, schema=pa.schema([("l", pa.string()), ("c", pa.binary()), ("own", pa.binary())]))

    found = rows.where(u < share[F.col("l")]).select("t", "l").mapInArrow(sampled, "l string, c binary, v binary").distinct()
    got = {r.l: r for r in found.groupBy("l").applyInArrow(clustered, "l string, c binary, own binary").collect()}
    each = [np.frombuffer(got[k].c, np.float32).reshape(-1, DIMS) if k in got else np.zeros((0, DIMS), np.float32) for k in langs]
    own = np.concatenate([np.ones(1), *[np.frombuffer(got[k].own) for k in langs if k in got]])
    least = REJECTION * float(np.quantile(own, 0.001))
    return LanguageModel(langs, idf, np.concatenate(each), np.repeat(np.arange(len(langs)), [len(c) for c in each]), least)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep` with lang_pred, score (cosine to the nearest centroid, 0 to 1) and rejected.

    Null, empty and letterless texts: lang_pred `und`, score 0, rejected. Very long texts are counted whole. A text that is too far from
    every centroid is rejected too but keeps the name of the nearest language."""
    spark = df.sparkSession
    lean(spark)
    held = spark.sparkContext.broadcast(model)  # DIMS * (1 + centroids * languages) floats
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter")
    at = keep.index(text_col) if text_col in keep else len(keep) + 1  # the text travels once
    rows = df.select(*kept, letters, *([] if text_col in keep else [F.when(letters, F.col(text_col)).otherwise("").alias("t")]))
    schema = ", ".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))

    def run(batches):
        only("langid")
        m = held.value
        for batch in batches:
            n = batch.num_rows
            lang, score, far = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
            if len(m.owner):
                for k, counts in blocks(batch.column(at)):
                    at_ = slice(k, k + len(counts))
                    lang[at_], score[at_], far[at_] = m.predict(counts)
            ok = np.asarray(batch.column(len(keep)).to_numpy(zero_copy_only=False), bool) & bool(len(m.owner))
            names = [m.langs[x] if y else "und" for x, y in zip(lang, ok)]
            score = np.where(ok, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score), pa.array(~ok | far)], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    out = rows.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "rejected")


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id") != 0).select("doc_id", "text", "lang")


def op8(spark, sf_dir) -> DataFrame:
    from molframe.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(training_rows(docs)))
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "rejected")
