"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

Each text becomes an array of UTF-32 code points. Neighbours of different class stand on a boundary between two units
(every code point, words and the blanks between them, or lines); the boundaries are found for the whole array at once, the ones
of the chosen ranks are taken, and the three slices are encoded again. Nothing but the text of a row is in memory with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import lean, only, table

#: The marks of prefix, suffix and middle.
MARKS = (b"<P>", b"<S>", b"<M>")
UNITS = ("char", "word", "line")
OUT = ("n", "form", "prefix_chars", "middle_chars", "output")


def points(data: bytes) -> np.ndarray:
    """The code points of UTF-8; a byte that is none of it stands for itself, as a lone surrogate."""
    return np.frombuffer(data.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def encoded(p: np.ndarray) -> bytes:
    return p.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


def boundaries(p: np.ndarray, unit: str = "char") -> np.ndarray:
    """0, the places where a further unit begins, and the length; [0] of an empty text."""
    if unit == "word":
        kind = (p == 32) | (p >= 9) & (p <= 13)
    elif unit == "line":
        kind = np.cumsum(np.append(0, p[:-1] == 10)) & 1 if len(p) else p
    else:
        kind = np.arange(len(p)) & 1
    return np.unique(np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(p)]]))


def cut_at(data: bytes, h1: int, h2: int, unit: str = "char") -> tuple[int, int, int, bytes, bytes, bytes]:
    """(units, code points of the prefix and of the middle, prefix, middle, suffix): cut after h1 and h2 modulo (units + 1) units."""
    p = points(data)
    at = boundaries(p, unit)
    n = len(at) - 1
    a, b = sorted((int(at[h1 % (n + 1)]), int(at[h2 % (n + 1)])))
    return n, a, b - a, encoded(p[:a]), encoded(p[a:b]), encoded(p[b:])


def arranged(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    p, s, m = MARKS
    return p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of. No text with a mark is ever rearranged, so the first one of each kind is the mark."""
    if form == "plain":
        return output
    first, second = (MARKS[0], MARKS[1]) if form == "psm" else (MARKS[1], MARKS[0])
    at = output.index(second, len(first))
    end = output.index(MARKS[2], at + 3)
    one, two, middle = output[len(first) : at], output[at + 3 : end], output[end + 3 :]
    return one + middle + two if form == "psm" else two + middle + one


def draws(id_col: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first groups of eight hexadecimal digits of the SHA-256 of `seed:id`; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k}") for k in range(4)]


def transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str = "char", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """All columns of `df` with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if
    plain) and output; own columns of these names are replaced.

    `percent` of the rows are rearranged, `spm_percent` of those with the suffix first. Empty and null texts, and texts that
    hold a mark, stay plain (a null text gives an empty output). Rows are independent: repeated ones give equal results, a null
    id counts as an empty one, an empty table gives none. A very long text takes about ten times its size in its task."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    lean(df.sparkSession)
    own = df.drop(*OUT) if id_col not in OUT and text_col not in OUT else df.drop(*[c for c in OUT if c not in (id_col, text_col)])
    kept = own.schema.fields
    names = [f"__{i}" for i in range(len(kept))]  # by place, so no name clashes with one of ours
    text, ident = own.columns.index(text_col), own.columns.index(id_col)
    rows = own.toDF(*names)
    rows = rows.select(*names, *draws(names[ident], seed), F.coalesce(F.col(names[text]), F.lit("")).cast("binary").alias("__t"))

    def run(batches):
        only("fim")
        for batch in batches:
            k = len(names)
            h = [batch.column(k + j).to_pylist() for j in range(4)]
            n, form, prefix, middle, output = [], [], [], [], []
            for i, value in enumerate(batch.column(k + 4)):
                data = value.as_py()
                units, a, m, *parts = cut_at(data, h[0][i], h[1][i], unit)
                plain = not data or h[2][i] % 100 >= percent or any(x in data for x in MARKS)
                n.append(units)
                form.append("plain" if plain else "spm" if h[3][i] % 100 < spm_percent else "psm")
                prefix.append(None if plain else a)
                middle.append(None if plain else m)
                output.append(data if plain else arranged(form[-1], *parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())], [*names, *OUT])

    schema = ", ".join(f"`{x}` {f.dataType.simpleString()}" for x, f in zip(names, kept))
    made = rows.mapInArrow(run, f"{schema}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.select(*[F.col(x).alias(f.name) for x, f in zip(names, kept)], *OUT[:-1], F.col("output").cast("string").alias("output"))


def restored(df: DataFrame, to: str = "restored") -> DataFrame:
    """All columns of a `transform` result and `to`, the text rebuilt from `output` and `form` alone. Null forms count as plain, null outputs as empty."""
    names = [f"__{i}" for i in range(len(df.columns))]
    kinds = [f.dataType.simpleString() for f in df.schema.fields]
    rows = df.toDF(*names)
    form, output = (names[df.columns.index(c)] for c in ("form", "output"))
    rows = rows.select(*names, F.coalesce(form, F.lit("plain")).alias("__f"), F.coalesce(F.col(output), F.lit("")).cast("binary").alias("__o"))

    def run(batches):
        only("fim")
        for batch in batches:
            got = [restore(o.as_py(), f.as_py()) for f, o in zip(batch.column(len(names)), batch.column(len(names) + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(got, pa.binary())], [*names, "__r"])

    made = rows.mapInArrow(run, ", ".join(f"`{x}` {k}" for x, k in zip(names, kinds)) + ", `__r` binary")
    return made.select(*[F.col(x).alias(c) for x, c in zip(names, df.columns)], F.col("__r").cast("string").alias(to))


def op13(spark, sf_dir) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"))
    return restored(made).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, p) AS a, substring(t, p + 1, q - p) AS m, substring(t, q + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM g
"""
