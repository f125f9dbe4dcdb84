"""Media columns: bytes stored as lossless WebP images, read back, and described by features.

A payload is laid out four bytes a pixel (alpha, red, green, blue), 144 pixels a row or a multiple of
that for long ones; rows beyond the payload are zero. Decoding is that of molframe.llm.webp.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm import webp
from molframe.llm.common import lean, only, table

UNIT = 576
ROW = UNIT // 4
BATCH_BYTES = 4 << 20
#: Images whose first pixels have at most so many colours are looked at for a palette.
FEW = 64


def padded(text: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (UNIT - len(text) if not text else -len(text) % UNIT)


def shape(n: int) -> tuple[int, int]:
    """(width, height) of the image of a payload of n bytes."""
    rows = n // UNIT
    wide = -(-rows // webp.MOST_SIDE)
    return ROW * wide, -(-rows // wide)


def store(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a multiple of UNIT long, as a file; equal ones become equal files.

    Transforms are chosen for each image by estimated bits. Where differences from the left and from green are no shorter than
    the pixels themselves, as in prose, none is taken and images of a batch share their prefix codes; all others, and images of few
    colours, are written by `webp.encode_best`, with modes and multipliers by block and codes of their own."""
    made: dict[bytes, bytes] = {}
    plain: list = []
    todo = list(dict.fromkeys(payloads))
    if todo:
        sides = [shape(len(p)) for p in todo]
        px = [np.frombuffer(p + bytes(w * h * 4 - len(p)), ">u4").astype(np.uint32) for p, (w, h) in zip(todo, sides)]
        size = np.array([len(x) for x in px])
        as_is = webp.plain_is_best(np.concatenate(px), np.cumsum(size) - size)
        for p, x, (w, h), ok in zip(todo, px, sides, as_is):
            if ok and not len(np.unique(x[:4096])) <= min(FEW, len(x) // 8):
                plain.append((p, x, w, h))
            else:
                made[p] = webp.encode_best(x, w, h)
    if plain:
        size = np.array([len(x[1]) for x in plain])
        wide, high = (np.array([x[k] for x in plain], np.int64) for k in (2, 3))
        made |= zip((x[0] for x in plain), webp.encode_many(np.concatenate([x[1] for x in plain]), np.cumsum(size) - size, wide, high))
    return [made[p] for p in payloads]


def samples(pixels: np.ndarray) -> bytes:
    """Pixels as bytes in the order of the payload."""
    return pixels.astype(">u4").tobytes()


def feature(payload: bytes) -> str:
    """Mean and spread of the samples and their histogram over 16 equal bins, per mille."""
    h = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, v = len(payload), np.arange(256)
    mean = int(h @ v) / n
    spread = max(0, n * int(h @ (v * v)) - int(h @ v) ** 2) ** 0.5 / n
    bins = np.rint(1000 * h.reshape(16, 16).sum(1) / n).astype(int).tolist()
    return f"{mean:.3f}|{spread:.3f}|" + ",".join(map(str, bins))


def _batches(col: pa.Array):
    rows, size = [], 0
    for x in col:
        rows.append(x.as_py())
        size += len(rows[-1] or b"")
        if size >= BATCH_BYTES:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def encode(df: DataFrame, column: str, out: str = "media") -> DataFrame:
    """All columns of `df` with `out`: the bytes of `column`, padded, as an image; null stays null."""
    return _mapped(df, column, lambda rows: _some(rows, lambda x: store([padded(p) for p in x])), {out: ("binary", pa.binary())})


def decode(df: DataFrame, column: str = "media") -> DataFrame:
    """All columns of `df` with width, height and pixels (4 bytes a pixel: alpha, red, green, blue) of any lossless file; null stays null, a broken file fails."""

    def run(rows):
        got = _some(rows, webp.decode_many)
        return [[None if x is None else x[0] for x in got], [None if x is None else x[1] for x in got], [None if x is None else samples(x[2]) for x in got]]

    return _mapped(df, column, run, {"width": ("int", pa.int32()), "height": ("int", pa.int32()), "pixels": ("binary", pa.binary())})


def _some(rows, f):
    live = [x for x in rows if x is not None]
    got = iter(f(live))
    return [None if x is None else next(got) for x in rows]


def _mapped(df: DataFrame, column: str, run, added: dict) -> DataFrame:
    lean(df.sparkSession)
    own = df.drop(*added)
    names = [f"k{i}" for i in range(len(own.columns))]
    at = own.columns.index(column)
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, own.schema))

    def go(batches):
        for batch in batches:
            done = 0
            for rows in _batches(batch.column(at)):
                got = run(rows)
                got = got if len(added) > 1 else [got]
                part = batch.slice(done, len(rows))
                done += len(rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, t) for x, (_, t) in zip(got, added.values())]], [*names, *[f"o{i}" for i in range(len(added))]])

    out = own.toDF(*names).mapInArrow(go, f"{kinds}, " + ", ".join(f"o{i} {k}" for i, (k, _) in enumerate(added.values())))
    return out.toDF(*own.columns, *added)


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads the stored bytes back and describes them; null and empty texts are one unit of 255.

    One row per row: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the payload's last 32
    bytes), media_bytes, media_sha256, feature, width, height. Storing and reading share a task, a batch of
    BATCH_BYTES at a time; use `encode` and `decode` for columns of their own."""
    lean(df.sparkSession)
    rows = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    fields = {"n_bytes": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string()), "width": ("int", pa.int32()), "height": ("int", pa.int32())}

    def run(batches):
        only("media")
        for batch in batches:
            done = 0
            for texts in _batches(batch.column(1)):
                sizes = [len(padded(t)) for t in texts]
                files = store([padded(t) for t in texts])
                got = []
                for t, n, f, (w, h, px) in zip(texts, sizes, files, webp.decode_many(files)):
                    payload = samples(px)[:n]
                    got.append((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(f), hashlib.sha256(f).hexdigest(), feature(payload), w, h))
                part = batch.column(0).slice(done, len(texts))
                done += len(texts)
                yield pa.RecordBatch.from_arrays([part, *[pa.array(x, t) for x, (_, t) in zip(zip(*got), fields.values())]], ["i", *fields])

    return rows.mapInArrow(run, f"i {kind}, " + ", ".join(f"{n} {k}" for n, (k, _) in fields.items())).withColumnRenamed("i", id_col)


def op2(spark, sf_dir) -> DataFrame:
    return describe(table(spark, sf_dir, "documents"))
