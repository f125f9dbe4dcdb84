"""SentencePiece encoding and decoding by a max-plus scan.

A segmentation is a path through the lattice of vocabulary pieces of a text. Weights live in the
max-plus semiring: for a unigram model a piece weighs its score; for a BPE model it weighs 0, and two
neighbours may only follow each other if merging their joined text yields just these two (all other
steps weigh minus infinity), which leaves exactly one path, the BPE encoding.

Where no piece spans two characters the lattice has one state, so the text falls apart into segments
that are solved once and kept in a bounded table. Texts over `giant` characters are split into chunks
of `chunk` characters, wherever that falls. The state at a chunk's edge is the piece that holds the
character before it. Each chunk yields the matrix of best weights from its entry states to its exit
states; per text the matrices are combined by an associative scan into the entry and exit state of
every chunk; then every chunk is traced back on its own.

The model file is parsed here and broadcast (its size is checked). Only the identity normaliser is
supported; a model with another one is refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import KEPT_BY, cut, lean, only, table

GIANT = 65_536
CHUNK = 16_384
KEPT = 900_000
MOST_BYTES = 64 << 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NEVER = float("-inf")


def _fields(b: bytes):
    """(field number, value) of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        x = s = 0
        while True:
            c = b[i]
            i += 1
            x |= (c & 127) << s
            s += 7
            if c < 128:
                return x

    while i < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            v = varint()
        elif kind == 2:
            n = varint()
            v, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class PieceModel:
    """A parsed model: `scores` by piece, ids, and the solver of segments."""

    def __init__(self, data: bytes):
        self.ids, self.scores, self.bytes_of, self.byte_id, self.unk, self.kind, self.fallback, prefix = {}, {}, [], {}, 0, 1, False, True
        for field, v in _fields(data):
            if field == 1:
                piece, score, kind = "", 0.0, 1
                for f, x in _fields(v):
                    piece, score, kind = (x.decode(), score, kind) if f == 1 else (piece, struct.unpack("<f", x)[0], kind) if f == 2 else (piece, score, x) if f == 3 else (piece, score, kind)
                n = len(self.bytes_of)
                if kind in (1, 4, 5):
                    self.ids[piece], self.scores[piece] = n, score
                    self.bytes_of.append(piece.replace(SPACE, " ").encode())
                elif kind == 6:
                    self.byte_id[int(piece[3:5], 16)] = n
                    self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                else:
                    self.unk = n if kind == 2 else self.unk
                    self.bytes_of.append(" ⁇ ".encode() if kind == 2 else b"")
            elif field == 2:
                for f, x in _fields(v):
                    self.kind = x if f == 3 else self.kind
                    self.fallback = bool(x) if f == 35 else self.fallback
            elif field == 3:
                for f, x in _fields(v):
                    if f == 1 and x != b"identity" or f == 2 and x:
                        raise ValueError("only the identity normaliser is supported")
                    if f == 4 and x:
                        raise ValueError("models that remove white space are not supported")
                    prefix = bool(x) if f == 3 else prefix
        if self.kind not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.fallback = self.fallback or len(self.byte_id) == 256
        self.prefix = SPACE if prefix else ""
        self.longest = max(map(len, self.ids))
        self.low = min(self.scores.values()) - 10
        spans = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = (lambda t: [t] if t else []) if spans else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.whole = spans
        self._fits: dict[tuple[str, str], bool] = {}
        #: Pieces that can occur, and the longest of them by their first three characters.
        self.good = {p for p in self.ids if len(p) == 1 or self.kind == 1 or self.merge(p) == [p]}
        self.most: dict[str, int] = {}
        for p in self.good:
            self.most[p[:3]] = max(len(p), self.most.get(p[:3], 2))
        self.table = _Table(self)

    def merge(self, text: str) -> list[str]:
        """BPE of a short text by its definition: join the best pair until none is left."""
        s = list(text)
        while True:
            best, at = NEVER, -1
            for i in range(len(s) - 1):
                w = self.scores.get(s[i] + s[i + 1])
                if w is not None and w > best:
                    best, at = w, i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def fits(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a."""
        if self.kind == 1:
            return True
        got = self._fits.get((a, b))
        if got is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            got = self._fits[a, b] = a + b not in self.good and self.merge(a + b) == [a, b]
        return got

    def weight(self, piece: str) -> float:
        return 0.0 if self.kind == 2 else self.scores.get(piece, self.low)

    def starting(self, t: str, s: int, end: int):
        """The lattice's pieces that start at s, shortest first; an unknown character is a piece."""
        yield t[s : s + 1]
        for e in range(s + 2, min(end, s + self.longest) + 1):
            p = t[s:e]
            if p in self.good:
                yield p

    def solve(self, t: str) -> list[str]:
        """Pieces of a text with nothing around it."""
        return self._solve_bpe(t) if self.kind == 2 else self._solve_unigram(t)

    def _solve_bpe(self, t: str) -> list[str]:
        """Depth first along the lattice, long pieces first. A prefix has one encoding, so a place that proved a dead end is never entered again."""
        n, good, fits, most = len(t), self.good, self._fits, self.most
        out, dead, s, prev = [], set(), 0, ""
        size = min(n, most.get(t[:3], 2))
        while s < n:
            while size:
                p = t[s : s + size]
                if (size == 1 or p in good) and s + size not in dead:
                    if not prev:
                        break
                    ok = fits.get((prev, p))
                    if ok or ok is None and self.fits(prev, p):
                        break
                size -= 1
            if size:
                out.append(p)
                prev = p
                s += size
                size = min(n - s, most.get(t[s : s + 3], 2))
            else:
                dead.add(s)
                size = len(out.pop()) - 1
                s -= size + 1
                prev = out[-1] if out else ""
        return out

    def _solve_unigram(self, t: str) -> list[str]:
        best, last = [0.0] + [NEVER] * len(t), [""] * (len(t) + 1)
        for e in range(1, len(t) + 1):
            for s in range(e - 1, max(-1, e - self.longest - 1), -1):
                p = t[s:e]
                if p in self.ids or e - s == 1:
                    w = best[s] + self.weight(p)
                    if w > best[e]:
                        best[e], last[e] = w, p
        out, n = [], len(t)
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def to_ids(self, pieces: list[str]) -> list[int]:
        out, unknown = [], False
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.fallback:
                out += [self.byte_id[c] for c in p.encode()]
            elif not unknown:
                out.append(self.unk)
            unknown = i is None
        return out

    def normal(self, text: str) -> str:
        return (self.prefix + text).replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        t = self.normal(text or "")
        return np.frombuffer(b"".join(map(self.table.__getitem__, self.segments(t))), np.int32)

    def decode(self, ids) -> str:
        t = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return t[1:] if self.prefix and t.startswith(" ") else t

    # -- chunks -----------------------------------------------------------------------------

    def states(self, t: str, p: int) -> list[tuple[int, int]]:
        """(start, end) relative to p of every piece of t that holds the character before p."""
        if p == 0:
            return [(0, 0)]
        out = []
        for s in range(max(0, p - self.longest), p):
            out += [(s - p, s - p + len(x)) for x in self.starting(t, s, len(t)) if s + len(x) >= p]
        return out

    def walk(self, t: str, entries: list[tuple[int, int]], stop: int, back: bool = False):
        """Best weights of paths from each entry piece over pieces that start before `stop`.

        Returns {(start, end): (weights by entry, predecessor)} of the pieces, entries included."""
        size = len(entries)
        found, ends = {}, {}
        for i, x in enumerate(entries):
            w = np.full(size, NEVER)
            w[i] = 0.0
            found[x] = (w, None)
            ends.setdefault(x[1], []).append(x)
        for s in range(min(e for _, e in entries), stop):
            here = ends.pop(s, None)
            if not here:
                continue
            for p in self.starting(t, s, len(t)):
                w, come = None, None
                for y in here:
                    if y[0] == y[1] or self.fits(t[y[0] : y[1]], p):
                        v = found[y][0] + self.weight(p)
                        if w is None:
                            w, come = v, y
                        else:
                            come = y if back and v[0] > w[0] else come
                            w = np.maximum(w, v)
                if w is not None:
                    found[s, s + len(p)] = (w, come)
                    ends.setdefault(s + len(p), []).append((s, s + len(p)))
        return found

    def edges(self, t: str, p: int, q: int) -> tuple[int, int] | None:
        """First and last place in [p, q] that no piece spans; None if there is none."""
        if self.whole:
            return None
        first = 0 if p == 0 else self._edge(t, p, 1)
        last = q if q == len(t) else self._edge(t, q, -1)
        return (first, last) if 0 <= first <= q and last >= p else None

    @staticmethod
    def _edge(t: str, i: int, step: int) -> int:
        """The nearest place from i on, in the direction of `step`, between another character and a space; -1 if there is none."""
        while True:
            i = t.find(SPACE, i) if step > 0 else t.rfind(SPACE, 0, i + 1)
            if i <= 0:
                return -1
            if t[i - 1] != SPACE:
                return i
            i += step

    def matrix(self, t: str, p: int, q: int) -> np.ndarray:
        """Best weights from every state at p to every state at q."""
        a, b = self.states(t, p), self.states(t, q)
        a, b = [(s + p, e + p) for s, e in a], [(s + q, e + q) for s, e in b]
        hard = self.edges(t, p, q)
        if hard is None:
            got = self.walk(t, a, q)
            return np.stack([got[x][0] if x in got else np.full(len(a), NEVER) for x in b], 1) if b else np.zeros((len(a), 0))
        first, last = hard
        got = self.walk(t, a, first)
        left = reduce(np.maximum, [w for x, (w, _) in got.items() if x[1] == first], np.full(len(a), NEVER))
        mid = 0.0 if self.kind == 2 else sum(self.weight(x) for seg in self.segments(t[first:last]) for x in self.solve(seg))
        if last == q:
            fresh = self.walk(t, [(last, last)], last)
            right = np.array([0.0 if x[1] == q else NEVER for x in b])
            if first == last:
                mine = np.stack([got[x][0] if x in got and x[1] == q else np.full(len(a), NEVER) for x in b], 1)
                return mine
            tail = self._ending(t, first, last)
            right = np.array([0.0 if x == tail else NEVER for x in b])
        else:
            fresh = self.walk(t, [(last, last)], q)
            right = np.array([fresh[x][0][0] if x in fresh else NEVER for x in b])
        return left[:, None] + mid + right[None, :]

    def _ending(self, t: str, first: int, last: int) -> tuple[int, int]:
        """The last piece of the segments in t[first:last]."""
        piece = self.solve(self.segments(t[first:last])[-1])[-1]
        return last - len(piece), last

    def trace(self, t: str, p: int, q: int, a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
        """Ids of the pieces after state a, up to and with state b."""
        a, b = (a[0] + p, a[1] + p), (b[0] + q, b[1] + q)
        hard = self.edges(t, p, q)

        def path(entry, stop, goal):
            got = self.walk(t, [entry], stop, back=True)
            x = goal if goal in got else max((y for y in got if y[1] == goal), key=lambda y: got[y][0][0])
            out = []
            while x != entry:
                out.append(t[x[0] : x[1]])
                x = got[x][1]
            return out[::-1]

        if hard is None:
            return np.array(self.to_ids(path(a, q, b)), np.int32)
        first, last = hard
        if first == last == q:
            return np.array(self.to_ids(path(a, q, b)), np.int32)
        parts = [self.to_ids(path(a, first, first)), np.frombuffer(b"".join(map(self.table.__getitem__, self.segments(t[first:last]))), np.int32)]
        if last < q:
            parts.append(self.to_ids(path((last, last), q, b)))
        return np.concatenate([np.asarray(x, np.int32) for x in parts])


class _Table(dict):
    """Ids of segments, as bytes; the older half goes when it holds KEPT of them."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model, self.older = model, {}

    def __missing__(self, segment: str) -> bytes:
        got = self.older.get(segment)
        if got is None:
            got = array("i", self.model.to_ids(self.model.solve(segment))).tobytes()
        if len(segment) <= 64:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = got
        return got


_loaded: dict[int, PieceModel] = {}
KEPT_BY["sentencepiece"] = _loaded.clear


def _model(held) -> PieceModel:
    """The worker's model, parsed once per broadcast."""
    only("sentencepiece")
    if held.id not in _loaded:
        _loaded.clear()
        _loaded[held.id] = PieceModel(held.value)
    return _loaded[held.id]


class _Held:
    def __init__(self, spark, path: str):
        with open(path, "rb") as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            raise ValueError("the model is too large to broadcast")
        PieceModel(data)
        self.broadcast, self.id = spark.sparkContext.broadcast(data), hash(data)

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def combine(steps: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive max-plus prefix products of matrices, by the associative (doubling) scan."""
    out, d = list(steps), 1
    times = lambda x, y: (x[:, :, None] + y[None, :, :]).max(1) if x.size and y.size else np.full((x.shape[0], y.shape[1]), NEVER)
    while d < len(out):
        out = [times(out[i - d], out[i]) if i >= d else out[i] for i in range(len(out))]
        d *= 2
    return out


def choose(steps: list[np.ndarray]) -> list[int]:
    """The best path's state at the end of every step: from the end, the argmax of prefix + step."""
    pre = combine(steps)
    at = int(np.argmax(pre[-1][0]))
    out = [at]
    for i in range(len(steps) - 1, 0, -1):
        at = int(np.argmax(pre[i - 1][0] + steps[i][:, at]))
        out.append(at)
    return out[::-1]


def encode(df: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", giant: int = GIANT, chunk: int = CHUNK, decoded: bool = False) -> DataFrame:
    """(id_col, token_ids array<int>) of every row, the texts whole. Null and empty texts: no tokens.

    Every row gives a row, repeated and null ids too. With `decoded` the text that the ids decode to comes
    as a column of that name; for all but giant texts in the same pass, so the ids do not travel twice."""
    lean(df.sparkSession)
    held = _Held(df.sparkSession, path)
    rows = df.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = rows.schema["i"].dataType.simpleString()
    ids = pa.list_(pa.int32())

    def listed(parts: list[np.ndarray]) -> pa.Array:
        off = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))

    def small(batches):
        m = _model(held)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                got = [m.encode(x.as_py()) for x in b.column(1)]
                text = [pa.array([m.decode(x.tolist()) for x in got], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0), listed(got), *text], schema=pa.schema([("i", b.column(0).type), ("ids", ids), *[("decoded", pa.string())] * decoded]))

    def chunks(batches):
        m = _model(held)
        for batch in batches:
            for u, text in zip(batch.column(2).to_pylist(), batch.column(1)):
                t = m.normal(text.as_py())
                for no, p in enumerate(range(0, len(t), chunk)):
                    lo = max(0, p - m.longest)
                    yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([no]), pa.array([t[lo : p + chunk + m.longest]]), pa.array([p - lo]), pa.array([min(len(t), p + chunk) - lo])], ["u", "no", "t", "p", "q"])

    def matrices(batches):
        m = _model(held)
        for batch in batches:
            for u, no, t, p, q in zip(*[c.to_pylist() for c in batch.columns]):
                x = m.matrix(t, p, q)
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([no]), pa.array([x.tobytes()]), pa.array([np.array(m.states(t, p), np.int32).tobytes()]), pa.array([np.array(m.states(t, q), np.int32).tobytes()])], ["u", "no", "w", "a", "b"])

    def scan(pdf):
        pdf = pdf.sort_values("no", ignore_index=True)
        a, b = ([np.frombuffer(x, np.int32).reshape(-1, 2) for x in pdf[c]] for c in ("a", "b"))
        steps = [np.frombuffer(w).reshape(len(x), len(y)) for w, x, y in zip(pdf["w"], a, b)]
        last = steps[-1].copy()
        last[:, b[-1][:, 1] != 0] = NEVER  # the text ends at its end
        at = choose([*steps[:-1], last])
        came = [(0, 0), *[tuple(b[i][at[i]]) for i in range(len(at) - 1)]]
        return pdf[["u", "no"]].assign(s0=[x[0] for x in came], e0=[x[1] for x in came], s1=[b[i][at[i]][0] for i in range(len(at))], e1=[b[i][at[i]][1] for i in range(len(at))])

    def traced(batches):
        m = _model(held)
        for batch in batches:
            for u, no, t, p, q, s0, e0, s1, e1 in zip(*[c.to_pylist() for c in batch.columns]):
                got = listed([m.trace(t, p, q, (s0, e0), (s1, e1))])
                yield pa.RecordBatch.from_arrays([pa.array([u]), pa.array([no]), got], schema=pa.schema([("u", pa.string()), ("no", pa.int64()), ("ids", ids)]))

    usual = rows.where(F.char_length("t") <= giant).mapInArrow(small, f"i {kind}, ids array<int>" + ", decoded string" * decoded)
    big = cut(rows.where(F.char_length("t") > giant).select("i", "t", F.expr("uuid()").alias("u")))
    pieces = cut(big.mapInArrow(chunks, "u string, no long, t string, p long, q long").repartition("u", "no"))
    states = pieces.mapInArrow(matrices, "u string, no long, w binary, a binary, b binary").groupBy("u").applyInPandas(scan, "u string, no long, s0 int, e0 int, s1 int, e1 int")
    done = pieces.join(states, ["u", "no"]).select("u", "no", "t", "p", "q", "s0", "e0", "s1", "e1").mapInArrow(traced, "u string, no long, ids array<int>")
    whole = done.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("x")).select("u", F.flatten("x.ids").alias("ids"))
    giants = big.select("i", "u").join(whole, "u").select("i", "ids")
    giants = decode(giants, path, "ids") if decoded else giants
    return usual.unionByName(giants).withColumnsRenamed({"i": id_col, "ids": "token_ids"})


def decode(df: DataFrame, path: str = MODEL, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All columns of `df` with `out_col`, the text of the ids. Null ids: null. An existing column of that name is replaced."""
    lean(df.sparkSession)
    held = _Held(df.sparkSession, path)
    own = df.drop(out_col)
    names = [f"k{i}" for i in range(len(own.columns))]
    at = own.columns.index(ids_col)
    rows = own.toDF(*names)

    def run(batches):
        m = _model(held)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                off, flat = np.append(0, np.cumsum(b.column(at).value_lengths().fill_null(0).to_numpy())), b.column(at).flatten().to_numpy().tolist()
                text = [None if null else m.decode(flat[i:j]) for i, j, null in zip(off[:-1], off[1:], b.column(at).is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*names, "out"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, own.schema))
    return rows.mapInArrow(run, f"{schema}, out string").toDF(*own.columns, out_col)


def op1(spark, sf_dir) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return out.select("doc_id", F.size("token_ids").alias("n_tokens"), "token_ids", "decoded")
