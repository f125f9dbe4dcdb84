"""Language-model scoring with an Elias-Fano trie of n-grams up to ORDER words.

Level 1 is the sorted 64-bit word hashes (a word's id is its rank) with exact counts. Level 2 has, for every
word as a context, a monotone pointer to its range of successors and their ids; level 3 the same for every
pair of words, where a successor is named relative to its context: by its rank among the successors of the
pair's second word in level 2. Successors are kept as one non-decreasing sequence (each range continues from the
last value of the range before it) and are searched within the range of their context. Each entry
has its discounted probability max(n(h, w) - D, 0) / c(h), each context its backoff weight
g(h) = 1 - sum over w of (n(h, w) - D) / c(h), as log10 in steps of 2**-12; interpolated
    p(w | h) = entry(h, w) + g(h) p(w | h less its first word),   p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

Counts come from all training rows. Tasks count the n-grams of a batch and send them to shards of a level as sorted
keys, coded by differences, so an n-gram takes about three bytes of a shuffle. A shard holds the n-grams of
contexts that have about `shard_tokens` tokens; a context that alone has more is split by its successors
over shards of its own. Tasks build shards and write each to a file of the shared folder, which scoring
tasks memory-map; where that folder is no file system that Python can open, the driver streams the shards
into it and Spark hands them to the executors. The model grows with the corpus on disk; what the driver
and each task hold is a few numbers a shard.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import KEPT_BY, fold, lean, only, shared_dir, table
from molframe.llm.eliasfano import U64, EliasFano, dump, load

SEED = 42
START, END = xxhash.xxh64_intdigest(b"\r", SEED), xxhash.xxh64_intdigest(b"\n", SEED)  # no word holds these
DISCOUNT = 0.75
ORDER = 3
SHARD_WORDS = 250_000
SHARD_TOKENS = 1_500_000
BATCH_TOKENS = 1_500_000
STEP = 4096.0
MOST_OPEN = 2048
_TOP = U64(24)


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, number of each token, starts): of every text START, its words, END; A-Z is lower-cased here."""
    # words are numbered in the order of their first use, START and END before them
    lists = pc.ascii_split_whitespace(pc.ascii_lower(_strings(texts)))
    words, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    # blanks before the first word and after the last one leave an empty word
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        words, at = words.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[at]
    words = words.dictionary_encode()
    starts = at + 2 * np.arange(len(at))
    x = np.empty(starts[-1], np.int64)
    x[starts[:-1]], x[starts[1:] - 1] = 0, 1
    inner = np.ones(len(x), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    x[inner] = words.indices.to_numpy() + np.int64(2)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, itertools.chain((b"\r", b"\n"), words.dictionary.cast(pa.binary()).to_pylist()), itertools.repeat(SEED)), U64, len(words.dictionary) + 2)
    return hashes, x, starts


def _strings(texts) -> pa.Array:
    """Bytes as strings, whether or not they are UTF-8: only bytes below 128 are looked at."""
    a = pa.array(texts, pa.large_binary())
    return pa.Array.from_buffers(pa.large_string(), len(a), [None, *a.buffers()[1:]])


def _batches(batches):
    """(ids, texts as bytes), from batches (id, text) or (text), of pieces of about BATCH_TOKENS tokens, of one batch or more."""
    ids, got, n = [], [], 0
    for batch in batches:
        *first, text = batch.columns
        first = first[0] if first else pa.nulls(batch.num_rows)
        begin = 0
        for i, x in enumerate(text.cast(pa.binary())):
            got.append(x.as_py() or b"")
            n += len(got[-1]) // 5 + 2
            if n >= BATCH_TOKENS:
                yield pa.concat_arrays([*ids, first.slice(begin, i + 1 - begin)]), got
                ids, got, n, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            ids.append(first.slice(begin))
    if got:
        yield pa.concat_arrays(ids), got


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(64 - 24)) * U64(shards) >> _TOP).astype(np.int64)


def _start(shard: int, shards: int) -> int:
    """The least hash of a shard's range."""
    return -(-(shard << 24) // shards) << 40


def packed(x: np.ndarray) -> bytes:
    """A sorted sequence of longs as differences, byte planes apart: planes of zeros vanish in Spark's compression."""
    return np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _codes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(x, 1e-12)) * STEP), 0, 65535).astype(np.uint16)


_VALUES = 10.0 ** (np.arange(1 << 16) / -STEP)


def _value(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


def _runs(s: np.ndarray):
    """(value, places) of each value of s, places in order."""
    if len(s) and s.max() < 1 << 15:
        s = s.astype(np.int16)  # sorted by radix
    order = np.argsort(s, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(s[order])) + 1):
        if len(part):
            yield int(s[part[0]]), part


def _file_system(spark, folder: str):
    """(Hadoop's file system of a folder, its class of paths)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Files:
    """Blocks of the shards of a level, by number, in files of the shared folder (a qualified url), memory-mapped at most
    MOST_OPEN at a time. They stay in the checkpoint folder and go with it."""

    _open: OrderedDict[str, dict] = OrderedDict()

    def __init__(self, folder: str, name: str):
        self.name = f"{name}-{uuid.uuid4().hex}"
        self.url = f"{folder}/{self.name}"
        self.path = f"/{self.url.removeprefix('file:').lstrip('/')}" if folder.startswith("file:") else None

    def put(self, shard: int, block: bytes) -> bytes | None:
        """In a task: write a file, by a rename, so that a repeated task does no harm; where Python can't, hand the block back."""
        if self.path is None:
            return block
        os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(block)
        os.replace(part, f"{self.path}/{shard}")
        return None

    def gather(self, made: DataFrame) -> dict[int, pa.Row]:
        """On the driver: the other columns of the rows (s, block, ...) by s; blocks are written and handed to the executors."""
        if self.path is not None:
            return {r.s: r for r in made.drop("block").collect()}
        spark, got = made.sparkSession, {}
        fs, path = _file_system(spark, self.url)
        fs.mkdirs(path(self.url))
        for r in made.toLocalIterator():
            out = fs.create(path(f"{self.url}/{self.name}-{r.s}"), True)
            for i in range(0, len(r.block), 1 << 22):
                out.write(bytes(r.block[i : i + (1 << 22)]))
            out.close()
            spark.sparkContext.addFile(f"{self.url}/{self.name}-{r.s}")
            got[r.s] = r
        return got

    def shard(self, s: int) -> dict:
        key = f"{self.name}-{s}"
        if key not in Files._open:
            where = SparkFiles.get(key) if self.path is None else f"{self.path}/{s}"
            a = load(np.memmap(where, np.uint8, "r"))
            Files._open[key] = a | {k: EliasFano.of(a, k) for k in ("keys", "pointers", "before") if f"{k}.n" in a}
            if len(Files._open) > MOST_OPEN:
                Files._open.popitem(last=False)
        Files._open.move_to_end(key)
        return Files._open[key]


KEPT_BY["lm"] = Files._open.clear


def _block(seqs: dict[str, EliasFano], **arrays) -> bytes:
    return dump({f"{n}.{k}": v for n, e in seqs.items() for k, v in e.arrays().items()} | arrays)


class Words:
    """Level 1: (id, count, tokens of the words before it) by hash."""

    def __init__(self, files: Files, number: int, rows: dict):
        self.files, self.number = files, number
        n = np.array([rows[s].n if s in rows else 0 for s in range(number)], np.int64)
        t = np.array([rows[s].tokens if s in rows else 0 for s in range(number)], np.int64)
        self.first, self.before = np.cumsum(n) - n, np.cumsum(t) - t
        self.there, self.V, self.N = n > 0, int(n.sum()), int(t.sum())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unknown words: id -1, count 0."""
        ids, n, before = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        # in the order of hashes, which is that of shards: a shard is read from its beginning to its end
        order = np.argsort(h)
        shard = _word_shard(h[order], self.number)
        for part in np.split(order, np.flatnonzero(np.diff(shard)) + 1):
            s = int(_word_shard(h[part[:1]], self.number)[0]) if len(part) else 0
            if len(part) and self.there[s]:
                a = self.files.shard(s)
                at = a["keys"].find(h[part] - U64(_start(s, self.number)))
                got, at = part[at >= 0], at[at >= 0]
                ids[got] = at + self.first[s]
                n[got] = a["values"][a["codes"][at]]
                before[got] = a["before"].access(at).astype(np.int64) + self.before[s]
        return ids, n, before


class Contexts:
    """How the contexts of a level are dealt over shards: `ordinary` shards, then those of the hot contexts, sorted by id."""

    def __init__(self, ordinary: int, hot: dict[int, int], shard_tokens: int):
        self.ordinary, self.ids = ordinary, np.array(sorted(hot), np.int64)
        self.n = np.array([hot[i] for i in self.ids.tolist()], np.int64)
        self.parts = -(-self.n // shard_tokens)
        self.first = ordinary + np.cumsum(self.parts) - self.parts
        self.number = ordinary + int(self.parts.sum())
        self.shares = np.repeat(np.arange(len(self.ids)), self.parts)  # hot context of each shard after the ordinary ones

    def hot(self, ctx: np.ndarray) -> np.ndarray:
        """Place among the hot contexts, -1 for others."""
        if len(self.ids) == 0:
            return np.full(len(ctx), -1, np.int64)
        at = np.minimum(np.searchsorted(self.ids, ctx), len(self.ids) - 1)
        return np.where(self.ids[at] == ctx, at, -1)

    def place(self, shard: np.ndarray, hot: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The shard of a context's successor: `shard` unless the context is hot; share: tokens before the successor, of all (0 to 1)."""
        if len(self.ids) == 0:
            return shard
        p = self.parts[hot]
        return np.where(hot >= 0, self.first[hot] + np.minimum((share * p).astype(np.int64), p - 1), shard)


class Level:
    """Level 2 or 3. rows: what the build of each shard has told (s, n, first context, hot masses)."""

    def __init__(self, files: Files, contexts: Contexts, rows: dict):
        self.files, self.of = files, contexts
        n = np.array([rows[s].n if s in rows else 0 for s in range(contexts.number)], np.int64)
        self.there, self.n, self.first = n > 0, n, np.cumsum(n) - n
        self.low = np.array([rows[s].low if s in rows else 0 for s in range(contexts.number)], np.int64)
        mass = np.zeros(len(contexts.ids))
        np.add.at(mass, contexts.shares, [rows[s].mass if s in rows else 0.0 for s in range(contexts.ordinary, contexts.number)])
        self.gamma = np.clip(1 - mass, 1e-9, 1.0)

    def find(self, shard: np.ndarray, ctx: np.ndarray, hot: np.ndarray, word: np.ndarray):
        """(entry or -1, its rank among the context's successors, its probability or 0) of each successor `word` of a context,
        given as its number (less `low` its place in the shard) and sorted by shard and context for speed."""
        entry, rank, p = np.full(len(ctx), -1, np.int64), np.full(len(ctx), -1, np.int64), np.zeros(len(ctx))
        for s, part in _runs(np.where(ctx >= 0, shard, -1)):
            if s < 0 or not self.there[s]:
                continue
            a = self.files.shard(s)
            local = np.zeros(len(part), np.int64) if s >= self.of.ordinary else ctx[part] - self.low[s]
            size = a["pointers"].n - 1
            inside = np.flatnonzero((local >= 0) & (local < size))
            part, local = part[inside], local[inside]
            if len(part) == 0:
                continue
            c, inv = np.unique(local, return_inverse=True)
            lo, hi = a["pointers"].access(c).astype(np.int64), a["pointers"].access(c + 1).astype(np.int64)
            base = np.where(lo > 0, a["keys"].access(np.maximum(lo, 1) - 1).astype(np.int64), 0)
            at = a["keys"].find((word[part] + base[inv]).astype(U64), lo[inv], hi[inv])
            ok = at >= 0
            got, at, lo = part[ok], at[ok], lo[inv][ok]
            entry[got] = at + self.first[s]
            start = lo + self.first[s]
            if s >= self.of.ordinary:
                start = np.full(len(got), self.first[self.of.first[self.of.shares[s - self.of.ordinary]]])
            rank[got] = entry[got] - start
            p[got] = _value(a["p"][at])
        return entry, rank, p

    def backoff(self, shard: np.ndarray, ctx: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The backoff weight of each context, 1 for those without successors."""
        g = np.ones(len(ctx))
        for s, part in _runs(np.where((ctx >= 0) & (hot < 0), shard, -1)):
            if s >= 0 and self.there[s]:
                a = self.files.shard(s)
                local = ctx[part] - self.low[s]
                ok = (local >= 0) & (local < len(a["gamma"]))
                g[part[ok]] = _value(a["gamma"][local[ok]])
        g[hot >= 0] = self.gamma[hot[hot >= 0]]
        return g


class Trie:
    """The levels as plain numbers and file names; small enough to travel with a task."""

    def __init__(self, words: Words, starts: int, shard_tokens: int):
        self.words, self.starts, self.shard_tokens = words, starts, shard_tokens
        self.two = self.three = None
        self.V, self.N = words.V, words.N
        self.z = self.N + 0.5 * (self.V + 1)

    def batch(self, texts) -> Batch:
        return Batch(self, *tokens(texts))


class Batch:
    """Tokens of a batch of texts by number, in the order of their ids; START has id V and count `starts`."""

    def __init__(self, trie: Trie, hashes: np.ndarray, x: np.ndarray, at: np.ndarray):
        ids, n, before = trie.words.find(hashes)
        ids[0], n[0], before[0] = trie.V, trie.starts, trie.N
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.trie, self.at, self.x = trie, at, place[x]
        self.ids, self.n, self.before = ids[order], n[order], before[order]
        inner = np.ones(len(x), bool)
        inner[at[:-1]] = False
        self.tokens = np.flatnonzero(inner)  # all but START
        m = len(ids)
        self.pairs, self.pair_of = np.unique(self.x[self.tokens - 1] * m + self.x[self.tokens], return_inverse=True)
        self.a, self.b = self.pairs // m, self.pairs % m

    def of_pairs(self):
        """(shard, context id, place among the hot contexts) of the first word of each pair, and the second one's share."""
        t = self.trie
        shard, hot = self.before // t.shard_tokens, t.two.of.hot(self.ids)
        share = self.before / max(1, t.N)
        return t.two.of.place(shard[self.a], hot[self.a], share[self.b]), self.ids[self.a], hot[self.a]

    def found_pairs(self):
        """(entry, rank, probability) of each pair in level 2; unknown words are in none."""
        shard, ctx, hot = self.of_pairs()
        word = self.ids[self.b]
        return self.trie.two.find(shard, np.where(word >= 0, ctx, -1), hot, word)

    def triples(self, entry: np.ndarray, rank: np.ndarray):
        """Of the tokens that have two before them, where both pairs are known: (distinct triples, which each token has,
        the tokens' places in `tokens`); a triple is a pair's number and its successor's rank, as one key with the radix."""
        third = np.flatnonzero(self.tokens - 2 >= np.repeat(self.at[:-1], np.diff(self.at) - 1))
        first, last = self.pair_of[third - 1], self.pair_of[third]
        known = (entry[first] >= 0) & (rank[last] >= 0)
        radix = self.trie.V + 2
        key, inv, count = np.unique(first[known] * radix + rank[last[known]], return_inverse=True, return_counts=True)
        example = np.zeros(len(key), np.int64)
        example[inv] = last[known]  # any pair of that rank after that context: the same second word
        return key, inv, count, third[known], example

    def of_triples(self, key: np.ndarray, entry: np.ndarray, example: np.ndarray):
        """(shard, context entry, place among the hot contexts, rank) of each triple."""
        t = self.trie
        pair, rank = key // (t.V + 2), key % (t.V + 2)
        ctx = entry[pair]
        hot = t.three.of.hot(ctx)
        shard = np.searchsorted(t.two.first, ctx, "right") - 1
        share = self.before[self.b[example]] / max(1, t.N)
        return t.three.of.place(shard, hot, share), ctx, hot, rank


def _counted(train: DataFrame, text_col: str, count) -> DataFrame:
    """(s, keys, n): for every batch of texts and shard the sorted n-grams and their counts; count(texts) gives (shard, key, n)."""

    def run(batches):
        only("lm")
        for _, texts in _batches(batches):
            shard, key, n = count(texts)
            for s, part in _runs(shard):
                small = np.minimum(n[part], 255).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([packed(key[part])], pa.binary()), pa.array([small.tobytes() + n[part][small == 255].astype("<i8").tobytes()], pa.binary())], ["s", "keys", "n"]
                )

    return train.select(F.col(text_col).alias("t")).mapInArrow(run, "s int, keys binary, n binary")


def _merged(tab: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a shard's blocks, sorted, and their counts."""
    keys, counts = [], []
    for k, n in zip(tab.column("keys"), tab.column("n")):
        keys.append(unpacked(k.as_py()))
        raw, m = n.as_py(), len(keys[-1])
        c = np.frombuffer(raw, np.uint8, m).astype(np.int64)
        c[c == 255] = np.frombuffer(raw, "<i8", -1, m) if len(raw) > m else 255
        counts.append(c)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


_BUILT = pa.schema([("s", pa.int32()), ("block", pa.binary()), ("n", pa.int64()), ("low", pa.int64()), ("mass", pa.float64()), ("hot", pa.list_(pa.int64())), ("hot_n", pa.list_(pa.int64()))])


def _built(tab: pa.Table, files: Files, contexts: Contexts, radix: int, sizes: np.ndarray | None, shard_tokens: int) -> pa.Table:
    """Build and write one shard. A key is a context's number times `radix` plus its successor; sizes: contexts of each shard (else those met)."""
    s = tab.column("s")[0].as_py()
    key, n = _merged(tab)
    ctx, word = key // radix, key % radix
    is_hot = s >= contexts.ordinary
    low = 0 if sizes is not None or is_hot else int(ctx[0])
    size = 1 if is_hot else int(sizes[s]) if sizes is not None else int(ctx[-1]) - low + 1
    local = np.zeros(len(key), np.int64) if is_hot else ctx - low
    whole = np.array([contexts.n[contexts.shares[s - contexts.ordinary]]]) if is_hot else np.bincount(local, n, size)
    p = (n - DISCOUNT) / whole[local]
    mass = np.bincount(local, p, size)
    ends = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=size))])
    full = np.flatnonzero(np.diff(ends))
    last = word[ends[full + 1] - 1]  # of each range that is not empty
    base = np.zeros(size, np.int64)
    base[full] = np.cumsum(last) - last
    keys = EliasFano.build(word + base[local], int(last.sum()) + 1)
    pointers = EliasFano.build(ends, len(n) + 1)
    block = files.put(s, _block({"keys": keys, "pointers": pointers}, p=_codes(p), gamma=_codes(np.clip(1 - mass, 1e-9, 1.0))))
    hot = np.flatnonzero(n > shard_tokens)
    return pa.table({"s": [s], "block": [block], "n": [len(n)], "low": [low], "mass": [float(mass.sum()) if is_hot else 0.0], "hot": [hot.tolist()], "hot_n": [n[hot].tolist()]}, schema=_BUILT)


_KINDS = "s int, block binary, n long, low long, mass double, hot array<long>, hot_n array<long>"


def fit(train: DataFrame, text_col: str = "text", order: int = ORDER, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS) -> Trie:
    """Build the model that `score` takes. Null texts are empty; without rows it knows no word. No n-gram is pruned."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = train.sparkSession
    lean(spark)
    fs, path = _file_system(spark, shared_dir(spark))
    folder = fs.makeQualified(path(shared_dir(spark))).toString()

    def words_of(batches):
        for _, texts in _batches(batches):
            h, x, _ = tokens(texts)
            n = np.bincount(x, minlength=len(h))
            n[0] = 0
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(h[seen].view(np.int64)), pa.array(n[seen])], ["w", "n"])

    counted = train.select(F.col(text_col).alias("t")).mapInArrow(words_of, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    beside = f"{folder}/words-{uuid.uuid4().hex}"
    counted.write.parquet(beside)
    counted = spark.read.schema("w long, n long").parquet(beside)
    number = -(-max(1, counted.count()) // shard_words)
    lex = Files(folder, "words")

    def words_built(tab: pa.Table) -> pa.Table:
        s, h, n = tab.column("s")[0].as_py(), tab.column("w").to_numpy().view(U64), tab.column("n").to_numpy()
        i = np.argsort(h, kind="stable")
        h, n = h[i], n[i]
        values, codes = np.unique(n, return_inverse=True)
        keys = EliasFano.build(h - U64(_start(s, number)), (1 << 64) // number + (1 << 41))
        before = np.cumsum(n) - n
        block = lex.put(s, _block({"keys": keys, "before": EliasFano.build(before, int(n.sum()) + 1)}, values=values, codes=codes.astype(np.min_scalar_type(max(1, len(values) - 1)))))
        hot = np.flatnonzero(n > shard_tokens)
        kinds = pa.schema([("s", pa.int32()), ("block", pa.binary()), ("n", pa.int64()), ("tokens", pa.int64()), ("hot", pa.list_(pa.int64())), ("hot_n", pa.list_(pa.int64()))])
        return pa.table({"s": [s], "block": [block], "n": [len(n)], "tokens": [int(n.sum())], "hot": [hot.tolist()], "hot_n": [n[hot].tolist()]}, schema=kinds)

    top = F.shiftright(F.shiftrightunsigned("w", 40) * number, 24).cast("int")
    made = counted.select("w", "n", top.alias("s")).groupBy("s").applyInArrow(words_built, "s int, block binary, n long, tokens long, hot array<long>, hot_n array<long>")
    rows = lex.gather(made)
    fs.delete(path(beside), True)
    words = Words(lex, number, rows)
    trie = Trie(words, train.count(), shard_tokens)
    hot = {int(words.first[s]) + i: n for s, r in rows.items() for i, n in zip(r.hot, r.hot_n)}
    if trie.starts > shard_tokens:
        hot[words.V] = trie.starts
    trie.two = Level(Files(folder, "pairs"), Contexts(words.N // shard_tokens + 1, hot, shard_tokens), {})

    def pairs(texts):
        b = trie.batch(texts)
        shard, ctx, _ = b.of_pairs()
        return shard, ctx * (trie.V + 2) + b.ids[b.b], np.bincount(b.pair_of, minlength=len(b.pairs))

    def pairs_built(tab: pa.Table) -> pa.Table:
        return _built(tab, trie.two.files, trie.two.of, trie.V + 2, None, shard_tokens)

    rows = trie.two.files.gather(_counted(train, text_col, pairs).groupBy("s").applyInArrow(pairs_built, _KINDS))
    trie.two = two = Level(trie.two.files, trie.two.of, rows)
    if order == 2:
        return trie
    hot = {int(two.first[s]) + i: n for s, r in rows.items() for i, n in zip(r.hot, r.hot_n)}
    trie.three = Level(Files(folder, "triples"), Contexts(two.of.number, hot, shard_tokens), {})

    def triples(texts):
        b = trie.batch(texts)
        entry, rank, _ = b.found_pairs()
        key, _, count, _, example = b.triples(entry, rank)
        shard, ctx, _, rank = b.of_triples(key, entry, example)
        local = np.where(shard < two.of.number, ctx - two.first[np.minimum(shard, two.of.number - 1)], 0)
        return shard, local * (trie.V + 2) + rank, count  # sorted within a shard: pairs have the order of their entries

    def triples_built(tab: pa.Table) -> pa.Table:
        return _built(tab, trie.three.files, trie.three.of, trie.V + 2, two.n, shard_tokens)

    rows = trie.three.files.gather(_counted(train, text_col, triples).groupBy("s").applyInArrow(triples_built, _KINDS))
    trie.three = Level(trie.three.files, trie.three.of, rows)
    trie.three.low[: two.of.number] = two.first  # an ordinary shard has the contexts of a shard of level 2
    return trie


def score(df: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, n_known, train_tokens, base_score, score) of every row; null texts are empty: END alone.

    Words that training never saw have the unigram's 0.5 / Z. Without training rows base_score is 0.
    Repeated rows each get a row, very long texts are a batch of their own, further columns are not used."""
    lean(df.sparkSession)
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        only("lm")
        for ids, texts in _batches(batches):
            b = trie.batch(texts)
            one = (b.n + 0.5) / trie.z
            last = b.x[b.tokens]
            two = one[b.b]
            entry = rank = np.full(len(b.pairs), -1, np.int64)
            if trie.N:
                entry, rank, p = b.found_pairs()
                shard, hot = b.before // trie.shard_tokens, trie.two.of.hot(b.ids)
                two = p + trie.two.backoff(shard, b.ids, hot)[b.a] * two
            s = two[b.pair_of]
            if trie.three is not None and trie.N:
                key, inv, _, at, example = b.triples(entry, rank)
                where = np.searchsorted(trie.two.first, entry, "right") - 1
                back = trie.three.backoff(where, entry, trie.three.of.hot(entry))
                third = np.flatnonzero(b.tokens - 2 >= np.repeat(b.at[:-1], np.diff(b.at) - 1))
                s[third] *= back[b.pair_of[third - 1]]
                _, _, p = trie.three.find(*b.of_triples(key, entry, example))
                s[at] += p[inv]
            # sums of a text in the order of its tokens, START aside
            m = len(texts)
            row = np.repeat(np.arange(m), np.diff(b.at) - 1)
            add = lambda v: np.bincount(row, v, m)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(b.at) - 1), pa.array(add(b.n[last] > 0).astype(np.int64)), pa.array(np.full(m, trie.N, np.int64)), pa.array(add(np.log10(one)[last])), pa.array(add(np.log10(s)))],
                ["i", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    kind = rows.schema["i"].dataType.simpleString()
    out = rows.mapInArrow(run, f"i {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("i", id_col)


def op3(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs.where(fold("doc_id") != 1)))
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
