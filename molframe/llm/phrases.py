"""Phrase collocations by prefix-projected growth of contiguous patterns, one distributed task per prefix.

Everything is counted per language. A-Z are lower-cased, texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at blanks
and tabs into words.

1. Words are counted; those with `least` occurrences or more are the frequent prefixes of length 1.
2. Their occurrences are projected to the word on the right, which counts the prefixes of length 2.
3. The occurrences of frequent pairs are projected to up to three further words on the right, as long as each neighbouring pair
   is frequent. A machine cannot point into the texts of another, so what travels is the projection itself, equal ones summed
   before the shuffle, and packed: a record is what one task has of one prefix. Records are dealt by prefix; in a task the projection of
   a prefix is sorted, an occurrence pointer is a row of it, the occurrences of a longer prefix are a range of rows, and a prefix
   grows to the right, depth first, by cutting its range at the next word. Prefixes of one word that hold over a HOT_SHARE-th of all
   occurrences, or over HOT of them, are dealt by two words, and pairs that do by three.

Words travel as 64-bit hashes, or by their places in the list of frequent ones while that is short. Each hash keeps the least and
greatest word it stands for; if two words meet in one that is frequent, the counts are taken again with another multiplier, so results are
exact. Which pairs, and which words of a long list, are frequent is known to tasks by a bit filter of bounded size; what it lets through by
mistake is counted and then dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molframe.llm.common import cut, lean, only, table, text_buffers

LONGEST, LEAST, TOP = 5, 100, 2000
HOT_SHARE, HOT = 500, 2_000_000
#: Bytes of text that a task counts at once, bytes hashed at once, rows of a projection between two compactions.
CHUNK, HASHED, PROJECTED = 6 << 20, 1 << 20, 1 << 20
#: The filter's size: bits for each key, and the most bits there are (16 MB).
BITS_PER_KEY, MOST_BITS = 32, 1 << 27
#: Frequent words that are sent to tasks as they are (16 MB); of more only the filter is.
MOST_WORDS = 1 << 21
#: Odd multipliers of the word hash, tried in this order.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
MIX = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0: part of a word, 1: blank, 2: end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text, joined) of every word of the texts data[offsets[i]:offsets[i + 1]]; joined: the next word stands in the same piece."""
    kind = _KIND[data]
    word = kind == 0
    first, last = word.copy(), word.copy()  # also where a text begins or ends
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[1:] &= ~word[:-1]
    first[inner] |= word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    ends = np.concatenate([[0], np.cumsum(kind == 2)])
    joined = np.zeros(len(start), bool)
    if len(start):
        joined[:-1] = (ends[start[1:]] == ends[end[:-1]]) & (text[1:] == text[:-1])
    return start, end, text, joined


def hashes(lower: np.ndarray, start: np.ndarray, end: np.ndarray, multiplier: int) -> np.ndarray:
    """64-bit hash of each word, never 0: a polynomial of its bytes, mixed."""
    out = np.zeros(len(start), np.uint64)
    size = end - start
    upto = np.cumsum(size)
    power = np.ones(1, np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + HASHED, "right")))
        n = size[i:j]
        at = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(at, n)
        if len(power) <= (longest := int(n.max())):
            power = np.full(longest + 1, multiplier, np.uint64)
            power[0] = 1
            power = np.cumprod(power)
        byte = lower[place + np.repeat(start[i:j], n)].astype(np.uint64) + np.uint64(1)
        out[i:j] = np.add.reduceat(byte * power[place], at)
        i = j
    out = _mixed(out)
    return np.where(out == 0, np.uint64(1), out)


def chunks(batches):
    """(langs, language of each text, bytes, offsets) of about CHUNK bytes of rows(lang, text)."""

    def made(held):
        tab = pa.Table.from_batches(held)
        lang = tab.column(0).combine_chunks().dictionary_encode()
        return lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False), *text_buffers(tab.column(1))

    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:  # a chunk ends with the text that fills it
            lengths = pc.binary_length(batch.column(1)[at:]).fill_null(0).to_numpy(zero_copy_only=False)
            n = min(len(lengths), int(np.searchsorted(np.cumsum(lengths), CHUNK - size)) + 1)
            held.append(batch.slice(at, n))
            size += int(lengths[:n].sum())
            at += n
            if size >= CHUNK:
                yield made(held)
                held, size = [], 0
    if held:
        yield made(held)


def counted_words(rows: DataFrame, multiplier: int) -> DataFrame:
    """(lang, h, f, low, high): occurrences of each word hash and the words it stands for; h = 0 has the number of all occurrences."""

    def run(batches):
        only("phrases")
        for langs, lang, data, offsets in chunks(batches):
            lower = _LOWER[data]
            start, end, text, _ = words(lower, offsets)
            own = lang[text]
            h = hashes(lower, start, end, multiplier)
            for k, name in enumerate(langs):
                here = np.flatnonzero(own == k)
                if not len(here):
                    continue
                value, first, inverse = np.unique(h[here], return_index=True, return_inverse=True)
                n = np.bincount(inverse, minlength=len(value))
                # all words of equal hash are equal, unless two words of this chunk differ
                a, b = start[here], end[here]
                raw = lower.tobytes()
                low = [raw[x:y] for x, y in zip(a[first].tolist(), b[first].tolist())]
                high = [None] * len(low)
                if odd := _differing(lower, a, b, first, inverse):
                    for c in odd:
                        every = {raw[x:y] for x, y in zip(a[inverse == c].tolist(), b[inverse == c].tolist())}
                        low[c], high[c] = min(every), max(every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (len(value) + 1)), pa.array(np.append(value.view(np.int64), 0)), pa.array(np.append(n, len(here))), pa.array([*low, b""], pa.binary()), pa.array([*high, None], pa.binary())],
                    ["lang", "h", "f", "low", "high"],
                )

    made = rows.mapInArrow(run, "lang string, h long, f long, low binary, high binary")
    return made.groupBy("lang", "h").agg(F.sum("f").alias("f"), F.min("low").alias("low"), F.greatest(F.max("low"), F.max("high")).alias("high"))


def _differing(lower: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> list[int]:
    """Of the groups of words of equal hash those that hold two different words, by length and two further byte sums."""
    if len(a) == len(first):
        return []
    top = first[inverse]
    size = b - a
    bad = size != size[top]
    total = np.concatenate([[0], np.cumsum(lower, dtype=np.int64)])
    sums = total[b] - total[a]
    bad |= sums != sums[top]
    weighted = np.concatenate([[0], np.cumsum(lower * np.arange(len(lower), dtype=np.int64))])
    inner = weighted[b] - weighted[a] - a * sums
    bad |= inner != inner[top]
    return np.unique(inverse[bad]).tolist()


class Filter:
    """A bit filter of bounded size: `has` is true for all keys it was made of, and for few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> list[np.ndarray]:
        mask = np.uint64(size - 1)
        return [((_mixed(keys + np.uint64(k)) >> np.uint64(7)) & mask).astype(np.int64) for k in (1, 2)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1 for p in self.places(keys, 8 * len(self.bits)))
        return (one & two).astype(bool)

    @staticmethod
    def of(df: DataFrame, key, most: int = MOST_BITS) -> Filter:
        """Of the rows of `df`; key(columns as arrays) gives their unsigned keys. Tasks set bits, words of equal place are joined, and at most `most` bits reach the driver."""
        n = df.count()
        size = 1 << max(12, min(most.bit_length() - 1, int(BITS_PER_KEY * max(1, n) - 1).bit_length()))

        def run(batches):
            word = np.zeros(size // 64, np.uint64)
            for batch in batches:
                for p in Filter.places(key(*[c.to_numpy(zero_copy_only=False) for c in batch.columns]), size):
                    np.bitwise_or.at(word, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
            at = np.flatnonzero(word)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(word[part].view(np.int64))], ["i", "w"])

        got = df.mapInArrow(run, "i long, w long").groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
        word = np.zeros(size // 64, np.int64)
        word[got.column("i").to_numpy()] = got.column("w").to_numpy()
        return Filter(word.view(np.uint8))


class Codes:
    """What tasks know of the frequent words: their keys in order, if there are at most `most`, and a word's code is its place from 1; else a filter, and the code is the hash."""

    def __init__(self, frequent: DataFrame, most: int = MOST_WORDS):
        self.keys = self.filter = None
        if frequent.count() <= most:
            got = frequent.select("lang", "h").toArrow()
            keys = np.sort(word_keys(got.column("lang").to_numpy(), got.column("h").to_numpy()))
            if (keys[1:] != keys[:-1]).all():  # else words of two languages have one key
                self.keys = keys
        if self.keys is None:
            self.filter = Filter.of(frequent.select("lang", "h"), word_keys)

    def of(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, whether it is frequent, as far as known) of each word."""
        if self.keys is None:
            return h.view(np.int64), self.filter.has(keys)
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at + 1, self.keys[at] == keys


def _tongue(lang: str) -> np.uint64:
    h = 0
    for b in lang.encode():
        h = (h * 1099511628211 + b + 1) % (1 << 64)
    return np.uint64(h)


def word_keys(lang: np.ndarray, h: np.ndarray) -> np.ndarray:
    names, at = np.unique(lang.astype(str), return_inverse=True)
    tongue = np.array([_tongue(x) for x in names], np.uint64)
    return h.view(np.uint64) ^ tongue[at] if len(names) else h.view(np.uint64)


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(a) + b)


def summed(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows of `columns` as one, in lexical order, with the sum of n."""
    if not len(n):
        return columns, n
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))
    return [c[new] for c in columns], np.add.reduceat(n, new)


def merged(parts):
    """Of (name, columns, n): equal rows of a name as one, over as many parts as make PROJECTED rows."""
    held: dict[str, list] = {}

    def made(name):
        *columns, n = (np.concatenate(x) for x in zip(*held.pop(name)))
        return name, *summed(columns, n)

    for name, columns, n in parts:
        held.setdefault(name, []).append([*columns, n])
        if sum(len(x[-1]) for x in held[name]) > PROJECTED:
            yield made(name)
    for name in list(held):
        yield made(name)


def _occurrences(batches, multiplier: int, known: Codes):
    """For every chunk and language: (lang, codes of its words, whether each and the next are of one piece and both frequent)."""
    for langs, lang, data, offsets in chunks(batches):
        lower = _LOWER[data]
        start, end, text, joined = words(lower, offsets)
        h = hashes(lower, start, end, multiplier)
        own = lang[text]
        for k, name in enumerate(langs):
            here = np.flatnonzero(own == k)
            if not len(here):
                continue
            value, at = np.unique(h[here], return_inverse=True)
            code, often = (x[at] for x in known.of(value ^ _tongue(name), value))
            link = joined[here].copy()  # texts of other languages in between end no piece, but a text ends its last
            link[:-1] &= often[:-1] & often[1:]
            link[-1] = False
            yield name, code, link


def counted_pairs(rows: DataFrame, multiplier: int, known) -> DataFrame:
    """(lang, a, b, f): occurrences of pairs of frequent words."""

    def run(batches):
        only("phrases")
        for name, x, link in _occurrences(batches, multiplier, known.value):
            i = np.flatnonzero(link)
            value, code = np.unique(x[np.concatenate([i, i + 1])], return_inverse=True)
            pair, n = np.unique(code[: len(i)] * np.int64(len(value)) + code[len(i) :], return_counts=True)
            a, b = (value[c] for c in (pair // max(1, len(value)), pair % max(1, len(value))))
            for s in range(0, len(n), 1 << 16):
                part = slice(s, s + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n[part])), pa.array(a[part]), pa.array(b[part]), pa.array(n[part])], ["lang", "a", "b", "f"])

    return rows.mapInArrow(run, "lang string, a long, b long, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def projections(rows: DataFrame, multiplier: int, known, pairs, hot) -> DataFrame:
    """(lang, w1, p2, p3, rows): what each task has of each prefix, the occurrences of frequent pairs with the words on their right, 0 beyond the
    last whose pair is frequent; three words or more. `rows` are longs: w2 to w5 and how often. p2 and p3 are 0 unless the prefix is hot; see `packed`."""

    def found(batches):
        for name, x, link in _occurrences(batches, multiplier, known.value):
            i = np.flatnonzero(link)
            ok = np.zeros(len(x), bool)
            ok[i] = pairs.value.has(pair_keys(x[i].view(np.uint64), x[i + 1].view(np.uint64)) ^ _tongue(name))
            i = np.flatnonzero(ok[:-1] & ok[1:])
            if not len(i):
                continue
            window, on = [x[i], x[i + 1], x[i + 2]], np.ones(len(i), bool)
            for d in range(3, LONGEST):
                on = on & ok[np.minimum(i + d - 1, len(x) - 1)]
                window.append(np.where(on, x[np.minimum(i + d, len(x) - 1)], 0))
            yield name, *summed(window, np.ones(len(i), np.int64))

    def run(batches):
        only("phrases")
        for name, window, n in merged(found(batches)):
            yield from packed(name, window, n, *hot.value)

    return rows.mapInArrow(run, "lang string, w1 long, p2 long, p3 long, rows binary")


def packed(name: str, window: list[np.ndarray], n: np.ndarray, ones: set, twos: set):
    """Records of sorted windows: one for each first word, for each two words where the first is of `ones`, for each three where the two are of `twos`."""
    first, begin = np.unique(window[0], return_index=True)
    at = np.zeros(len(n), bool)
    at[begin] = True
    p2, p3 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for w, s, e in zip(first.tolist(), begin.tolist(), [*begin[1:].tolist(), len(n)]):
        if (name, w) in ones:
            part = slice(s, e)
            p2[part] = window[1][part]
            at[s + 1 : e] |= window[1][s + 1 : e] != window[1][s : e - 1]
            second, there = np.unique(window[1][part], return_index=True)
            for v, x, y in zip(second.tolist(), there.tolist(), [*there[1:].tolist(), e - s]):
                if (name, w, v) in twos:
                    p3[s + x : s + y] = window[2][s + x : s + y]
                    at[s + x + 1 : s + y] |= window[2][s + x + 1 : s + y] != window[2][s + x : s + y - 1]
    start = np.flatnonzero(at)
    body = np.stack([*window[1:], n], 1)
    for k in range(0, len(start), 4096):
        own = start[k : k + 4096]
        ends = [*start[k + 1 : k + 4097], len(n)][: len(own)]
        blobs = [body[x:y].tobytes() for x, y in zip(own, ends)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), *[pa.array(c[own]) for c in (window[0], p2, p3)], pa.array(blobs, pa.binary())], ["lang", "w1", "p2", "p3", "rows"])


def grown(projected: list[np.ndarray], n: np.ndarray, low: int, high: int, depth: int, least: int):
    """(words, occurrences) of every pattern of three words or more, with `least` occurrences or more, that extends the prefix of
    `depth` words which the rows low to high of the sorted projection share; depth first."""
    if depth == len(projected):
        return
    column = projected[depth][low:high]
    at = np.append(low + np.flatnonzero(np.append(True, column[1:] != column[:-1])), high)
    f = np.add.reduceat(n[low:high], at[:-1] - low)
    for k in np.flatnonzero(f >= least):
        begin = int(at[k])
        if projected[depth][begin] == 0:  # nothing stands on the right
            continue
        if depth >= 2:
            yield [int(c[begin]) for c in projected[: depth + 1]], int(f[k])
        yield from grown(projected, n, begin, int(at[k + 1]), depth + 1, least)


def by_prefix(batches):
    """(lang, columns, n) of each prefix of sorted records: its projection, sorted. Equal rows become one whenever PROJECTED have come, so a
    prefix takes the memory of its distinct projections."""
    key, held, size = None, [], 0

    def made():
        body = np.concatenate(held)
        return summed([np.full(len(body), key[1], np.int64), *body[:, :-1].T], body[:, -1])

    for batch in batches:
        for *now, blob in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if now != key:
                if held:
                    yield key[0], *made()
                key, held, size = now, [], 0
            held.append(np.frombuffer(blob, np.int64).reshape(-1, LONGEST))
            size += len(held[-1])
            if size > PROJECTED:
                c, n = made()
                held = [np.stack([*c[1:], n], 1)]
                size = len(n) // 2  # so that little is gained is not tried at every record
    if held:
        yield key[0], *made()


def patterns(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, multipliers=MULTIPLIERS, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(patterns(lang, words, f), dictionary(lang, h, word), totals(lang, n)): all contiguous patterns of 1 to 5 words with `least`
    occurrences or more, as arrays of word codes. A null language is `und`, a null text empty."""
    lean(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sc = df.sparkSession.sparkContext
    for multiplier in multipliers:
        ones = cut(counted_words(rows, multiplier).where((F.col("h") == 0) | (F.col("f") >= least)))
        if ones.where("low <> high").isEmpty():
            break
    else:
        raise RuntimeError("words of equal hash with every multiplier")
    codes = Codes(ones.where("h <> 0"), most_words)
    known = sc.broadcast(codes)

    def coded(batches):
        for batch in batches:
            lang, h = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            code, _ = known.value.of(word_keys(lang, h), h.view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), *batch.columns[2:]], ["lang", "h", "f", "low"])

    frequent = cut(ones.where("h <> 0").select("lang", "h", "f", "low").mapInArrow(coded, "lang string, h long, f long, low binary"))
    twos = cut(counted_pairs(rows, multiplier, known).where(F.col("f") >= least))
    pairs = sc.broadcast(Filter.of(twos.select("lang", "a", "b"), lambda lang, a, b: word_keys(lang, pair_keys(a.view(np.uint64), b.view(np.uint64)))))
    every = ones.where("h = 0").agg(F.sum("f")).first()[0] or 0
    most = min(every / HOT_SHARE, HOT)
    ones_hot = {(r.lang, r.h) for r in frequent.where(F.col("f") > most).select("lang", "h").collect()}
    twos_hot = {(r.lang, r.a, r.b) for r in twos.where(F.col("f") > most).select("lang", "a", "b").collect()}
    records = projections(rows, multiplier, known, pairs, sc.broadcast((ones_hot, twos_hot)))
    ordered = records.repartition("lang", "w1", "p2", "p3").sortWithinPartitions("lang", "w1", "p2", "p3")

    def run(batches):
        only("phrases")
        for name, projected, n in by_prefix(batches):
            if found := list(grown(projected, n, 0, len(n), 0, least)):
                pattern, f = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(f)), pa.array(pattern, pa.list_(pa.int64())), pa.array(f, pa.int64())], ["lang", "words", "f"])

    longer = ordered.mapInArrow(run, "lang string, words array<long>, f long")
    all_of = frequent.select("lang", F.array("h").alias("words"), "f").unionByName(twos.select("lang", F.array("a", "b").alias("words"), "f")).unionByName(longer)
    return cut(all_of), frequent.select("lang", "h", F.col("low").cast("string").alias("word")), ones.where("h = 0").select("lang", F.col("f").alias("n"))


def undominated(candidates: DataFrame) -> DataFrame:
    """Without the patterns that stand in a longer one of as many occurrences. Of a longer pattern with as many, all in between have as many, so one word more is enough."""
    k = F.size("words")
    longer = candidates.where(k > 2)
    inner = longer.select("lang", F.explode(F.array(F.slice("words", F.lit(1), k - 1), F.slice("words", F.lit(2), k - 1))).alias("words"), "f")
    return candidates.join(inner, ["lang", "words", "f"], "left_anti")


def scored(candidates: DataFrame, every: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, words, a, l, r, n, score): the cut of lowest score, ties to the shortest first part. Decimal arithmetic of 38 digits, so products are exact."""
    wide = lambda c, p: F.col(c).cast(f"decimal({p},0)")
    k = F.size("words")
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), k - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), F.col("k"))).withColumn("right", F.slice("words", F.col("k") + 1, k - F.col("k")))
    left = every.select("lang", F.col("words").alias("left"), F.col("f").alias("l"))
    right = every.select("lang", F.col("words").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    cuts = cuts.select("lang", "words", "a", "k", "l", "r", "n", ((wide("a", 14) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(18,0)") * wide("n", 19)).alias("top"), (wide("l", 18) * wide("r", 19)).alias("bottom"))
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "words").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("b"))
    return best.select("lang", "words", "b.*")


def phrase(words_: str = "words") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of each language by score descending, a descending, phrase
    ascending (UTF-8 bytes), rank from 1. Ties in everything else are settled by the phrase, so ranks are unique.

    Null languages count as `und` together with that name, null, empty and blank texts have no words, repeated rows count as often
    as they stand there, an empty table gives no rows. Further columns are not used. A very long text is
    read whole by one task, which then needs about 30 bytes for each of its bytes."""
    every, names, totals = patterns(df, lang_col, text_col, least)
    candidates = every.where(F.size("words") > 1)
    kept = scored(undominated(candidates), every, totals)
    spelled = kept.select("*", F.posexplode("words").alias("pos", "h")).join(names, ["lang", "h"])
    text = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.concat_ws(" ", phrase()).alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = text.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark, sf_dir) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_PARTS = " UNION ALL ".join(f"SELECT lang, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS p, {k} AS k FROM places WHERE i + {k - 1} <= len(w)" for k in range(1, LONGEST + 1))
OP12_SQL = f"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \\t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (SELECT lang, p, k, count(*)::HUGEINT AS f FROM ({_PARTS}) GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE f >= {LEAST} AND k > 1),
kept AS (
  SELECT * FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.f >= 100 * c.f AND contains(' ' || q.p || ' ', ' ' || c.p || ' '))),
cuts AS (SELECT lang, p, f AS a, string_split(p, ' ') AS w, unnest(range(1, k)) AS j FROM kept),
s AS (
  SELECT c.lang, c.p, c.a, j, l.f AS l, r.f AS r, n.n, (1000 * c.a * n.n) // (l.f * r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(w[:j], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(w[j + 1:], ' ') JOIN n ON n.lang = c.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= {TOP}
"""
