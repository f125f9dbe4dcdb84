"""The operators on small tables: brute force, round trips, held-out accuracy, and odd inputs."""

import collections
import hashlib
import math
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece as library
import xxhash
from pyspark.sql import functions as F

from molframe.llm import eliasfano, fingerprints, langid, lm, media, mixing, queries, rollups, sentencepiece, simhash, toxicity, urlfilter, webp
from molframe.llm.common import fold
from tests.conftest import DATA
from tests.oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \t\n", "a", "Ünïcode – 日本語 \U0001f600", "x" * 70_000, "the same text here", "the same text here", "w " * 5000, "no_space" * 400, "\x00\x01 ctl"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, long texts, ties and repeated rows, with further columns whose names clash."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src", i, "x", i) for i, t in enumerate(ODD)]
    rows += [rows[6], (None, "an id is missing", "en", "src", 1, "y", 9)]
    return spark.createDataFrame(rows, DOCS + ", fp string, score long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, DATA, queries.queries()[name], queries.oracle_sql()[name])


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 14))


def test_fold_is_crc32(spark):
    got = spark.createDataFrame([(0,), (17,), (-3,), (None,)], "i long").select("i", fold("i").alias("f")).collect()
    assert [r.f for r in got] == [zlib.crc32(b"" if r.i is None else str(r.i).encode()) % 5 for r in got]


# -- 1 ---------------------------------------------------------------------------------------------


def unigram(data: bytes) -> bytes:
    at = data.rfind(b"\x12\x06tok_v0\x18\x02")
    return data[:at] + data[at:].replace(b"\x18\x02", b"\x18\x01", 1)


def joined(m, text, chunk):
    """A text by chunks, as the tasks do it."""
    t = m.normal(text)
    parts = [(t[max(0, p - m.longest) : p + chunk + m.longest], p - max(0, p - m.longest), min(len(t), p + chunk) - max(0, p - m.longest)) for p in range(0, len(t), chunk)]
    if not parts:
        return []
    steps, states = [m.matrix(*x) for x in parts], [m.states(x[0], x[2]) for x in parts]
    steps[-1][:, [e != 0 for _, e in states[-1]]] = sentencepiece.NEVER
    at = sentencepiece.choose(steps)
    came = [(0, 0), *[states[i][at[i]] for i in range(len(at) - 1)]]
    return [int(x) for i in range(len(parts)) for x in m.trace(*parts[i], came[i], states[i][at[i]])]


def hard_texts():
    r = random.Random(5)
    mixed = "".join(chr(r.choice([r.randrange(97, 123), r.randrange(0x3040, 0x30FF), 0x1F600])) for _ in range(900))
    return ["", " ", "  a", "Hello  world\n\tfoo ▁x é日本 \x00a", "日本語テキスト" * 30, "thisisaverylongword" * 30, mixed, " " * 90 + "a" + " " * 33]


def test_bpe_equals_the_library_whole_and_by_chunks(texts):
    data = open(sentencepiece.MODEL, "rb").read()
    m, lib = sentencepiece.PieceModel(data), library.SentencePieceProcessor(model_proto=data)
    for t in hard_texts() + [x[1] for x in texts[:60]]:
        ids = m.encode(t).tolist()
        assert ids == lib.encode(t)
        assert m.decode(ids) == lib.decode(ids)
    for t in hard_texts() + [x[1][:2000] for x in texts[:8]]:
        for chunk in (5, 33, 257):
            assert joined(m, t, chunk) == lib.encode(t)


def test_unigram_scores_equal_the_library():
    data = unigram(open(sentencepiece.MODEL, "rb").read())
    m, lib = sentencepiece.PieceModel(data), library.SentencePieceProcessor(model_proto=data)
    score = lambda ids: sum(m.low if lib.is_byte(i) else lib.get_score(i) for i in ids)
    for t in hard_texts():
        want = score(lib.encode(t))
        for ids in (m.encode(t).tolist(), joined(m, t, 40)):
            assert score(ids) == pytest.approx(want, rel=1e-5)


def test_combination_is_associative():
    r = np.random.default_rng(0)
    steps = [r.integers(-9, 0, (3, 3)).astype(float) for _ in range(6)]
    steps[0] = steps[0][:1]
    best = max((sum(s[a, b] for s, a, b in zip(steps, (0, *p), p)), p) for p in np.ndindex(*[3] * 6))
    at = sentencepiece.choose(steps)
    assert sum(s[a, b] for s, a, b in zip(steps, (0, *at), at)) == best[0]


def test_encoding_of_odd_rows(odd, empty):
    lib = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    got = sentencepiece.encode(odd, giant=2000, chunk=300, decoded=True).collect()
    want = sorted((str(r.doc_id), lib.encode(r.text or ""), r.text or "") for r in odd.collect())
    assert sorted((str(r.doc_id), r.token_ids, r.decoded) for r in got) == want
    again = sentencepiece.decode(sentencepiece.encode(odd).withColumn("decoded", F.lit(1))).collect()
    assert sorted((str(r.doc_id), r.token_ids, r.decoded) for r in again) == want
    assert sentencepiece.encode(empty).count() == 0


# -- 2 ---------------------------------------------------------------------------------------------


def image(w, h, k):
    r = np.random.default_rng(w * 31 + h * 7 + k)
    if k == 0:
        return r.integers(0, 1 << 32, w * h, dtype=np.uint64).astype(np.uint32)
    if k == 1:
        return (np.arange(w * h) // 7 % 13 * 0x01020304).astype(np.uint32)
    if k == 2:
        return r.choice(np.array([0xFF000000, 0xFF102030], np.uint32), w * h)
    return webp.joined(np.cumsum(r.integers(-3, 4, (4, w * h)), 1) + 128)


@pytest.mark.parametrize("w, h", [(1, 1), (1, 9), (7, 1), (33, 17), (64, 40)])
def test_images_round_trip(w, h):
    for k in range(4):
        p = image(w, h, k)
        for n, tr in enumerate([(), (0,), (1,), (2,), (0, 2), (2, 0, 1), (3,), (3, 0)]):
            if webp.PALETTE in tr and len(np.unique(p)) > 256:
                continue
            for cache, block in ((0, 0), (5, 0), (11, 2)):
                f = webp.encode(p, w, h, tr, cache, block, mode_block=2 + n % 3, seed=n)
                a, b, q = webp.decode(f)
                assert (a, b) == (w, h) and (q == p).all()
                assert all((x[2] == p).all() for x in webp.decode_many([f] * 3, few=1))


def test_known_stream():
    """A 2 x 1 image written bit by bit from the format's description: one colour by five one-symbol codes."""
    w = webp.Writer()
    for v, n in ((0x2F, 8), (1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        w.put(v, n)
    for symbol in (0x34, 0x12, 0x56, 0xFF, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            w.put(v, n)
    assert webp.decode(webp.wrap(w.value.to_bytes((w.size + 7) // 8, "little")))[2].tolist() == [0xFF123456] * 2


@pytest.mark.parametrize("chain", [None, *range(len(webp.CHAINS))])
def test_batches_of_a_chain_round_trip(chain):
    """Of several sizes, read together and one by one by the general decoder."""
    sizes = [(144, 1), (144, 5), (7, 9), (1, 3), (144, 2), (288, 3), (5, 1)]
    px = [image(w, h, k % 4) for k, (w, h) in enumerate(sizes)]
    n = np.array([len(p) for p in px])
    w, h = np.array(sizes).T
    files = webp.encode_many(np.concatenate(px), np.cumsum(n) - n, w, h, chain)
    for f, p, size in zip(files, px, sizes):
        a, b, q = webp.decode(f)
        assert (a, b) == size and (q == p).all()
    for few in (1, 40):
        assert all((x[0], x[1]) == size and (x[2] == p).all() for x, p, size in zip(webp.decode_many(files, few), px, sizes))


def transforms(file):
    """Kinds of transforms of a file, in order of application."""
    seen, bits = [], webp.Bits(webp.unwrap(file), 8)
    bits.read(32)
    w = 1 + (int.from_bytes(webp.unwrap(file)[1:5], "little") & 0x3FFF)
    h = 1 + (int.from_bytes(webp.unwrap(file)[1:5], "little") >> 14 & 0x3FFF)
    while bits.read(1):
        seen.append(kind := bits.read(2))
        if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
            block = bits.read(3) + 2
            webp.read_image(bits, (w + (1 << block) - 1) >> block, (h + (1 << block) - 1) >> block)
        elif kind == webp.PALETTE:
            n = bits.read(8) + 1
            webp.read_image(bits, n, 1)
            w = (w + (1 << webp._bundle(n)) - 1) >> webp._bundle(n)
    return tuple(seen)


def pictures():
    """Payloads of one unit's width each, by the transforms that suit them."""
    r = np.random.default_rng(5)
    h, w = 60, 144
    y, x = np.mgrid[:h, :w]
    slope = np.stack([np.full((h, w), 255), x + y, 2 * x + y // 2, y * 2 + x // 3]) + r.integers(-1, 2, (4, h, w))  # smooth, channels apart
    noise = r.integers(0, 256, (h, w))
    grey = np.stack([np.full((h, w), 255), noise + r.integers(-2, 3, (h, w)), noise, noise + r.integers(-2, 3, (h, w))])  # rough, channels together
    green = r.integers(0, 128, (h, w))
    tinted = np.stack([np.full((h, w), 255), green // 2 + r.integers(0, 2, (h, w)), green, 100 - green // 4 + r.integers(0, 2, (h, w))])  # rough, in proportion
    few = np.stack([np.full((h, w), 255), *(np.array([[10, 200, 90, 31], [0, 50, 250, 77], [3, 4, 5, 6]])[:, r.integers(0, 4, (h, w))])])
    return {k: (v & 255).astype(np.uint8).transpose(1, 2, 0).tobytes() for k, v in (("slope", slope), ("grey", grey), ("tinted", tinted), ("few", few))}


def test_transforms_are_chosen_by_size(texts):
    made = pictures()
    prose = [media.padded((t or "").encode()) for _, t, *_ in texts]
    payloads = [*made.values(), media.padded(b""), *prose]
    files = media.store(payloads)
    assert all(media.samples(p)[: len(x)] == x for x, (_, _, p) in zip(payloads, webp.decode_many(files)))
    kinds = dict(zip([*made, "blank"], map(transforms, files)))
    assert kinds["slope"][0] == webp.PREDICTOR and kinds["grey"] == (webp.SUBTRACT_GREEN,) and webp.CROSS_COLOUR in kinds["tinted"] and kinds["few"] == (webp.PALETTE,) and kinds["blank"] == ()
    for (k, x), f in zip(made.items(), files):
        p = np.frombuffer(x, ">u4").astype(np.uint32)
        assert len(f) < 0.9 * len(webp.encode(p, 144, 60, (), 4)) and len(f) < len(x), k
    # modes by block are not one mode throughout
    p = np.frombuffer(made["slope"], ">u4").astype(np.uint32)
    assert len(np.unique(webp.chosen_modes(p, 144, 60, 4))) > 1
    assert sum(map(len, files[len(made) :])) <= 0.65 * sum(map(len, payloads[len(made) :]))


def test_media_columns_are_what_is_stored(spark, docs):
    for r in media.describe(docs.where("doc_id < 30")).join(docs.select("doc_id", "text"), "doc_id").collect():
        payload = media.padded((r.text or "").encode())
        (file,) = media.store([payload])
        x = list(payload)
        mean = sum(x) / len(x)
        spread = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
        bins = ",".join(str(int(round(1000 * sum(16 * k <= v < 16 * k + 16 for v in x) / len(x)))) for k in range(16))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        mean_, spread_, bins_ = r.feature.split("|")
        assert abs(float(mean_) - mean) < 6e-4 and abs(float(spread_) - spread) < 6e-4 and bins_ == bins


def by_pixel(res, width, height, modes, block):
    """The inverse predictor pixel by pixel, channel by channel, as the format's description has it; pixels are (a, r, g, b)."""
    out = [[(0, 0, 0, 0)] * width for _ in range(height)]
    add = lambda p, q: tuple((a + b) & 255 for a, b in zip(p, q))
    mean = lambda p, q: tuple((a + b) // 2 for a, b in zip(p, q))
    clip = lambda v: min(255, max(0, v))
    for y in range(height):
        for x in range(width):
            if x == 0 and y == 0:
                guess = (255, 0, 0, 0)
            elif y == 0:
                guess = out[0][x - 1]
            elif x == 0:
                guess = out[y - 1][0]
            else:
                l, t, tl = out[y][x - 1], out[y - 1][x], out[y - 1][x - 1]
                tr = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                m = modes[(y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)]
                if m == 11:
                    whole = [a + b - c for a, b, c in zip(l, t, tl)]
                    guess = l if sum(abs(a - b) for a, b in zip(whole, l)) < sum(abs(a - b) for a, b in zip(whole, t)) else t
                else:
                    guess = [
                        lambda: (255, 0, 0, 0), lambda: l, lambda: t, lambda: tr, lambda: tl, lambda: mean(mean(l, tr), t), lambda: mean(l, tl), lambda: mean(l, t), lambda: mean(tl, t),
                        lambda: mean(t, tr), lambda: mean(mean(l, tl), mean(t, tr)), None, lambda: tuple(clip(a + b - c) for a, b, c in zip(l, t, tl)),
                        lambda: tuple(clip(a + int((a - c) / 2)) for a, c in zip(mean(l, t), tl)),
                    ][m]()
            out[y][x] = add(res[y][x], guess)
    return [p for row in out for p in row]


@pytest.mark.parametrize("mode", [*range(14), None])
def test_predictors_equal_a_plain_loop(mode):
    """Every mode alone, and all of them in blocks of four pixels."""
    r = np.random.default_rng(3)
    w, h, block = 13, 9, 2
    res = r.integers(0, 256, (h, w, 4)) * (r.random((h, w, 1)) < 0.7)
    modes = [mode if mode is not None else k % 14 for k in range(12)]
    packed = webp.joined(np.moveaxis(res, 2, 0).reshape(4, -1).astype(np.int64))
    data = (np.array(modes, np.uint32) << 8) | np.uint32(webp.OPAQUE)
    got = webp.channels(webp.unpredict(packed, w, h, data, block)).T
    assert [tuple(p) for p in got.tolist()] == by_pixel([[tuple(int(v) for v in p) for p in row] for row in res], w, h, modes, block)


def test_colour_transforms_equal_a_plain_loop():
    r = np.random.default_rng(4)
    w, h, block = 10, 7, 2
    px, side = r.integers(0, 256, (h * w, 4)), (w + 3) >> 2
    multipliers = r.integers(0, 256, (2 * side, 3))  # red to blue, green to blue, green to red
    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: (signed(int(t)) * signed(int(c))) >> 5
    want, plus = [], []
    for i, (a, red, green, blue) in enumerate(px.tolist()):
        rb, gb, gr = multipliers[(i // w >> block) * side + (i % w >> block)]
        new = (red + delta(gr, green)) & 255
        want.append((a, new, green, (blue + delta(gb, green) + delta(rb, new)) & 255))
        plus.append((a, (red + green) & 255, green, (blue + green) & 255))
    packed = webp.joined(px.T)
    data = webp.joined(np.concatenate([np.full((len(multipliers), 1), 255), multipliers], 1).T)
    assert [tuple(p) for p in webp.channels(webp.recolour(packed, w, h, data, block, True)).T.tolist()] == want
    assert [tuple(p) for p in webp.channels(webp.add_green(packed, 1)).T.tolist()] == plus


@pytest.mark.parametrize("colours, bits", [(2, 1), (3, 2), (4, 2), (5, 4), (16, 4), (17, 8), (200, 8)])
def test_palettes_equal_a_plain_loop(colours, bits):
    """Indices of 1, 2, 4 and 8 bits in the green channel, the first one lowest."""
    r = np.random.default_rng(colours)
    w, h, table = 11, 4, r.integers(0, 1 << 32, colours, dtype=np.uint32)
    index = r.integers(0, colours, (h, w))
    per, packed = 8 // bits, []
    for row in index:
        for x in range(0, w, per):
            packed.append(sum(int(v) << (bits * k) for k, v in enumerate(row[x : x + per])) << 8 | 0xFF000000)
    assert (webp.unindex(np.array(packed, np.uint32), w, h, table) == table[index.ravel()]).all()


def test_broken_streams_are_refused():
    f = webp.encode(image(33, 17, 0), 33, 17, cache_bits=4)
    for bad in (f[:60], b"RIFF" + f[4:8] + b"WEBX" + f[12:], f[:21] + b"\xff" * 40):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_media_of_odd_rows(odd, empty, spark):
    rows = media.describe(odd).collect()
    assert len(rows) == odd.count()
    want = {str(r.doc_id): media.padded((r.text or "").encode()) for r in odd.collect()}
    for r in rows:
        p = want[str(r.doc_id)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert len(p) % 576 == 0 and len(p) > 0
    one, two = (r for r in rows if r.doc_id == 7), (r for r in rows if r.doc_id == 6)
    assert next(one)[1:] == next(two)[1:]
    files = media.encode(odd.select("doc_id", F.col("text").cast("binary").alias("b"), "fp"), "b")
    back = {str(r.doc_id): r for r in media.decode(files).collect()}
    assert back["1"].pixels is None and all(back[k].pixels[: len(p)] == p for k, p in want.items() if k != "1")
    assert media.describe(empty).count() == 0


# -- 3 ---------------------------------------------------------------------------------------------


def test_elias_fano():
    r = np.random.default_rng(2)
    for universe, n in ((10, 0), (1000, 1), (1 << 40, 5000), (5000, 3000), (1 << 20, 1000)):
        v = np.unique(r.integers(0, universe, n, dtype=np.uint64))
        e = eliasfano.EliasFano.build(v, universe)
        e = eliasfano.EliasFano.of(eliasfano.load(np.frombuffer(eliasfano.dump({f"k.{a}": b for a, b in e.arrays().items()}), np.uint8)), "k")
        asked = np.concatenate([v, r.integers(0, universe, 500, dtype=np.uint64)])
        at = {int(x): i for i, x in enumerate(v)}
        assert e.find(asked).tolist() == [at.get(int(x), -1) for x in asked]
        assert (e.access(np.arange(len(v))) == v).all()
    pointers = np.array([0, 0, 3, 3, 3, 9], np.uint64)
    assert eliasfano.EliasFano.build(pointers, 10).access(np.arange(6)).tolist() == pointers.tolist()


def test_elias_fano_within_a_range():
    e = eliasfano.EliasFano.build(np.array([3, 4, 4, 9, 9, 9, 70]), 71)
    x, lo, hi = np.array([[4, 0, 2], [4, 2, 3], [4, 3, 7], [9, 4, 6], [70, 0, 6], [70, 0, 7], [1 << 40, 0, 7], [3, 1, 1]]).T
    assert e.find(x.astype(np.uint64), lo, hi).tolist() == [1, 2, -1, 4, -1, 6, -1, -1]


def model(rows, order=3):
    """Interpolated absolute discounting in plain dictionaries."""
    tokens = [t.encode().lower().split() + [b"\n"] for t in rows]
    c, grams, heads, mass = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    for w in tokens:
        c.update(w)
        w = [b"\r", *w]
        for n in range(2, order + 1):
            grams.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for g, n in grams.items():
        heads[g[:-1]] += n
    for g, n in grams.items():
        mass[g[:-1]] += (n - lm.DISCOUNT) / heads[g[:-1]]
    total, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)

    def score(text):
        w = [b"\r", *text.encode().lower().split(), b"\n"]
        base = s = 0.0
        for i in range(1, len(w)):
            p = (c[w[i]] + 0.5) / z
            base += math.log10(p)
            for n in range(2, min(order, i + 1) + 1):
                g = tuple(w[i + 1 - n : i + 1])
                if heads[g[:-1]]:
                    p = (grams[g] - lm.DISCOUNT) / heads[g[:-1]] * (g in grams) + p * (1 - mass[g[:-1]])
            s += math.log10(p)
        return len(w) - 1, sum(c[x] > 0 for x in w[1:]), total, base, s

    return score


@pytest.mark.parametrize("order, shard_words, shard_tokens", [(3, 1_000_000, 10_000_000), (3, 700, 900), (2, 1_000_000, 500)])
def test_scores_equal_a_plain_model(spark, docs, texts, order, shard_words, shard_tokens):
    """With small shards many words and pairs of them are hot contexts, split over shards of their own."""
    plain = model([t for i, t, *_ in texts if zlib.crc32(str(i).encode()) % 5 != 1], order)
    trie = lm.fit(docs.where(fold("doc_id") != 1), order=order, shard_words=shard_words, shard_tokens=shard_tokens)
    assert shard_tokens > 1000 or len(trie.two.of.ids) > 2
    got = {r.doc_id: r for r in lm.score(docs, trie).collect()}
    for i, t, *_ in texts:
        n, known, total, base, s = plain(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(s, abs=2e-4 * n)


def test_the_query_keeps_all(spark, texts):
    plain = model([t for i, t, *_ in texts if zlib.crc32(str(i).encode()) % 5 != 1])
    got = {r.doc_id: r.score for r in lm.op3(spark, DATA).collect()}
    for i, t, *_ in texts:
        n, *_, s = plain(t)
        assert got[i] == pytest.approx(s, abs=2e-4 * n)


def test_hot_pairs_are_split(spark):
    """One pair of words that outweighs a shard, its successors in several shards."""
    r = random.Random(9)
    rows = [(i, " ".join(["of the " + r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trie = lm.fit(df, shard_words=10, shard_tokens=300)
    assert len(trie.three.of.ids) and (trie.three.of.parts > 1).all()
    plain = model([t for _, t in rows])
    for x in lm.score(df, trie).collect():
        assert x.score == pytest.approx(plain(rows[x.doc_id][1])[-1], abs=2e-4 * x.n_tokens)


def test_packed_keys():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.sort(r.integers(0, 1 << 62, n))
        assert (lm.unpacked(lm.packed(x)) == x).all()


def test_scores_of_odd_rows(odd, empty):
    m = lm.fit(odd)
    rows = lm.score(odd, m).collect()
    assert len(rows) == odd.count() and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    nothing = lm.score(odd, lm.fit(empty)).where("doc_id = 3").first()
    assert (nothing.n_known, nothing.train_tokens, nothing.base_score) == (0, 0, 0.0)
    assert lm.score(empty, m).count() == 0


# -- 4 ---------------------------------------------------------------------------------------------


def test_rollup_is_idempotent_and_additive(spark, odd, tmp_path):
    a = rollups.counts(odd, list(rollups.VERSIONS))
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    assert r.apply("b1", rollups.signed(a, 1)) and not r.apply("b1", rollups.signed(a, 1))
    want = {tuple(x) for x in rollups.reduced(rollups.signed(a, 1)).collect()}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert r.batches() == [] and r.committed("b1") and not r.apply("b1", rollups.signed(a, 1))
    one = rollups.counts(odd.where("doc_id = 8"), list(rollups.VERSIONS))
    r.apply("b2", rollups.revised(one, one.withColumn("tokens", F.col("tokens") + 5)))
    t = {(x.source, x.lang, x.tokenizer): x.tokens for x in r.totals().collect()}
    assert t["src", "en", "words-1"] == next(x[4] for x in want if x[:3] == ("src", "en", "words-1")) + 5
    r.compact()
    r.apply("b3", rollups.signed(a, -1))
    r.apply("b4", rollups.revised(one.withColumn("tokens", F.col("tokens") + 5), one).withColumn("docs", F.lit(0).cast("long")))
    assert r.totals().count() == 0
    # a driver lost between writing and renaming leaves nothing that counts
    rollups.reduced(rollups.signed(a, 1)).write.parquet(f"file://{tmp_path}/r/staged/b5")
    assert not r.committed("b5") and r.totals().count() == 0
    with pytest.raises(ValueError):
        r.apply("_x", rollups.signed(a, 1))


def test_two_drivers_never_take_a_commit_back(spark, odd, tmp_path, monkeypatch):
    """A second driver goes on at every step of the first one's commit or compaction; totals never change."""
    a = rollups.signed(rollups.counts(odd, ["words-1"]), 1)
    want = {tuple(x) for x in rollups.reduced(a).collect()}
    folder = f"file://{tmp_path}/r"
    one, two = rollups.Rollup(spark, folder), rollups.Rollup(spark, folder)
    rename = rollups.Rollup._commit
    seen = []

    def late(self, staged, place):
        """Just before this driver's rename the other one commits and compacts."""
        if self is one and not seen:
            seen.append(two.apply("b1", a))
            assert {tuple(x) for x in two.totals().collect()} == want
        return rename(self, staged, place)

    monkeypatch.setattr(rollups.Rollup, "_commit", late)
    assert one.apply("b1", a) is False and seen == [True]
    for r in (one, two):
        assert r.committed("b1") and {tuple(x) for x in r.totals().collect()} == want
    seen.clear()

    def compacting(self, staged, place):
        if self is one and not seen:
            seen.append(1)
            two.compact()
        return rename(self, staged, place)

    monkeypatch.setattr(rollups.Rollup, "_commit", compacting)
    one.compact()
    for r in (one, two):
        assert r.committed("b1") and r.batches() == [] and {tuple(x) for x in r.totals().collect()} == want
    # a batch that comes after it was folded into the base: its place is absent, the base has it
    monkeypatch.setattr(rollups.Rollup, "committed", lambda self, batch: False)
    two.apply("b1", a)
    assert {tuple(x) for x in two.totals().collect()} == want
    # a rename that fails for another reason leaves what is there
    monkeypatch.setattr(rollups.Rollup, "_commit", rename)
    with pytest.raises(Exception):
        one._commit(f"{folder}/staged/none", f"{folder}/batches/b9")
    assert {tuple(x) for x in one.totals().collect()} == want


def test_versions_of_a_real_tokenizer(spark, docs, texts, tmp_path):
    """Pieces of the SentencePiece encoder as a version: a plain loop over the library, and a source moved to it as a delta."""
    lib = library.SentencePieceProcessor(model_proto=open(sentencepiece.MODEL, "rb").read())
    few = docs.where("doc_id < 40")
    got = {r.doc_id: (r.tokens, r.bytes) for r in rollups.counts(few, ["pieces-1"]).collect()}
    assert got == {i: (len(lib.encode(t)), len(t.encode())) for i, t, *_ in texts if i < 40}
    r = rollups.Rollup(spark, f"file://{tmp_path}/r")
    r.apply("1", rollups.signed(rollups.counts(few, ["words-2"]), 1))
    moved = few.where("source = 'src0'")
    r.apply("2", rollups.revised(rollups.counts(moved, ["words-2"]), rollups.counts(moved, ["pieces-1"])))
    want = collections.Counter()
    for i, t, lang, source in texts:
        if i < 40:
            words = len(t.encode().split()) + sum(t.count(c) for c in ".,;:!?")
            want[source, lang, "pieces-1" if source == "src0" else "words-2"] += got[i][0] if source == "src0" else words
    assert {(x.source, x.lang, x.tokenizer): x.tokens for x in r.totals().collect()} == dict(want) and len({k[2] for k in want}) == 2


def test_rollup_query_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert rollups.op4(spark, str(tmp_path)).collect() == []


def test_last_words_are_cut_in_time_of_their_length(spark):
    rows = ["", "  ", "a", "a b", "a b \n", " \tx", "x" * 3_000_000, "y " * 600_000, "z" * 1_000_000 + " end", "é ü\u0085"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    start = time.time()
    got = {r.i: r.o for r in df.select("i", rollups.without_last_word(F.col("t")).alias("o")).collect()}
    assert [got[i] for i in range(len(rows))] == ["", "  ", "", "a ", "a ", " \t", "", "y " * 599_999, "z" * 1_000_000 + " ", "é "]
    assert time.time() - start < 30


def test_hosts_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 200_000 + "net/es/x"), (2, "http://" + "." * 50_000), (3, "http://com/"), (4, "http://xcom/")], "page_id long, url string")
    start = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, urlfilter.rules(spark)).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "allow"), 3: ("com/", "allow"), 4: (None, "allow")}
    assert time.time() - start < 30


# -- 5 ---------------------------------------------------------------------------------------------

URLS = [None, "", "com/", "http://com", "http://COM/", "http://a.example.com/en/x?q#f", "http://www.example.com/en/", "http://www.example.com/EN/", "http://xexample.com/en/", "https://net/fr/?a", "ftp://sub.net/es/#x", "http://u://com/", "http://a.net/e", "http://example.com:80/en/", "x://com/\n/y"]


def by_rule(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].lower(), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("most_rules", [0, 100])
def test_colliding_prefixes_are_refused(spark, most_rules):
    """With prefixes of 4 bits nearly every pair meets a rule; the digests refuse all but the right ones, and no digest is a join key."""
    r = random.Random(4)
    host = lambda: ".".join(r.choice(["a", "b", "www", "example", "x" * 30]) for _ in range(r.randrange(1, 5))) + r.choice([".com", ".net", ".org"])
    rows = [(i if i % 50 else None, f"http://{host()}/{r.choice(['en', 'es', 'fr', ''])}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string")
    rules = urlfilter.rules(spark, [*urlfilter.RULES, ("b.org", "/", "block"), ("a.net", "/e", "block")])
    plain = urlfilter.judge(pages, rules)
    short = urlfilter.judge(pages, rules, most_rules=most_rules, prefix_bits=4)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(short) == order(plain) and plain.where("rule IS NOT NULL").count() > 50
    plan = short._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x and "rk" in x]
    assert joins and not any("rd#" in x.split("], [")[0] + x.split("], [")[1].split("]")[0] for x in joins)


@pytest.mark.parametrize("most_rules", [100, 0])
def test_urls_equal_a_plain_loop(spark, most_rules):
    rows = [(i, u, "old", i) for i, u in enumerate(URLS)] + [(3, URLS[3], "old", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, h long")
    rules = [*urlfilter.RULES, ("org", "/a", "block")]
    got = urlfilter.judge(pages, urlfilter.rules(spark, rules), most_rules=most_rules).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in got) == sorted((r[0], *[x or "" for x in by_rule(r[1], rules)]) for r in rows)
    assert urlfilter.judge(pages.limit(0), urlfilter.rules(spark)).count() == 0
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in urlfilter.judge(pages, none, default="block").collect()} == {"block"}


# -- 6 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    """Component of each fingerprint by comparing all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    return {f: root(f) for f in u}


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: plain_fingerprint(t) for i, t, *_ in texts}
    assert all(got[i].fp & (2**64 - 1) == fp[i] for i in fp)
    root, least = groups(fp.values()), {}
    for i in sorted(fp):
        least.setdefault(root[fp[i]], i)
    assert all(got[i].component_id == least[root[fp[i]]] for i in fp)


@pytest.mark.parametrize("cell", [4096, 8])
def test_links_find_every_near_pair(spark, cell):
    """Planted neighbours at 1 to 4 bits in both halves, and a crowd around one fingerprint."""
    r = random.Random(3)
    fps = set()
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for n in (1, 2, 3, 4):
            y = x
            for b in r.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    crowd = r.getrandbits(64)
    fps |= {crowd ^ (1 << a) ^ (1 << b) for a in range(0, 40, 2) for b in range(1, 30, 3)}
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, m long")
    links = simhash.links(df, cell=cell)
    n = links.count()
    assert n <= 60 * len(fps)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(links).collect()}
    root = groups(fps)
    want, mine = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        want[root[f]].add(f)
        mine[got.get(f, f)].add(f)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, mine.values()))


def shingle_set(text, width=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard_components(rows, least=0.8):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where, share = {}, collections.Counter()
    for i, s in sets.items():
        for x in s or {None}:
            for j in where.setdefault(x, []):
                share[j, i] += 1
            where[x].append(i)
    for (j, i), n in share.items():
        if n >= least * max(1, len(sets[i] | sets[j])):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("cell", [simhash.CELL, 32])
def test_similar_finds_near_copies_and_nothing_else(spark, cell):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    rows = []
    for size in [1, 3, 5, 6, 40, 90, 200, 700]:
        text = [word() for _ in range(size)]
        for edits in [0, 0, 0.004, 0.01, 0.02, 0.05, 0.2]:
            rows.append((len(rows), " ".join(word() if r.random() < edits else w for w in text)))
    crowd = [word() for _ in range(300)]
    for i in range(150):
        rows.append((len(rows), " ".join([*crowd[: i % 290], word(), *crowd[i % 290 + 1 :]])))
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", " \n", "A b C", "a  B c"])]
    want = jaccard_components(rows)
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()}
    assert set(got) == set(want)
    assert all(want[i] == want[c] for i, c in got.items())  # no link of its own
    crowded = {got[i] for i, t in rows[56:206]}
    assert len(crowded) == 1 and sum(got[i] != want[i] for i in want) <= 2


@pytest.mark.parametrize("cell", [simhash.CELL, 16])
def test_similar_links_copies_within_a_template(spark, cell):
    """Texts of one template are near each other and not linked, but each has a copy among them."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    edited = lambda words, share: [word() if r.random() < share else w for w in words]
    template = [word() for _ in range(300)]
    texts = []
    for _ in range(120):
        texts.append(edited(template, 0.035))
        texts.append(edited(texts[-1], 0.012))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = jaccard_components(rows)
    got = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()}
    assert len(set(want.values())) > 10
    assert all(want[i] == want[c] for i, c in got.items())
    assert sum(got[i] != want[i] for i in want) == 0


def test_spanning_joins_what_is_near_or_alike_and_no_more():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, (6, 2), np.int64)
    f = base[r.integers(0, 6, 90)].copy()
    for i in range(90):
        for bit in r.integers(0, 60, r.integers(0, 9)):
            f[i, bit % 2] ^= 1 << int(bit)
    f = f.view(np.uint64)
    sets = [np.unique(r.integers(0, 12, 8)).astype(np.uint64) for _ in range(90)]
    bits = np.bitwise_count(f[:, None] ^ f).sum(2)
    jac = np.array([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for y in sets] for x in sets])

    def components(ok, start=None):
        label = np.arange(90) if start is None else start.copy()
        for _ in range(90):
            new = np.array([label[ok[i]].min(initial=label[i]) for i in range(90)])
            for c in np.unique(label):  # those of one label stay together
                new[label == c] = new[label == c].min()
            if (new == label).all():
                return label
            label = new

    same = lambda x, y: len(set(zip(x.tolist(), y.tolist()))) == len(set(x.tolist())) == len(set(y.tolist()))
    roots, light = r.integers(0, 25, 90), r.random(90) < 0.3
    for near, s, least, root, lit in [(9, None, 0.0, None, None), (60, sets, 0.6, None, None), (9, sets, 0.5, roots, None), (60, sets, 0.6, roots, light)]:
        ok = bits <= near
        if s is not None:
            ok &= jac >= least
        if lit is not None:
            ok &= lit[:, None] | lit
        a, b = simhash.spanning(f, near, s, least, root, lit)
        linked = np.zeros((90, 90), bool)
        linked[a, b] = linked[b, a] = True
        assert len(a) < 90 and not (linked & ~ok).any()
        assert same(components(linked, root), components(ok, root))


def test_groups_join_all_that_share_an_anchor(spark):
    """One crowded anchor: chains of steps within the distance, in cells far smaller than the anchor."""
    r = random.Random(7)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(62), n))
    rows = []
    for i in range(120):
        if i % 15 == 0:
            top, f1 = r.getrandbits(31) << 32, r.getrandbits(62)
        f1 = flip(f1, 20)
        rows.append((i, top | 0x1234567, f1, r.getrandbits(62), r.getrandbits(62)))
    bits = [[bin(x[2] ^ y[2]).count("1") + bin(x[1] ^ y[1]).count("1") for y in rows] for x in rows]
    want = list(range(120))
    for _ in range(120):
        want = [min(want[j] for j in range(120) if bits[i][j] <= simhash.NEAR[0]) for i in range(120)]
    nodes = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    for cell in (simhash.CELL, 16):
        got = {x.node: x.root for x in simhash.candidate_groups(nodes, cell).collect()}
        assert [got.get(i, i) for i in range(120)] == want
    assert 5 < len(set(want)) < 60


def test_texts_of_one_hash_stay_apart(spark):
    """Two texts with one 64-bit hash are two nodes: identity takes two hashes."""
    rows = [(i, h1, h2, 1) for i, (h1, h2) in enumerate([(7, 1), (7, 2), (7, 1), (8, 1)])]
    fps = spark.createDataFrame([r[:3] for r in rows], "id long, h1 long, h2 long")
    counted = spark.createDataFrame([(7, 1, 0, 0, 2), (7, 2, 1, 1, 1), (8, 1, 2, 3, 1)], "h1 long, h2 long, node long, m long, n long")
    comp = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    got = {x.id: x.component_id for x in simhash._labelled(fps, counted, comp, ["h1", "h2"]).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1}


def test_similar_of_odd_rows(odd, empty):
    rows = simhash.similar(odd).collect()
    assert len(rows) == odd.count()
    assert simhash.similar(empty).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[0] == got[1] == got[2] == 0 and got[7] == 6 and got[None] is None
    assert simhash.near_duplicates(empty).count() == 0


# -- 7 ---------------------------------------------------------------------------------------------


def test_mixing_reaches_its_weights(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 500 == 1, "rare").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(docs, {"rare": 0.5}, target_rows=40_000)
    got = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    share = 40_000 / (len(got) - 0.5)
    for s, n in got.items():
        want = share * (0.5 if s == "rare" else 1)
        rate = want / {r.source: r["count"] for r in docs.groupBy("source").count().collect()}[s]
        assert abs(n - want) < 6 * math.sqrt(want * max(1, rate))
    assert out.select("doc_id", "copy").distinct().count() == out.count()
    first = out.select("doc_id", "copy", "shuffle_key").orderBy("shuffle_key")
    assert [tuple(r) for r in first.collect()] == [tuple(r) for r in mixing.mix(docs.repartition(7), {"rare": 0.5}, target_rows=40_000).select("doc_id", "copy", "shuffle_key").orderBy("shuffle_key").collect()]
    order = [r.doc_id for r in first.collect()]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.03


def test_mixing_of_odd_rows(odd, empty):
    out = mixing.mix(odd, target_rows=400)
    assert out.columns[:7] == odd.columns and out.where("source IS NULL").count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd, most_sources=0).count() >= 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"src": -1.0})


# -- 8, 9 -------------------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark, docs, texts):
    rows = {r.doc_id: r for r in langid.op8(spark, DATA).collect()}
    held = [i for i, *_ in texts if rows[i].held_out]
    lang = {i: x[2] for i, *x in [(t[0], *t) for t in texts]}
    lang = {t[0]: t[2] for t in texts}
    assert len(rows) == len(texts) and sum(rows[i].lang_pred == lang[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_languages_by_a_plain_loop(docs, texts):
    """Counts of folded byte pairs and triples, weights and cosines in plain Python under the fitted model."""
    m = langid.fit(langid.training_rows(docs))
    got = {r.doc_id: r for r in langid.predict(docs, m).collect()}
    slot = lambda x, k: ((x * k) & 0xFFFFFFFF) >> (32 - 13)
    for i, t, *_ in texts[:60]:
        folded = "".join(chr(b) if b >= 128 else chr(b | 32) if chr(b).isalpha() else " " for b in (t or "").encode())
        while "  " in folded:
            folded = folded.replace("  ", " ")
        n = collections.Counter(slot(ord(a) << 8 | ord(b), 2654435761) for a, b in zip(folded, folded[1:]))
        n.update(slot(ord(a) << 16 | ord(b) << 8 | ord(c), 2246822519) for a, b, c in zip(folded, folded[1:], folded[2:]))
        v = {g: math.sqrt(k) * float(m.idf[g]) for g, k in n.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / size for c in m.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i].score == pytest.approx(cosines[best], abs=2e-4)
        assert got[i].lang_pred == m.langs[m.owner[best]]
        assert got[i].rejected == (cosines[best] / math.sqrt(min(1.0, max(1, sum(n.values())) / langid.ENOUGH)) < m.least)


def test_languages_that_were_not_learned_are_rejected(spark, docs):
    m = langid.fit(langid.training_rows(docs))
    r = random.Random(1)
    junk = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(20)]
    other = ["Это обычный русский текст для проверки.", "这是一个用于测试语言识别的中文句子。", "to jest zwykłe polskie zdanie używane do testowania rozpoznawania języka"]
    got = langid.predict(spark.createDataFrame(list(enumerate(junk + other)), "doc_id long, text string"), m).collect()
    assert all(x.rejected for x in got)
    kept = langid.predict(docs.where(fold("doc_id") == 0), m).where("lang_pred <> 'und'")
    assert kept.where("rejected").count() <= 0.01 * kept.count()


def test_languages_of_odd_rows(odd, empty, docs):
    m = langid.fit(langid.training_rows(docs))
    rows = langid.predict(odd, m, keep=("doc_id", "text", "fp")).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert all(r.lang_pred in {"en", "de", "fr", "es"} for r in rows if r.doc_id in (3, 6, 8))
    assert all(r.rejected for r in rows if r.doc_id in (0, 1, 2))
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    assert langid.predict(empty, m).count() == 0
    # pieces of other sizes give the same counts
    data = np.frombuffer("Ab c--d é Zz".encode(), np.uint8)
    assert langid.gram_counts(data, np.array([0, 5, 5, len(data)])).sum(1).tolist() == [7.0, 0.0, 13.0]


def toxic_table(spark, n=600):
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                t.insert(r.randrange(len(t)), r.choice(["vile", "foul", "NASTY!"]))
        rows.append((i, " ".join(t), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_of_held_out_texts(spark, odd, empty):
    t = toxic_table(spark)
    m = toxicity.fit(t, toxicity.seen(t))
    assert 0 < len(m[0]) < 200
    rows = toxicity.score(t, m, keep=("doc_id", "toxic")).where(fold("doc_id") == 0).collect()
    assert all((r.score >= 0.5) == (r.toxic == 1) for r in rows)
    rows = toxicity.score(odd, m, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count() and all(0 <= r.score < 0.5 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels)).collect()} == {0.5}
    assert toxicity.score(empty, m).count() == 0


def test_ftrl_equals_a_plain_loop():
    r = random.Random(2)
    examples = [(np.array(sorted(r.sample(range(40), 8))), int(r.random() < 0.4)) for _ in range(200)]
    z, n, zb, nb = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    alpha, beta, l1, l2 = 1.0, 1.0, 1.5, 0.1
    weight = lambda z, n: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)
    for _ in range(3):
        for f, y in examples:
            b = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            p = 1 / (1 + math.exp(-(sum(weight(z[i], n[i]) for i in f) + b)))
            g = p - y
            for i in f:
                w = weight(z[i], n[i])
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    want = {i: weight(z[i], n[i]) for i in range(40) if weight(z[i], n[i])}
    keep, w, bias = toxicity.ftrl(examples, alpha, beta, l1, l2, 3)
    assert dict(zip(keep.tolist(), w)) == pytest.approx(want) and 0 < len(want) < 40
    assert bias == pytest.approx(-zb / ((beta + math.sqrt(nb)) / alpha + l2))


# -- 10 --------------------------------------------------------------------------------------------


def jaccard(a, b):
    x, y = collections.Counter((a or "").lower().split()), collections.Counter((b or "").lower().split())
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def test_fingerprints_estimate_the_similarity(spark, docs, texts):
    rows = {r.doc_id: r for r in fingerprints.fingerprint(docs, rows=40).collect()}
    down = sorted(texts, key=lambda x: -x[0])
    errors = []
    for n, (i, t, *_) in enumerate(down):
        nxt = down[(n + 1) % len(down)][1]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        errors += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.3 * 0.5 / math.sqrt(fingerprints.SAMPLES)
    same = {}
    for i, t, *_ in texts:
        assert same.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint


def test_fingerprints_of_odd_rows(spark, odd, empty):
    rows = fingerprints.fingerprint(odd, rows=3).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint and by[6].fingerprint == by[7].fingerprint
    assert fingerprints.fingerprint(empty).count() == 0
    one = fingerprints.fingerprint(odd.where("doc_id = 6")).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("kind", ["limits", "hot"])
def test_fingerprints_of_extreme_null_and_repeated_ids(spark, kind):
    """Ids at both ends of long; a third of the rows without an id and a third with one id: the order is that of (id, hash of the text)."""
    r = random.Random(6)
    if kind == "limits":
        ids = [-(2**63), 2**63 - 1, *[r.randrange(-(2**63), 2**63) for _ in range(400)]]
    else:
        ids = [*[None] * 130, *[7] * 130, *range(140)]
    rows = [(i, " ".join(f"w{r.randrange(90)}" for _ in range(12))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed = lambda t: (x := xxhash.xxh64_intdigest(t.encode(), 42)) - (x >> 63 << 64)
    down = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), -signed(x[1])))
    want = collections.Counter()
    for n, (i, t) in enumerate(down):
        k = len(t) // 3
        want[i, hashlib.sha256((t[: len(t) - k] + down[(n + 1) % len(down)][1][:k]).encode()).hexdigest()] += 1
    got = collections.Counter((x.doc_id, x.edited_sha256) for x in fingerprints.fingerprint(df, rows=10).select("doc_id", "edited_sha256").collect())
    assert got == want
    bucket, n = fingerprints.ranges(df.withColumn("tie", F.xxhash64("text")), "doc_id", "tie", 10)
    sizes = [x["count"] for x in df.withColumn("tie", F.xxhash64("text")).groupBy(bucket.alias("b")).count().collect()]
    assert max(sizes) <= 40
