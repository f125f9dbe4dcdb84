"""The Jaccard join, phrase mining and fill-in-middle on small tables: brute force, round trips and odd inputs."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from molframe.llm import fim, ngramjoin, phrases, simhash
from tests.conftest import DATA

ODD = ["", None, " \t\n", "a", "Ünïcode – 日本語 \U0001f600", "x" * 70_000, "the same text here", "the same text here", "w " * 5000, "no_space" * 400, "\x00\x01 ctl", "a <P> mark", "two words"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i == 3 else "en", "x", i) for i, t in enumerate(ODD)]
    rows += [rows[6], (None, "an id is missing", "en", "y", 9), (None, "the same text here", "und", "y", 9), (-(2**63), "", "en", "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, form string, size long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def texts():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


# -- 11 --------------------------------------------------------------------------------------------


def shingles(text, width=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(ids, sets, percent):
    """All pairs, by union-find."""
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    least = collections.defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return {i: min(v) for v in least.values() for i in v}


def families(seed, n=60):
    """Texts of 1 to 400 words with copies in which a few words are changed, dropped or added, near the threshold."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.choice([1, 2, 3, 8, 9, 10, 11, 12, 13, 25, 60, 150, 400]))]
        out.append(base)
        for _ in range(r.randrange(5)):
            w = list(r.choice(out[-3:]))
            for _ in range(r.randrange(1 + len(w) // 50)):
                at = r.randrange(len(w))
                w[at : at + r.randrange(2)] = [r.choice(vocab)] * r.randrange(2)
            out.append(w or base)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("percent,cell", [(90, 4096), (90, 3), (60, 4096), (100, 4096)])
def test_join_equals_all_pairs(spark, percent, cell):
    made = families(percent + cell)
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.join(df, percent=percent, cell=cell).collect()}
    sets = [shingles(t) for t in made]
    want = components(range(len(made)), sets, percent)
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    assert percent == 100 or 5 < len(set(want.values())) < len(made)


def test_join_of_a_large_family_in_cells(spark):
    """One group whose members are all near, more than a cell holds, with single words changed."""
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    made = []
    for i in range(150):
        w = list(base)
        for at in r.sample(range(200), r.choice([0, 1, 2, 3, 4])):
            w[at] = f"x{i}"
        made.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngramjoin.join(df, cell=20).collect()}
    assert got == components(range(len(made)), [shingles(t) for t in made], 90)


def test_linked_sets_share_a_box():
    r = np.random.default_rng(1)
    for n in [1, 2, 8, 9, 10, 11, 19, 30, 57, 100, 301, 777, 2500]:
        for _ in range(30):
            one = np.unique(r.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64))
            differ = 19 * 2 * len(one) // 19 // 19  # as many as the threshold allows, split between both at random
            lost = r.integers(0, differ + 1)
            other = np.unique(np.concatenate([r.permutation(one)[lost:], r.integers(0, 1 << 63, differ - lost, dtype=np.int64).astype(np.uint64)]))
            if ngramjoin.linked(one, [other])[0]:
                a, b = ngramjoin.boxes([one, other])
                assert len(np.intersect1d(a, b))


def test_bound_and_tree_lose_nothing():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 900, dtype=np.int64).astype(np.uint64)
    made = [np.unique(r.choice(pool, 300, replace=False)) for _ in range(40)]
    made += [np.unique(np.concatenate([x[r.integers(0, 30) :], pool[: r.integers(0, 12)]])) for x in made for _ in range(3)]
    size = np.array([len(x) for x in made])
    points = ngramjoin.counts(made, 64)
    tree = ngramjoin.CountTree(points, size)
    alive = np.ones(len(made), bool)
    seen = 0
    for i, x in enumerate(made):
        near = set(tree.near(points[i], size[i], alive).tolist())
        assert set(np.flatnonzero(ngramjoin.linked(x, made)).tolist()) <= near
        plain = np.flatnonzero(190 * np.minimum(points, points[i]).sum(1) >= 90 * (size + size[i]))
        assert near == set(plain.tolist())
        seen += len(near)
    assert seen < len(made) ** 2 / 4


def test_threshold_is_exact():
    x = np.arange(1, 11, dtype=np.uint64)
    assert ngramjoin.linked(x[:9], [x, x[:8], x[1:]]).tolist() == [True, False, False]
    assert not ngramjoin.linked(x[:0], [x[:0]])[0]


def test_join_odd_inputs(spark, odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(odd).collect()]
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for i, n, c in got:
        by[i].add((n, c))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)}  # blank texts link with nothing
    assert by[6] == by[7] == {(2, 6)} and sum(i == 6 for i, *_ in got) == 2
    assert by[None] == {(2, None), (2, 6)}
    assert by[5] == {(1, 5)} and by[8] == {(1, 8)} and by[12] == {(1, 12)}
    assert ngramjoin.join(empty).collect() == []


# -- 12 --------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}

    def inside(p, q):
        return any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))

    out = []
    for (lang, p), a in cand.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for (m, q), b in cand.items()):
            continue
        score, k, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, b" ".join(p), a, l, r, n[lang], score))
    got, rank = [], collections.Counter()
    for lang, _, _, p, a, l, r, m, score in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], p.decode(), a, l, r, m, score))
    return got


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(df, **more):
    return sorted(tuple(r) for r in phrases.collocations(df, **more).select(*COLUMNS).collect())


def test_phrases_equal_plain_counts(spark, texts):
    rows = [(t, l if i % 9 else None) for i, (_, t, l) in enumerate(texts)]
    df = spark.createDataFrame(rows, "text string, lang string")
    for least, top in ((12, 2000), (40, 7)):
        got = mined(df, least=least, top=top)
        assert got == plain_collocations(rows, least, top) and len(got) > 5


def test_phrases_in_small_parts(spark, texts, monkeypatch):
    """Chunks, hashed slices and projections far smaller than the table, so that all seams are met."""
    rows = [(t, l) for _, t, l in texts[:60]] + [("The the THE the, the the! x y z x y z", "en")] * 30
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    words_, off = np.frombuffer(b"aa b, c" + b"dd", np.uint8), np.array([0, 7, 9])
    start, end, text, joined = phrases.words(words_, off)
    assert (start.tolist(), end.tolist(), text.tolist(), joined.tolist()) == ([0, 3, 6, 7], [2, 4, 7, 9], [0, 0, 0, 1], [True, False, False, False])
    want = plain_collocations(rows, 10, 2000)
    assert mined(df, least=10) == want
    monkeypatch.setattr(phrases, "HOT", 20)  # most prefixes are dealt by two or three words
    assert mined(df, least=10) == want


def test_records_hold_all_and_shrink(monkeypatch):
    """Windows packed by prefix, hot ones by longer prefixes, come back whole from any order of tasks, however often they are compacted."""
    r = random.Random(9)
    rows = [("de" if i < 80 else "en", *[r.randrange(-1, 2) or 5 for _ in range(3)], *r.choice([(0, 0), (4, 0), (4, -7)])) for i in range(200)]
    count = collections.Counter(x[:1] + x[1 : k + 1] for x in rows for k in (3, 4, 5) if 0 not in x[1 : k + 1])
    for ones, twos in ((set(), set()), ({("de", 5), ("en", 1)}, {("en", 1, 5), ("de", 5, -1)})):
        records = []
        for task in range(5):
            for name in ("de", "en"):
                own = [x for x in rows[task::5] if x[0] == name]
                window, n = phrases.summed([np.array([x[k] for x in own]) for k in range(1, 6)], np.ones(len(own), np.int64))
                for batch in phrases.packed(name, window, n, ones, twos):
                    records += [tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)]
        records.sort(key=lambda x: x[:4])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[i] for x in records[s : s + 7]], k) for i, k in enumerate(kinds)], ["lang", "w1", "p2", "p3", "rows"]) for s in range(0, len(records), 7)]
        for most in (1 << 20, 6):
            monkeypatch.setattr(phrases, "PROJECTED", most)
            parts = list(phrases.by_prefix(batches))
            assert len(parts) == len({x[:4] for x in records})
            got = collections.Counter({(name, *w): f for name, c, n in parts for w, f in phrases.grown(c, n, 0, len(n), 0, 3)})
            assert got == {k: f for k, f in count.items() if f >= 3} and len(got) > 20


def test_phrases_of_equal_hash_are_counted_anew(spark, texts):
    """A multiplier of 1 makes a hash of the sum of bytes, so words collide and the next one is taken."""
    df = spark.createDataFrame([(t, l) for _, t, l in texts[:40]], "text string, lang string")
    def spelled(**more):
        """Patterns as texts, so that codes and hashes compare."""
        every, names, _ = phrases.patterns(df, least=15, **more)
        word = {(r.lang, r.h): r.word for r in names.collect()}
        return {(r.lang, *(word[r.lang, h] for h in r.words), r.f) for r in every.collect()}

    assert spelled() == spelled(multipliers=(1, *phrases.MULTIPLIERS)) == spelled(most_words=0)
    with pytest.raises(RuntimeError):
        phrases.patterns(df, least=15, multipliers=(1,))


def test_scores_pass_64_bits(spark):
    every = spark.createDataFrame([("en", [1], 3 * 10**12), ("en", [2], 10**12 + 1), ("en", [1, 2], 10**12)], "lang string, words array<long>, f long")
    totals = spark.createDataFrame([("en", 8 * 10**17)], "lang string, n long")
    (r,) = phrases.scored(every.where("size(words) = 2"), every, totals).collect()
    assert r.score == 1000 * r.a * r.n // (r.l * r.r) == 1000 * 10**12 * 8 * 10**17 // (3 * 10**12 * (10**12 + 1))


def test_filter_has_all_and_is_bounded(spark):
    df = spark.range(5000).selectExpr("'en' AS lang", "id * 7919 AS h")
    for most in (1 << 12, 1 << 20):
        f = phrases.Filter.of(df, phrases.word_keys, most)
        keys = np.arange(5000).astype(np.uint64) * np.uint64(7919) ^ phrases._tongue("en")
        assert f.has(keys).all() and 8 * len(f.bits) <= most
    assert f.has(keys + np.uint64(1)).mean() < 0.05


def test_phrases_odd_inputs(spark, odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert mined(odd, least=2) == plain_collocations(rows, 2, 2000) != []
    assert mined(empty) == [] and mined(empty, least=1) == []


# -- 13 --------------------------------------------------------------------------------------------


def test_fill_in_middle_equals_plain_slicing(spark, odd, texts):
    df = odd.select("doc_id", "text", "size").unionByName(spark.createDataFrame([(i, t, 0) for i, t, _ in texts], "doc_id long, text string, size long"))
    got = fim.restored(fim.transform(df)).collect()
    forms = collections.Counter()
    for r in got:
        t = r.text or ""
        h = hashlib.sha256(f"1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
        n = len(t)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        plain = not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        want = {"plain": t, "psm": f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", "spm": f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"}[form]
        assert (r.n, r.form, r.output, r.restored) == (n, form, want, t)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if plain else (a, b - a))
        forms[form] += 1
    assert len(got) == df.count() and min(forms.values()) > 10 and set(forms) == {"plain", "psm", "spm"}


def test_units_have_boundaries_between_classes():
    p = fim.points("ab  c\n\nd".encode())
    assert fim.boundaries(p).tolist() == list(range(9))
    assert fim.boundaries(p, "word").tolist() == [0, 2, 4, 5, 7, 8]
    assert fim.boundaries(p, "line").tolist() == [0, 6, 7, 8]
    for unit in fim.UNITS:
        assert fim.boundaries(fim.points(b""), unit).tolist() == [0]
        assert fim.boundaries(fim.points(b"x"), unit).tolist() == [0, 1]


def test_broken_bytes_and_marks_in_halves_come_back():
    for data in (b"\xff\xfe a \xe2\x82", b"<P<S<M>"[:-1], b"a<<S", b">S<"):
        for h1 in range(8):
            for h2 in range(8):
                _, _, _, *parts = fim.cut_at(data, h1, h2)
                for form in ("psm", "spm"):
                    assert fim.restore(fim.arranged(form, *parts), form) == data
    assert fim.restore(b"as it is", "plain") == b"as it is"


def test_fill_in_middle_keeps_columns(spark, odd, empty):
    got = fim.transform(odd, unit="word", percent=100, spm_percent=0)
    assert got.columns == ["doc_id", "text", "lang", "size", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert {r.form for r in got.collect()} == {"plain", "psm"}
    assert all(r.restored == (r.text or "") for r in fim.restored(got).collect())
    assert fim.transform(empty).collect() == [] and fim.restored(fim.transform(empty)).collect() == []
    with pytest.raises(ValueError):
        fim.transform(odd, unit="page")
