"""What the operators ask of a worker: work that must not be done twice, and lookups that must be in order."""

import numpy as np

from molframe.llm import langid, lm, media, webp
from molframe.llm.eliasfano import EliasFano


def test_modes_of_an_image_are_chosen_once_for_all_chains(monkeypatch):
    r = np.random.default_rng(3)
    y, x = np.mgrid[0:40, 0:144]
    p = webp.joined(np.stack([np.full(y.size, 255), *((y * k + x * 2 + r.integers(0, 3, y.shape)).ravel() & 255 for k in (1, 2, 3))]))
    calls = []
    chosen = webp.chosen_modes
    monkeypatch.setattr(webp, "chosen_modes", lambda *a: calls.append(1) or chosen(*a))
    f = webp.encode_best(p, 144, 40)
    assert len(calls) <= 2  # for the estimates, and for the file
    w, h, got = webp.decode_many([f])[0]
    assert (w, h) == (144, 40) and (got == p).all()


def test_feature_is_that_of_the_samples():
    for b in (bytes(range(256)) * 9, b"\xff" * 576, b"some words, repeated " * 48):
        v = np.frombuffer(b, np.uint8)
        bins = [int(round(1000 * n / len(v))) for n in np.bincount(v, minlength=256).reshape(16, 16).sum(1)]
        assert media.feature(b) == f"{v.mean():.3f}|{v.std():.3f}|" + ",".join(map(str, bins))


def test_words_are_looked_up_in_the_order_of_a_shard(monkeypatch):
    r = np.random.default_rng(4)
    h = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2))
    number, blocks, rows = 3, {}, {}
    for s in range(number):
        own = h[lm._word_shard(h, number) == s]
        keys = EliasFano.build(own - np.uint64(lm._start(s, number)), (1 << 64) // number + (1 << 41))
        n = np.arange(len(own)) % 7 + 1
        values, codes = np.unique(n, return_inverse=True)
        blocks[s] = {"keys": keys, "before": EliasFano.build(np.cumsum(n) - n, int(n.sum()) + 1), "values": values, "codes": codes}
        rows[s] = type("Row", (), {"n": len(own), "tokens": int(n.sum())})()
    words = lm.Words(type("Files", (), {"shard": staticmethod(blocks.get)}), number, rows)
    asked = []
    find = EliasFano.find
    monkeypatch.setattr(EliasFano, "find", lambda self, x, *a: asked.append(x) or find(self, x, *a))
    mixed = r.permutation(np.concatenate([h, h[:50] + np.uint64(1)]))
    ids, n, _ = words.find(mixed)
    assert len(asked) == number and all((x[1:] >= x[:-1]).all() for x in asked)
    at = np.searchsorted(h, mixed)
    known = (at < len(h)) & (h[np.minimum(at, len(h) - 1)] == mixed)
    assert (ids == np.where(known, at, -1)).all() and ((n > 0) == known).all()


def test_language_fit_lets_go_of_what_other_operators_keep(spark, monkeypatch, tmp_path):
    """Every step of the fit begins by freeing tables that an earlier operator left in the worker, the tokenizer's above all."""
    folder = str(tmp_path)

    def told(name):
        import sys

        open(f"{folder}/{name}-{sys._getframe(1).f_code.co_name}", "w").close()

    monkeypatch.setattr(langid, "only", told)
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    langid.fit(docs)
    assert {p.name for p in tmp_path.iterdir()} == {"langid-frequencies", "langid-sampled", "langid-clustered"}
