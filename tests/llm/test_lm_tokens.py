"""Words of a batch are split and numbered without a Python call for each."""

import random
import sys

import numpy as np
import xxhash

from molframe.llm import lm


def test_tokens_equal_plain_splitting():
    rng = random.Random(3)
    texts = [b"", b" ", b"  a  b\t\n", b"A \xc3\x89 \xc2\xa0x \xe2\x80\x83y", b"\xff\xfe a", b"a\x0bb\x0cc\rd\x1ce\x1ff\x85g", b"\r x", b"a\x00b A"]
    texts += [bytes(rng.randrange(256) for _ in range(rng.randrange(40))) for _ in range(500)]
    for some in (texts, [b""], []):
        hashes, x, at = lm.tokens(some)
        assert len(at) == len(some) + 1 and at[-1] == len(x) and hashes[0] == lm.START and hashes[1] == lm.END
        for i, t in enumerate(some):
            want = [lm.START, *(xxhash.xxh64_intdigest(w, lm.SEED) for w in t.lower().split()), lm.END]
            assert hashes[x[at[i] : at[i + 1]]].tolist() == want
        assert len(np.unique(hashes)) == len(hashes)


def test_no_python_call_for_each_word():
    """Interpreted calls and calls of C functions, of a text of one word many times."""
    calls = [0]

    def count(*_):
        calls[0] += 1

    text = [b"word " * 50_000]
    sys.setprofile(count)
    try:
        lm.tokens(text)
    finally:
        sys.setprofile(None)
    assert calls[0] < 5_000 and "defaultdict" not in vars(lm)
