"""Elias-Fano sequences over numpy words, searched in batches; they may live in a memory-mapped file."""

from __future__ import annotations

import json

import numpy as np

U64 = np.uint64


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fields of `width` bits, little end first, in 64-bit words with one spare word."""
    if width == 0 or len(values) == 0:
        return np.zeros(2, U64)
    out, bit = [], np.arange(width, dtype=U64)
    for i in range(0, len(values), 1 << 14):
        out.append(np.packbits(((values[i : i + (1 << 14), None] >> bit) & U64(1)).astype(np.uint8).ravel(), bitorder="little"))
    b = np.concatenate(out)
    return np.concatenate([b, np.zeros(-len(b) % 8 + 16, np.uint8)]).view(U64)


class EliasFano:
    """A non-decreasing sequence of n numbers under `universe`.

    The upper parts are a bit vector with a directory of zeros per word, the lower `width` bits are packed."""

    def __init__(self, n: int, width: int, high: np.ndarray, zeros: np.ndarray, low: np.ndarray):
        self.n, self.width, self.high, self.zeros, self.low = n, width, high, zeros, low

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        values = values.astype(U64)
        upper = (values >> U64(width)).astype(np.int64)
        size = (universe >> width) + n + 2
        bits = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        bits[upper + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(U64)
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype(np.uint32)
        return cls(n, width, high, zeros, pack(values & U64((1 << width) - 1), width))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "zeros": self.zeros, "low": self.low, "n": np.array([self.n, self.width])}

    @classmethod
    def of(cls, a: dict[str, np.ndarray], name: str) -> EliasFano:
        n = a[f"{name}.n"]
        return cls(int(n[0]), int(n[1]), a[f"{name}.high"], a[f"{name}.zeros"], a[f"{name}.low"])

    @staticmethod
    def _bit(word: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th set bit of every word."""
        word, r, pos = word.copy(), r.astype(np.uint8), np.zeros(len(r), np.uint8)
        for w in (32, 16, 8, 4, 2, 1):
            c = np.bitwise_count(word & U64((1 << w) - 1))
            over = r >= c
            r -= c * over
            step = over * np.uint8(w)
            pos += step
            word >>= step
        return pos.astype(np.int64)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.zeros, k, "right") - 1
        return at * 64 + self._bit(~self.high[at], k - self.zeros[at].astype(np.int64))

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if self.width == 0:
            return np.zeros(len(i), U64)
        at = i.astype(np.int64) * self.width
        w, s = at >> 6, (at & 63).astype(U64)
        rest = np.where(s > 0, self.low[w + 1] << ((U64(64) - s) & U64(63)), U64(0))
        return ((self.low[w] >> s) | rest) & U64((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i (int64)."""
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros
        at = np.searchsorted(ones, i, "right") - 1
        upper = at * 64 + self._bit(self.high[at], i - ones[at]) - i
        return (upper.astype(U64) << U64(self.width)) | self._lower(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each x (uint64), -1 where it is not in the sequence, or not among the places from `first` up to `end`.

        The range is cut to the places with the upper part of x; the rest is a binary search."""
        out = np.full(len(x), -1, np.int64)
        h = x >> U64(self.width)
        inside = np.flatnonzero(h < U64(self.zeros[-1]))
        if self.n == 0 or len(inside) == 0:
            return out
        h, want = h[inside].astype(np.int64), x[inside] & U64((1 << self.width) - 1)
        hi = self._select0(h) - h
        lo = np.where(h > 0, self._select0(np.maximum(h - 1, 0)) - (h - 1), 0)
        if first is not None:
            lo, hi = np.maximum(lo, first[inside]), np.minimum(hi, end[inside])
        top = hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lower(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        there = np.flatnonzero(lo < top)
        there = there[self._lower(lo[there]) == want[there]]
        out[inside[there]] = lo[there]
        return out


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block whose parts start at multiples of 8 bytes."""
    head, body, at = {}, [], 0
    for k, v in arrays.items():
        v = np.ascontiguousarray(v)
        b = v.tobytes()
        head[k] = [v.dtype.str, at, len(v)]
        body.append(b + bytes(-len(b) % 8))
        at += len(body[-1])
    h = json.dumps(head).encode()
    h += b" " * (-len(h) % 8)
    return len(h).to_bytes(8, "little") + h + b"".join(body)


def load(buffer: np.ndarray, at: int = 0) -> dict[str, np.ndarray]:
    """The arrays of a block, as views of the (memory-mapped) bytes."""
    n = int.from_bytes(buffer[at : at + 8].tobytes(), "little")
    head = json.loads(buffer[at + 8 : at + 8 + n].tobytes())
    base = at + 8 + n
    return {k: buffer[base + o : base + o + c * np.dtype(t).itemsize].view(t) for k, (t, o, c) in head.items()}
