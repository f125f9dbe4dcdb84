"""Lossless WebP (VP8L) images: a complete decoder, and encoders that make such streams.

Decoding: prefix codes (simple and normal, with meta prefix groups), back-references with plane
distances, colour cache, and the inverse predictor, cross-colour, subtract-green and colour-indexing
transforms. `decode` takes any single stream. `decode_many` reads a batch: streams that start with the
same code tables are read in lockstep over numpy arrays, all others one by one.

`encode` writes one image with any choice of transforms, cache and prefix groups. `encode_many` writes
a batch with one fixed set of prefix codes: literals, colour-cache hits and back-references; with a chain of
predictor, cross-colour and subtract-green transforms if one is named.

Pixels are uint32 ARGB.
"""

from __future__ import annotations

import heapq

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CACHE_MULTIPLIER = 0x1E35A7BD
LENGTH_CODES, DISTANCE_CODES, MOST_COPY, MOST_SIDE = 24, 40, 4096, 16384
PLANE = sorted([(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0], key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
OPAQUE = 0xFF000000
U32, U64 = np.uint32, np.uint64


# -- bits and prefix codes -----------------------------------------------------------------


class Bits:
    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos = data, pos

    def read(self, n: int) -> int:
        p = self.pos
        self.pos = p + n
        if self.pos > 8 * len(self.data):
            raise ValueError("truncated stream")
        return (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7)) & ((1 << n) - 1)


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.size
        self.size += n


def code_lengths(weights, limit: int = 15) -> list[int]:
    """Huffman code lengths of the symbols with a weight, none over `limit`; small weights are raised until it holds."""
    w = [float(x) for x in weights]
    live = [i for i, x in enumerate(w) if x > 0]
    out = [0] * len(w)
    if len(live) < 2:
        for i in live:
            out[i] = 1
        return out
    floor = 0.0
    while True:
        heap = [(max(w[i], floor), k, (i,)) for k, i in enumerate(live)]
        depth = dict.fromkeys(live, 0)
        heapq.heapify(heap)
        k = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in a[2] + b[2]:
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, a[2] + b[2]))
            k += 1
        if max(depth.values()) <= limit:
            for i in live:
                out[i] = depth[i]
            return out
        floor = max(2 * floor, sum(w) / (1 << (limit + 2)))


def canonical(lengths) -> list[int]:
    """Codes as they are written, first bit lowest."""
    out, code, n = [0] * len(lengths), 0, np.bincount(lengths, minlength=16)
    first = [0] * 17
    for k in range(1, 16):
        first[k] = code = (code + (int(n[k - 1]) if k > 1 else 0)) << 1
    for i, k in enumerate(lengths):
        if k:
            out[i] = int(f"{first[k]:0{k}b}"[::-1], 2)
            first[k] += 1
    return out


class Code:
    """A prefix code as a table over the next `bits` bits: symbol * 16 + length."""

    def __init__(self, lengths):
        used = [i for i, k in enumerate(lengths) if k]
        if len(used) == 1:
            self.bits, self.table = 0, np.array([used[0] * 16], np.int64)
        elif not used:
            self.bits, self.table = 0, np.zeros(1, np.int64)
        else:
            if sum(1 << (15 - k) for k in lengths if k) != 1 << 15:
                raise ValueError("incomplete prefix code")
            self.bits = max(lengths)
            self.table = np.zeros(1 << self.bits, np.int64)
            for i, c in zip(used, [x for x, k in zip(canonical(lengths), lengths) if k]):
                self.table[c :: 1 << lengths[i]] = i * 16 + lengths[i]
        self.quick = self.table.tolist()
        self.mask = (1 << self.bits) - 1

    def read(self, bits: Bits) -> int:
        p = bits.pos
        e = self.quick[(int.from_bytes(bits.data[p >> 3 : (p >> 3) + 3], "little") >> (p & 7)) & self.mask]
        bits.pos = p + (e & 15)
        if bits.pos > 8 * len(bits.data):
            raise ValueError("truncated stream")
        return e >> 4


def read_lengths(bits: Bits, alphabet: int) -> list[int]:
    out = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        for symbol in [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else []):
            if symbol >= alphabet:
                raise ValueError("symbol outside its alphabet")
            out[symbol] = 1
        return out
    outer = [0] * 19
    for i in LENGTH_ORDER[: 4 + bits.read(4)]:
        outer[i] = bits.read(3)
    code = Code(outer)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    if left > alphabet:
        raise ValueError("too many code lengths")
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = code.read(bits)
        if s < 16:
            out[i] = s
            last = s or last
            i += 1
        else:
            n, v = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if i + n > alphabet:
                raise ValueError("code lengths run over")
            out[i : i + n] = [v] * n
            i += n
    return out


def write_lengths(w: Writer, lengths) -> None:
    used = [i for i, k in enumerate(lengths) if k]
    if len(used) <= 2 and all(i < 256 for i in used):
        w.put(1, 1)
        w.put(max(0, len(used) - 1), 1)
        w.put(1, 1)
        w.put(used[0] if used else 0, 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    steps, i = [], 0
    while i < len(lengths):
        j = i
        while j < len(lengths) and lengths[j] == lengths[i]:
            j += 1
        n, v = j - i, lengths[i]
        if v == 0 and n >= 3:
            n = min(n, 138)
            steps.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
        elif v and n >= 4:
            n = min(n, 7)
            steps += [(v, 0, 0), (16, n - 4, 2)]
        else:
            n = 1
            steps.append((v, 0, 0))
        i += n
    outer = code_lengths(np.bincount([s for s, _, _ in steps], minlength=19), 7)
    codes, single = canonical(outer), sum(1 for k in outer if k) == 1
    w.put(0, 1)
    count = max(4, 1 + max(k for k, i in enumerate(LENGTH_ORDER) if outer[i]))
    w.put(count - 4, 4)
    for i in LENGTH_ORDER[:count]:
        w.put(outer[i], 3)
    w.put(0, 1)
    for s, extra, n in steps:
        w.put(codes[s], 0 if single else outer[s])
        w.put(extra, n)


# -- entropy-coded images ----------------------------------------------------------------------


def plane_distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = PLANE[code - 1]
    return max(1, x + y * width)


def _prefixed(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + bits.read(n) + 1


def read_groups(bits: Bits, number: int, cache_bits: int) -> list[list[Code]]:
    green = 256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0)
    return [[Code(read_lengths(bits, n)) for n in (green, 256, 256, 256, DISTANCE_CODES)] for _ in range(number)]


def _cache_bits(bits: Bits) -> int:
    if not bits.read(1):
        return 0
    n = bits.read(4)
    if not 1 <= n <= 11:
        raise ValueError("bad colour cache")
    return n


def read_pixels(bits: Bits, width: int, n: int, groups: list[list[Code]], cache_bits: int, which=None, block: int = 0, out=None, cache=None) -> list[int]:
    """n pixels in all, after those in `out`; `which`: rows of group numbers of the blocks of 2**block pixels."""
    out = [] if out is None else out
    cache = [0] * (1 << cache_bits) if cache_bits and cache is None else cache
    shift, data, pos, end = 32 - cache_bits, bits.data, bits.pos, 8 * len(bits.data)
    group = groups[0]
    while len(out) < n:
        if which is not None:
            y, x = divmod(len(out), width)
            group = groups[which[y >> block][x >> block]]
        g, r, b, a, d = group
        v = int.from_bytes(data[pos >> 3 : (pos >> 3) + 9], "little") >> (pos & 7)
        e = g.quick[v & g.mask]
        k, s = e & 15, e >> 4
        if s < 256:
            e = r.quick[(v >> k) & r.mask]
            p = s << 8 | (e >> 4) << 16
            k += e & 15
            e = b.quick[(v >> k) & b.mask]
            p |= e >> 4
            k += e & 15
            e = a.quick[(v >> k) & a.mask]
            p |= (e >> 4) << 24
            pos += k + (e & 15)
            out.append(p)
            if cache_bits:
                cache[((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = p
        elif s < 256 + LENGTH_CODES:
            bits.pos = pos + k
            length = _prefixed(bits, s - 256)
            dist = plane_distance(_prefixed(bits, d.read(bits)), width)
            pos = bits.pos
            at = len(out) - dist
            if at < 0 or len(out) + length > n:
                raise ValueError("back-reference outside the image")
            new = (out[at:] * (-(-length // dist)))[:length] if dist < length else out[at : at + length]
            out += new
            if cache_bits:
                for p in new:
                    cache[((p * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> shift] = p
        else:
            if not cache_bits or s - 256 - LENGTH_CODES >= len(cache):
                raise ValueError("colour outside the cache")
            pos += k
            out.append(cache[s - 256 - LENGTH_CODES])
        if pos > end:
            raise ValueError("truncated stream")
    bits.pos = pos
    return out


def read_image(bits: Bits, width: int, height: int, main: bool = False) -> np.ndarray:
    cache_bits = _cache_bits(bits)
    which, block, number = None, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        w, h = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
        ids = (read_image(bits, w, h) >> U32(8)) & U32(0xFFFF)
        which, number = ids.reshape(h, w).tolist(), int(ids.max()) + 1
    return np.array(read_pixels(bits, width, width * height, read_groups(bits, number, cache_bits), cache_bits, which, block), U32)


# -- transforms --------------------------------------------------------------------------------


def channels(p: np.ndarray) -> np.ndarray:
    """(4, n) of alpha, red, green, blue as int32."""
    return np.stack([(p >> U32(k)) & U32(255) for k in (24, 16, 8, 0)]).astype(np.int32)


def joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(U32)
    return c[0] << U32(24) | c[1] << U32(16) | c[2] << U32(8) | c[3]


def predicted(mode: int, l, t, tr, tl):
    """A mode's prediction from the left, top, top-right and top-left pixels; (4, n) each."""
    half = lambda a, b: (a + b) >> 1
    clamp = lambda a: np.clip(a, 0, 255)
    if mode == 11:
        closer = np.abs(t - tl).sum(0) < np.abs(l - tl).sum(0)
        return np.where(closer, l, t)
    if mode == 13:
        a = half(l, t)
        return clamp(a + np.trunc((a - tl) / 2).astype(a.dtype))
    plain = {1: lambda: l, 2: lambda: t, 3: lambda: tr, 4: lambda: tl, 5: lambda: half(half(l, tr), t), 6: lambda: half(l, tl), 7: lambda: half(l, t), 8: lambda: half(tl, t), 9: lambda: half(t, tr), 10: lambda: half(half(l, tl), half(t, tr)), 12: lambda: clamp(l + t - tl)}
    if mode in plain:
        return plain[mode]()
    black = np.zeros_like(l)
    black[0] = 255
    return black


def _modes(data: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    w = (width + (1 << block) - 1) >> block
    y, x = np.divmod(np.arange(width * height), width)
    return ((data >> U32(8)) & U32(15)).astype(np.int64)[(y >> block) * w + (x >> block)].reshape(height, width)


def unpredict(p: np.ndarray, width: int, height: int, data: np.ndarray, block: int) -> np.ndarray:
    """Rows whose modes use no left pixel are added at once, the others pixel by pixel."""
    res, mode = channels(p).reshape(4, height, width), _modes(data, width, height, block)
    out = np.zeros_like(res)
    for y in range(height):
        if y == 0:
            first = res[:, 0].copy()
            first[0, 0] += 255
            out[:, 0] = np.cumsum(first, 1) & 255
            continue
        top, left = out[:, y - 1], (res[:, y, 0] + out[:, y - 1, 0]) & 255
        row = out[:, y]
        row[:, 0] = left
        above_right = np.concatenate([top[:, 1:], left[:, None]], 1)
        m = mode[y]
        if np.isin(m[1:], (0, 2, 3, 4, 8, 9, 14, 15)).all():
            for k in np.unique(m[1:]):
                at = np.nonzero(m == k)[0]
                at = at[at > 0]
                row[:, at] = (res[:, y, at] + predicted(int(k), top[:, at], top[:, at], above_right[:, at], top[:, at - 1])) & 255
            continue
        for x in range(1, width):
            one = slice(x, x + 1)
            row[:, one] = (res[:, y, one] + predicted(int(m[x]), row[:, x - 1 : x], top[:, one], above_right[:, one], top[:, x - 1 : x])) & 255
    return joined(out.reshape(4, -1))


def _neighbours(c: np.ndarray) -> tuple:
    """The left, top, top-right and top-left pixels of an image (4, height, width); rows above the first and pixels left of it are 0, the last of a row has the first of its own row at its top right."""
    l, t, tl = np.zeros_like(c), np.zeros_like(c), np.zeros_like(c)
    l[:, :, 1:], t[:, 1:], tl[:, 1:, 1:] = c[:, :, :-1], c[:, :-1], c[:, :-1, :-1]
    tr = np.concatenate([t[:, :, 1:], c[:, :, :1]], 2)
    return l, t, tr, tl


def _residuals(c: np.ndarray, near: tuple, mode: np.ndarray) -> np.ndarray:
    """What is left of an image by the mode of each pixel, (height, width) or one number; the first row and column have fixed ones."""
    l, t, tr, tl = near
    modes = np.unique(mode)
    guess = predicted(int(modes[0]), l, t, tr, tl).copy()
    for k in modes[1:]:
        guess = np.where(mode == k, predicted(int(k), l, t, tr, tl), guess)
    guess[:, :, 0] = t[:, :, 0]
    guess[:, 0] = l[:, 0]
    guess[0, 0, 0] = 255
    return c - guess


def predict(p: np.ndarray, width: int, height: int, data: np.ndarray, block: int) -> np.ndarray:
    """The residuals that `unpredict` takes back."""
    c = channels(p).reshape(4, height, width)
    return joined(_residuals(c, _neighbours(c), _modes(data, width, height, block)).reshape(4, -1))


def recolour(p: np.ndarray, width: int, height: int, data: np.ndarray, block: int, back: bool) -> np.ndarray:
    """The cross-colour transform, inverse with `back`."""
    w = (width + (1 << block) - 1) >> block
    y, x = np.divmod(np.arange(width * height), width)
    return recoloured(p, channels(data)[:, (y >> block) * w + (x >> block)], back)


def recoloured(p: np.ndarray, e, back: bool) -> np.ndarray:
    """The same with the multipliers of every pixel, or of all: (unused, red to blue, green to blue, green to red)."""
    signed = lambda v: ((v & 255) ^ 128) - 128
    red_to_blue, green_to_blue, green_to_red = signed(e[1]), signed(e[2]), signed(e[3])
    a, r, g, b = channels(p)
    delta = lambda t, c: (t * signed(c)) >> 5
    if back:
        r = (r + delta(green_to_red, g)) & 255
        b = b + delta(green_to_blue, g) + delta(red_to_blue, r)
    else:
        b = b - delta(green_to_blue, g) - delta(red_to_blue, r)
        r = r - delta(green_to_red, g)
    return joined(np.stack([a, r, g, b]))


def add_green(p: np.ndarray, sign: int) -> np.ndarray:
    c = channels(p)
    c[[1, 3]] += sign * c[2]
    return joined(c)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _differences(table: np.ndarray, back: bool) -> np.ndarray:
    c = channels(table)
    return joined(np.cumsum(c, 1) if back else np.diff(c, axis=1, prepend=0))


def unindex(p: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    k = _bundle(len(table))
    bits = 8 >> k
    index = ((p >> U32(8)) & U32(255)).reshape(height, -1)
    if k:
        index = ((index[:, :, None] >> (np.arange(1 << k, dtype=U32) * U32(bits))) & U32((1 << bits) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, U32)
    full[: len(table)] = table
    return full[index.ravel()]


# -- decoding ----------------------------------------------------------------------------------


def unwrap(data: bytes) -> bytes:
    """The VP8L chunk of a file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, pixels) of one file."""
    chunk = unwrap(data)
    if chunk[0] != 0x2F:
        raise ValueError("bad signature")
    bits = Bits(chunk, 8)
    full, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("bad version")
    width, steps = full, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise ValueError("transform used twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            side = lambda n: (n + (1 << block) - 1) >> block  # noqa: B023, E731
            steps.append((kind, width, read_image(bits, side(width), side(height)), block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps.append((kind, width, _differences(read_image(bits, n, 1), True), 0))
            width = (width + (1 << _bundle(n)) - 1) >> _bundle(n)
        else:
            steps.append((kind, width, None, 0))
    p = read_image(bits, width, height, main=True)
    for kind, w, extra, block in reversed(steps):
        if kind == PREDICTOR:
            p = unpredict(p, w, height, extra, block)
        elif kind == CROSS_COLOUR:
            p = recolour(p, w, height, extra, block, True)
        elif kind == SUBTRACT_GREEN:
            p = add_green(p, 1)
        else:
            p = unindex(p, w, height, extra)
    return full, height, p


# -- encoding ----------------------------------------------------------------------------------


def wrap(chunk: bytes) -> bytes:
    pad = len(chunk) & 1
    return b"RIFF" + (12 + len(chunk) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk + b"\0" * pad


def prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits, their number) of values from 1."""
    v = v.astype(np.int64) - 1
    top = np.zeros(len(v), np.int64)
    big = v >= 4
    top[big] = np.floor(np.log2(v[big])).astype(np.int64)
    n = np.where(big, top - 1, 0)
    symbol = np.where(big, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1), v)
    return symbol, np.where(big, v & ((1 << n) - 1), 0), n


def tokens(p: np.ndarray, first: np.ndarray, width: np.ndarray, cache_bits: int, least: int = 3):
    """Tokens of images laid end to end that start at `first`: (place, kind, length, distance code, cache slot).

    kind: 0 a literal, 1 a copy, 2 a cache hit. A pixel is a hit if the last pixel of its cache slot is
    equal; hits at one distance, at least `least` in a row, become copies. All of it by one stable sort."""
    n = len(p)
    image = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    slot = ((p.astype(U64) * U64(CACHE_MULTIPLIER)) & U64(0xFFFFFFFF)) >> U64(32 - cache_bits)
    key = (image.astype(np.int64) << cache_bits) | slot.astype(np.int64)
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (p[order[1:]] == p[order[:-1]])
    dist = np.zeros(n, np.int64)
    dist[order[1:][same]] = (order[1:] - order[:-1])[same]
    # runs of one distance, cut at image starts and after MOST_COPY pixels
    start = np.ones(n, bool)
    start[1:] = (dist[1:] != dist[:-1]) | (dist[1:] == 0)
    start[first] = True
    begin = np.nonzero(start)[0]
    length = np.diff(np.append(begin, n))
    long = (length >= least) & (dist[begin] > 0)
    pieces = np.where(long, -(-length // MOST_COPY), length)
    at = np.repeat(begin, pieces)
    step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    copy = np.repeat(long, pieces)
    place = at + step * np.where(copy, MOST_COPY, 1)
    size = np.where(copy, np.minimum(MOST_COPY, np.repeat(begin + length, pieces) - place), 1)
    kind = np.where(copy, 1, np.where(dist[place] > 0, 2, 0))
    d = dist[place]
    code = np.where(d == 1, 2, np.where(d == width[image[place]], 1, d + 120))
    return place, kind, size, code, slot[place].astype(np.int64), image[place]


def _fields(p, place, kind, size, code, slot, lengths, codes):
    """(bits, number of bits) of each token under one group of prefix codes."""
    ln, cd = [np.array(x, np.int64) for x in lengths], [np.array(x, np.int64).astype(U64) for x in codes]
    for i, x in enumerate(lengths):  # a code of one symbol takes no bits
        if sum(1 for k in x if k) == 1:
            ln[i], cd[i] = np.zeros_like(ln[i]), np.zeros_like(cd[i])
    value, bits = np.zeros(len(place), U64), np.zeros(len(place), np.int64)

    def put(rows, v, n):
        value[rows] |= v << bits[rows].astype(U64)
        bits[rows] += n

    lit = np.nonzero(kind == 0)[0]
    px = p[place[lit]]
    for i, k in ((0, 8), (1, 16), (2, 0), (3, 24)):
        s = ((px >> U32(k)) & U32(255)).astype(np.int64)
        put(lit, cd[i][s], ln[i][s])
    hit = np.nonzero(kind == 2)[0]
    s = 256 + LENGTH_CODES + slot[hit]
    if len(hit):
        put(hit, cd[0][s], ln[0][s])
    ref = np.nonzero(kind == 1)[0]
    if len(ref):
        s, extra, n = prefixes(size[ref])
        put(ref, cd[0][256 + s], ln[0][256 + s])
        put(ref, extra.astype(U64), n)
        s, extra, n = prefixes(code[ref])
        put(ref, cd[4][s], ln[4][s])
        put(ref, extra.astype(U64), n)
    return value, bits


def _or_into(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """words[at] |= value, for `at` in order."""
    if len(at):
        begin = np.nonzero(np.append(True, at[1:] != at[:-1]))[0]
        words[at[begin]] |= np.bitwise_or.reduceat(value, begin)


def place_bits(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Put values at the bit places `at`, which rise."""
    s = (at & 63).astype(U64)
    _or_into(words, at >> 6, value << s)
    over = np.where(s > 0, value >> ((U64(64) - s) & U64(63)), U64(0))
    _or_into(words, (at >> 6) + 1, over)


def _histograms(p, place, kind, size, code, slot, cache_bits):
    px = channels(p[place[kind == 0]])
    green = np.bincount(px[2], minlength=256 + LENGTH_CODES + ((1 << cache_bits) if cache_bits else 0))
    s, _, _ = prefixes(size[kind == 1])
    green += np.bincount(256 + s, minlength=len(green))
    green += np.bincount(256 + LENGTH_CODES + slot[kind == 2], minlength=len(green)) if cache_bits else 0
    d, _, _ = prefixes(code[kind == 1])
    return [green, *[np.bincount(px[i], minlength=256) for i in (1, 3, 0)], np.bincount(d, minlength=DISTANCE_CODES)]


def write_image(w: Writer, p: np.ndarray, width: int, cache_bits: int = 0, main: bool = False, block: int = 0) -> None:
    """An entropy-coded image; with `block`, a main image of two prefix groups in a checkerboard of blocks."""
    place, kind, size, code, slot, _ = tokens(p, np.array([0]), np.array([width]), cache_bits or 11)
    if not cache_bits:
        kind = np.where(kind == 2, 0, kind)
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    group = np.zeros(len(place), np.int64)
    if main:
        w.put(1 if block else 0, 1)
        if block:
            height = len(p) // width
            w.put(block - 2, 3)
            bw, bh = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            board = (np.add.outer(np.arange(bh), np.arange(bw)) & 1).astype(U32)
            write_image(w, (board << U32(8)).ravel(), bw)
            y, x = np.divmod(place, width)
            group = board[y >> block, x >> block].astype(np.int64)
    value, bits = np.zeros(len(place), U64), np.zeros(len(place), np.int64)
    for k in range(2 if block and main and len(np.unique(board)) > 1 else 1):
        t = [x[group == k] for x in (place, kind, size, code, slot)]
        lengths = [code_lengths(h) for h in _histograms(p, *t, cache_bits)]
        for x in lengths:
            write_lengths(w, x)
        value[group == k], bits[group == k] = _fields(p, *t, lengths, [canonical(x) for x in lengths])
    at = np.cumsum(bits) - bits
    words = np.zeros((int(bits.sum()) >> 6) + 3, U64)
    place_bits(words, at, value)
    w.put(int.from_bytes(words.tobytes(), "little"), int(bits.sum()))


def encode(p: np.ndarray, width: int, height: int, transforms=(), cache_bits: int = 0, block: int = 0, mode_block: int = 3, seed: int = 0, choose: bool = False) -> bytes:
    """One file. `transforms` in the order of application; predictor modes and colour multipliers are chosen by block with `choose`, else they cycle through all values from `seed` on."""
    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    p, now = p.astype(U32), width
    for kind in transforms:
        bw, bh = (now + (1 << mode_block) - 1) >> mode_block, (height + (1 << mode_block) - 1) >> mode_block
        i = np.arange(bw * bh, dtype=np.int64) + seed
        table = None
        if kind == PALETTE:
            table, index = np.unique(p, return_inverse=True)
            if len(table) > 256:
                raise ValueError("too many colours")
        w.put(1, 1)
        w.put(kind, 2)
        if kind == PREDICTOR:
            data = chosen_modes(p, now, height, mode_block) if choose else ((i % 14).astype(U32) << U32(8)) | U32(OPAQUE)
            w.put(mode_block - 2, 3)
            write_image(w, data, bw)
            p = predict(p, now, height, data, mode_block)
        elif kind == CROSS_COLOUR:
            data = chosen_colours(p, now, height, mode_block) if choose else joined(np.stack([np.full(len(i), 255), i * 37, i * 101 + 5, i * 59 + 200]))
            w.put(mode_block - 2, 3)
            write_image(w, data, bw)
            p = recolour(p, now, height, data, mode_block, False)
        elif kind == SUBTRACT_GREEN:
            p = add_green(p, -1)
        else:
            w.put(len(table) - 1, 8)
            write_image(w, _differences(table, False), len(table))
            k = _bundle(len(table))
            index = index.reshape(height, now)
            index = np.pad(index, ((0, 0), (0, -now % (1 << k)))).reshape(height, -1, 1 << k)
            packed = (index << (np.arange(1 << k) * (8 >> k))).sum(2)
            now = packed.shape[1]
            p = (packed.astype(U32) << U32(8)).ravel() | U32(OPAQUE)
    w.put(0, 1)
    write_image(w, p, now, cache_bits, True, block)
    return wrap(w.value.to_bytes((w.size + 7) // 8, "little"))


def _by_block(v: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """Sums of pixel values over square blocks."""
    v = v.reshape(height, width)
    rows = np.add.reduceat(v, np.arange(0, height, 1 << block), 0)
    return np.add.reduceat(rows, np.arange(0, width, 1 << block), 1).ravel()


#: About the bits of a residual by its low byte: the logarithm of its size, either way.
_SIZE = np.log2(1.0 + np.minimum(np.arange(256), 256 - np.arange(256)))


def chosen_modes(p: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """The predictor mode of least weight in each block, as the pixels of its image."""
    c = channels(p).reshape(4, height, width)
    near = _neighbours(c)
    every = [_by_block(_SIZE[_residuals(c, near, mode) & 255].sum(0), width, height, block) for mode in range(14)]
    return (np.argmin(every, 0).astype(U32) << U32(8)) | U32(OPAQUE)


def chosen_colours(p: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """Multipliers of each block: how much of red and blue goes with green, and of the rest of blue with red, by least squares; samples count as signed."""
    signed = lambda v: ((v & 255) ^ 128) - 128
    _, r, g, b = (signed(x).astype(float) for x in channels(p))
    total = lambda v: _by_block(v, width, height, block)
    y, x = np.divmod(np.arange(width * height), width)
    of = (y >> block) * ((width + (1 << block) - 1) >> block) + (x >> block)
    step = lambda v, t: np.clip(np.round(32 * total(v * t) / np.maximum(total(t * t), 1)), -128, 127)
    green_to_red, green_to_blue = step(r, g), step(b, g)
    red_to_blue = step(b - green_to_blue[of] * g / 32, r)
    return joined(np.stack([np.full(len(green_to_red), 255), *(c.astype(np.int64) & 255 for c in (red_to_blue, green_to_blue, green_to_red))]))


def entropies(p: np.ndarray, image: np.ndarray, n: int) -> np.ndarray:
    """Bits of each of n images, every channel under its own code of order 0; `image` names that of each pixel."""
    size = np.maximum(np.bincount(image, minlength=n), 1)[:, None].astype(float)
    out = np.zeros(n)
    at = image * 256
    for v in p.view(np.uint8).reshape(-1, 4).T:
        h = np.bincount(at + v, minlength=256 * n).reshape(n, 256)
        out += (h * (np.log2(size) - np.log2(np.maximum(h, 1)))).sum(1)
    return out


def plain_is_best(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of images laid end to end: whether differences from the left, from green and from a share of green all take no fewer bits than the pixels as they are."""
    n = len(first)
    image = np.repeat(np.arange(n), np.diff(np.append(first, len(p))))
    own = entropies(p, image, n)
    v = _bytes(p)
    left = v.copy()
    left[1:] -= v[:-1]
    left[first] = v[first]
    green = v.copy()  # bytes are blue, green, red, alpha
    green[:, 0] -= v[:, 1]
    green[:, 2] -= v[:, 1]
    share = v.copy()
    g = v[:, 1].view(np.int8).astype(np.int64)
    for c in (0, 2):
        k = np.round(32 * np.add.reduceat(v[:, c].view(np.int8) * g, first) / np.maximum(np.add.reduceat(g * g, first), 1))
        share[:, c] -= ((np.clip(k, -128, 127).astype(np.int64)[image] * g) >> 5).astype(np.uint8)
    return np.all([own <= entropies(x.view(U32).ravel(), image, n) for x in (left, green, share)], axis=0)


#: What `encode_best` chooses from, in this order among equals.
CHOICES = [(), (PALETTE,), (SUBTRACT_GREEN,), (PREDICTOR,), (PREDICTOR, SUBTRACT_GREEN), (PREDICTOR, CROSS_COLOUR), (CROSS_COLOUR,)]


def encode_best(p: np.ndarray, width: int, height: int, mode_block: int = 4) -> bytes:
    """One file with the transforms of fewest estimated bits: modes and multipliers by block, prefix codes of its own."""
    p = p.astype(U32)
    one = np.zeros(len(p), np.int64)
    blocks = ((width + (1 << mode_block) - 1) >> mode_block) * ((height + (1 << mode_block) - 1) >> mode_block)
    colours, index = np.unique(p, return_inverse=True)
    bits, done = {}, {(): (p, 0)}
    for chain in CHOICES:
        if PALETTE in chain:
            if len(colours) <= 256:
                h = np.bincount(index)
                bits[chain] = float((h * (np.log2(len(p)) - np.log2(h))).sum()) + 24 * len(colours)
            continue
        q, extra = done[chain[:-1]] if chain else done[()]  # a chain's beginning comes before it
        for kind in chain[-1:]:
            if kind == PREDICTOR:
                q, extra = predict(q, width, height, chosen_modes(q, width, height, mode_block), mode_block), extra + 4 * blocks
            elif kind == CROSS_COLOUR:
                q, extra = recolour(q, width, height, chosen_colours(q, width, height, mode_block), mode_block, False), extra + 20 * blocks
            else:
                q = add_green(q, -1)
        done[chain] = q, extra
        bits[chain] = float(entropies(q, one, 1)[0]) + extra
    best = min(bits, key=bits.get)
    return encode(p, width, height, best, 0 if PALETTE in best else 4, mode_block=mode_block, choose=True)


# -- batches -------------------------------------------------------------------------------------

CACHE = 10


def _byte_weights() -> np.ndarray:
    """Rough shares of bytes in prose in Latin letters; every byte has one."""
    w = np.full(256, 0.02)
    w[128:192], w[192:224] = 0.06, 0.05
    w[32:127] = 0.2
    for c in b"abcdefghijklmnopqrstuvwxyz":
        w[c] = 2.0
    for c in b"etaoinshrdlu":
        w[c] = 5.0
    w[32], w[195], w[10], w[255] = 14.0, 1.0, 0.3, 0.1
    return w


#: Chains of transforms of `encode_many`: a predictor mode and (red to blue, green to blue, green to red), the same in all blocks,
#: then subtract-green. The modes are those that a batch inverts by whole rows.
CHAINS = [(1, 2, 4, 6), (2, 250, 8, 3), (3, 5, 252, 16), (4, 12, 1, 248), (8, 254, 20, 2), (9, 7, 240, 9)]
WHOLE = 9  # bits of the largest block


def _residual_weights() -> np.ndarray:
    """Rough shares of the bytes that the chains leave of prose: small differences, either way, more often."""
    v = np.minimum(np.arange(256), 256 - np.arange(256))
    return 1.0 / (8.0 + v) + 0.004


class _Fixed:
    """The prefix codes that `encode_many` uses for every image of a chain, and the bits that announce chain and codes."""

    def __init__(self, chain: int | None):
        b = _byte_weights() if chain is None else _residual_weights()
        b = b / b.sum()
        green = np.concatenate([0.8 * b, np.full(LENGTH_CODES, 0.04 / LENGTH_CODES), np.full(1 << CACHE, 0.16 / (1 << CACHE))])
        self.lengths = [code_lengths(x) for x in (green, b, b, b, np.ones(DISTANCE_CODES))]
        self.codes = [canonical(x) for x in self.lengths]
        w = Writer()
        if chain is not None:
            mode, *colour = CHAINS[chain]
            for kind, (red, green_, blue) in ((PREDICTOR, (0, mode, 0)), (CROSS_COLOUR, colour)):
                w.put(1, 1)
                w.put(kind, 2)
                w.put(WHOLE - 2, 3)
                w.put(0, 1)
                for symbol in (green_, red, blue, 255, 0):  # codes of one symbol: the pixels take no bits
                    write_lengths(w, np.eye(1, 256, symbol, dtype=int)[0])
            w.put(1, 1)
            w.put(SUBTRACT_GREEN, 2)
        w.put(0, 1)
        w.put(1, 1)
        w.put(CACHE, 4)
        w.put(0, 1)
        for x in self.lengths:
            write_lengths(w, x)
        self.head, self.size = w.value, w.size


_fixed: dict[int | None, _Fixed] = {}


def fixed(chain: int | None) -> _Fixed:
    if chain not in _fixed:
        _fixed[chain] = _Fixed(chain)
    return _fixed[chain]


def _bytes(p: np.ndarray) -> np.ndarray:
    return p.view(np.uint8).reshape(-1, 4)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint16) + b) >> 1).astype(np.uint8)


def _by_rows(mode: int, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:
    """The prediction of a mode that uses no left pixel; bytes."""
    return {2: lambda: t, 3: lambda: tr, 4: lambda: tl, 8: lambda: _mean(tl, t), 9: lambda: _mean(t, tr)}[mode]()


def predict_many(p: np.ndarray, first: np.ndarray, widths: np.ndarray, heights: np.ndarray, mode: int) -> np.ndarray:
    """Residuals of images laid end to end, one mode for all."""
    n = widths * heights
    image = np.repeat(np.arange(len(n)), n)
    w = widths[image]
    at = np.arange(len(p))
    y, x = np.divmod(at - first[image], w)
    v, guess = _bytes(p), np.zeros((len(p), 4), np.uint8)
    guess[:, 3] = np.where((x == 0) & (y == 0), 255, 0)
    left, top = (x > 0) & ((y == 0) | (mode == 1)), (y > 0) & (x == 0)
    guess[left] = v[at[left] - 1]
    guess[top] = v[at[top] - w[top]]
    if mode != 1:
        i = np.flatnonzero((x > 0) & (y > 0))
        above = i - w[i]
        guess[i] = _by_rows(mode, v[above], v[above + 1], v[above - 1])
    return np.ascontiguousarray(v - guess).view(U32).ravel()


def unpredict_many(p: np.ndarray, first: np.ndarray, widths: np.ndarray, heights: np.ndarray, mode: int) -> np.ndarray:
    """What `predict_many` has taken; rows of equal number are taken back together."""
    out = _bytes(p.copy())
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        own = own[np.argsort(-heights[own], kind="stable")]
        for y in range(int(heights[own].max())):
            own = own[: np.searchsorted(-heights[own], -y)]  # those of more than y rows
            at = (first[own] + y * w)[:, None] + np.arange(w)
            row = out[at]
            if y == 0:
                row[:, 0, 3] += 255
                row = np.cumsum(row, 1, dtype=np.uint8)
            else:
                top = out[at - w]
                row[:, 0] += top[:, 0]
                if mode == 1:
                    row = np.cumsum(row, 1, dtype=np.uint8)
                else:
                    row[:, 1:] += _by_rows(mode, top[:, 1:], np.concatenate([top[:, 2:], row[:, :1]], 1), top[:, :-1])
            out[at] = row
    return out.view(U32).ravel()


def encode_many(pixels: np.ndarray, first: np.ndarray, widths: np.ndarray, heights: np.ndarray, chain: int | None = None) -> list[bytes]:
    """Files of images laid end to end; `first`: where each starts; none is empty; `chain`: of CHAINS, or no transform."""
    f = fixed(chain)
    if chain is not None:
        mode, *colour = CHAINS[chain]
        pixels = predict_many(pixels, first, widths, heights, mode)
        pixels = add_green(recoloured(pixels, (255, *colour), False), -1)
    place, kind, size, code, slot, image = tokens(pixels, first, widths, CACHE)
    value, bits = _fields(pixels, place, kind, size, code, slot, f.lengths, f.codes)
    head = 40 + f.size
    total = np.bincount(image, bits, len(first)).astype(np.int64) + head
    base = np.concatenate([[0], np.cumsum((total >> 6) + 2)]) * 64
    ends = np.cumsum(bits)
    begin = np.nonzero(np.append(True, image[1:] != image[:-1]))[0]
    at = ends - bits - (ends - bits)[begin][image] + base[:-1][image] + head
    words = np.zeros(int(base[-1] >> 6) + 2, U64)
    place_bits(words, at, value)
    lead = (f.head << 40).to_bytes((head + 63) // 64 * 8, "little")
    lead = np.frombuffer(lead, U64)
    w0 = base[:-1] >> 6
    for k, x in enumerate(lead):
        words[w0 + k] |= x
    sizes = U64(0x2F) | (widths - 1).astype(U64) << U64(8) | (heights - 1).astype(U64) << U64(22) | U64(1 << 36)
    words[w0] |= sizes
    raw = words.tobytes()
    return [wrap(raw[a : a + n]) for a, n in zip((w0 * 8).tolist(), ((total + 7) // 8).tolist())]


class _Head:
    """What follows the size in a stream without prefix groups, for streams that begin alike. Transforms may be predictors that
    are taken back by whole rows and colour transforms, each the same in all blocks."""

    def __init__(self, chunk: bytes):
        bits = Bits(chunk, 40)
        self.steps, self.ok = [], True
        while self.ok and bits.read(1):
            kind, value = bits.read(2), 0
            self.ok = kind != PALETTE
            if kind in (PREDICTOR, CROSS_COLOUR):
                bits.read(3)
                self.ok = not bits.read(1)
                codes = read_groups(bits, 1, 0)[0] if self.ok else []
                self.ok = self.ok and not any(c.bits for c in codes[:4]) and all(c.quick[0] >> 4 < 256 for c in codes[:4])
                value = [c.quick[0] >> 4 for c in codes[:3]]  # green, red, blue
                self.ok = self.ok and (kind != PREDICTOR or value[0] in (1, 2, 3, 4, 8, 9))
            self.steps.append((kind, value))
        if self.ok:
            self.cache_bits = _cache_bits(bits)
            self.ok = not bits.read(1)
        if self.ok:
            self.groups = read_groups(bits, 1, self.cache_bits)
            self.end = bits.pos
            whole = self.end >> 3
            mask = (1 << (self.end & 7)) - 1
            self.bytes, self.rest = chunk[5:whole], (whole, mask, (chunk[whole : whole + 1] or b"\0")[0] & mask)
            if sum(g.bits for g in self.groups[0][:4]) > 60:
                self.ok = False

    def fits(self, chunk: bytes) -> bool:
        at, mask, v = self.rest
        return chunk[5:at] == self.bytes and ((chunk[at : at + 1] or b"\0")[0] & mask) == v


_heads: list[_Head] = []


def decode_many(files: list[bytes], few: int = 16) -> list[tuple[int, int, np.ndarray]]:
    """`decode` of every file; files that begin with equal code tables are read together."""
    out: list = [None] * len(files)
    alike: dict[int, list] = {}
    chunks = [unwrap(x) for x in files]
    for i, c in enumerate(chunks):
        h = next((x for x in _heads if x.fits(c)), None)
        if h is None:
            h = _Head(c) if c[0] == 0x2F and not int.from_bytes(c[1:5], "little") >> 29 else None
            if h is None or not h.ok:
                out[i] = decode(files[i])
                continue
            _heads[:] = [*_heads, h][-8:]
        alike.setdefault(id(h), [h]).append(i)
    for h, *members in alike.values():
        for i, got in zip(members, _together(h, [chunks[i] for i in members], few)):
            out[i] = got
    return out


def _taken_back(p: np.ndarray, steps: list, first: np.ndarray, widths: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """The inverse of a head's transforms, over images laid end to end."""
    for kind, value in reversed(steps):
        if kind == PREDICTOR:
            p = unpredict_many(p, first, widths, heights, value[0])
        elif kind == CROSS_COLOUR:
            p = recoloured(p, (255, value[1], value[0], value[2]), True)
        else:
            p = add_green(p, 1)
    return p


def _together(h: _Head, chunks: list[bytes], few: int) -> list[tuple[int, int, np.ndarray]]:
    size = [int.from_bytes(c[1:5], "little") for c in chunks]
    w, hgt = np.array([(x & 16383) + 1 for x in size]), np.array([((x >> 14) & 16383) + 1 for x in size])
    n = w * hgt
    first = np.concatenate([[0], np.cumsum(n)])
    pad = [-len(c) % 8 + 16 for c in chunks]
    start = np.concatenate([[0], np.cumsum([len(c) + k for c, k in zip(chunks, pad)])[:-1]]) * 8
    words = np.frombuffer(b"".join(c + bytes(k) for c, k in zip(chunks, pad)), U64)
    limit = start + np.array([8 * len(c) for c in chunks])
    out = np.zeros(int(first[-1]), U32)
    g, r, b, a, d = h.groups[0]
    tables, masks = [x.table for x in (g, r, b, a)], [U64(x.mask) for x in (g, r, b, a)]
    cb = h.cache_bits
    cache = np.zeros((len(chunks), 1 << cb), U32) if cb else None
    slot_of = lambda p: ((p * U32(CACHE_MULTIPLIER)) >> U32(32 - cb)).astype(np.int64)
    row = np.argsort(-n, kind="stable")
    pos, at, end = start[row] + h.end, first[:-1][row].copy(), first[1:][row]
    while len(row) >= few:
        k, s = pos >> 6, (pos & 63).astype(U64)
        v = (words[k] >> s) | ((words[k + 1] << U64(1)) << (U64(63) - s))
        e = tables[0][v & masks[0]]
        sym, used = e >> 4, e & 15
        first_used = used
        v = v >> (e & 15).astype(U64)
        parts = []
        for i in (1, 2, 3):
            e = tables[i][v & masks[i]]
            parts.append(e >> 4)
            v = v >> (e & 15).astype(U64)
            used = used + (e & 15)
        p = (parts[2] << 24 | parts[0] << 16 | sym << 8 | parts[1]).astype(U32)
        odd = np.nonzero(sym >= 256)[0]
        step = np.ones(len(row), np.int64)
        if len(odd):
            used[odd] = first_used[odd]
            hit = odd[sym[odd] >= 256 + LENGTH_CODES]
            if len(hit):
                p[hit] = cache[row[hit], sym[hit] - 256 - LENGTH_CODES]
        out[at] = p
        copies = odd[sym[odd] < 256 + LENGTH_CODES]
        if cb:
            if len(copies):
                own = np.ones(len(row), bool)
                own[copies] = False
                cache[row[own], slot_of(p[own])] = p[own]
            else:
                cache[row, slot_of(p)] = p
        if len(copies):
            for i in copies.tolist():
                j = int(row[i])
                bits = Bits(chunks[j], int(pos[i] - start[j] + first_used[i]))
                length = _prefixed(bits, int(sym[i]) - 256)
                dist = plane_distance(_prefixed(bits, d.read(bits)), int(w[j]))
                o = int(at[i])
                if o - dist < first[j] or o + length > end[i]:
                    raise ValueError("back-reference outside the image")
                new = out[o - dist : o - dist + length].copy() if dist >= length else np.resize(out[o - dist : o], length)
                out[o : o + length] = new
                used[i], step[i] = bits.pos + start[j] - pos[i], length
                if cb:
                    cache[j, slot_of(new)] = new
        pos = pos + used
        at = at + step
        live = at < end
        if not live.all():
            done = row[~live]
            if (pos[~live] > limit[done]).any():
                raise ValueError("truncated stream")
            row, pos, at, end = row[live], pos[live], at[live], end[live]
    for j, q, o, z in zip(row.tolist(), pos.tolist(), at.tolist(), end.tolist()):
        f = int(first[j])
        bits = Bits(chunks[j], q - int(start[j]))
        out[f:z] = read_pixels(bits, int(w[j]), z - f, h.groups, cb, out=out[f:o].tolist(), cache=cache[j].tolist() if cb else None)
    out = _taken_back(out, h.steps, first[:-1], w, hgt)
    return [(int(x), int(y), out[i:j]) for x, y, i, j in zip(w, hgt, first[:-1], first[1:])]

