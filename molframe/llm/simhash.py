"""SimHash near-duplicates by anchor-point covering, and connected components of the links.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit in their upper or lower
half. In each half the anchors are the words of a covering code, one free bit times the Hamming code
of length 31, whose covering radius is 1. A fingerprint has its home at its nearest anchor and visits
every anchor within covering radius + threshold = 2 of its half (17 at most). If two halves differ in
at most 1 bit, each visits the home of the other, so comparing homes with visitors per anchor finds
every link. Per anchor only a spanning forest of the links found is emitted, at most one link a
member, so a group of copies never yields all its pairs. Anchors of more than CELL members are split
into cells of two slices each; every two members still share a cell.

`similar` finds texts by Jaccard similarity of their five-word shingles instead (0.8 or more), in two steps.
First, groups: a wider fingerprint of word pairs, WORDS words of 32 bits, visits the anchors within covering
radius + 1 of each word. Two texts whose words number j differ in at most 2 bits have a common anchor, as the
point between them has its home there. Members of an anchor within NEAR bits are linked by a spanning
forest, so a group is a set of texts that may be alike. Then the sets of shingles of a group meet and are
compared exactly, again up to a spanning forest. No pair is emitted before it is verified. The
fingerprint only loses links and never makes one.

Anchors and groups of more than a cell are met in two rounds: slices that share a few hubs; then, where
components are left apart, every member outside of the largest one with every member, in cells of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import cut, lean, only, table

THRESHOLD = 3
SHINGLE = 3
CELL = 4096
HOT_SHARE, SALTS = 1000, 32
_ROWS = 1 << 14

#: `similar`: shingle widths of the search and of the check, 32-bit words of the fingerprint, the bits of the first
#: 128 and of all 256 that may differ.
PAIR, SHINGLES, WORDS, NEAR = 2, 5, 8, (26, 46)
#: Runs compared pair by pair, hubs of a crowded key, shingles that a cell may hold, texts that a
#: task places, words whose anchors come first.
SMALL, HUBS, CELL_SHINGLES, PLACED_ROWS, FIRST = 16, 32, 1 << 21, 20_000, 2
MOST_BROADCAST = 1_000_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Fingerprint of one text: A-Z lower-cased, words split at ASCII white space, `width`-word shingles
    with repeats (the whole sequence if shorter), XXH64 seed 42; a bit is set if in over half of the hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    flat, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return h(flat, 42)
    total, n, got = np.zeros(64, np.int64), len(words) - width + 1, None
    for i in range(0, n, _ROWS):
        got = np.array([h(flat[a:b], 42) for a, b in zip(starts[i : min(n, i + _ROWS)], ends[i + width - 1 : i + _ROWS + width - 1])], "<u8")
        total += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long). Null, empty and blank texts: 0."""
    lean(df.sparkSession)
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))

    def run(batches):
        only("simhash")
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["i", "fp"])

    return rows.mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, fp long").select(F.col("i").alias(id_col), "fp")


def syndrome(x: np.ndarray) -> np.ndarray:
    """XOR of the positions (1 to 31) of the set bits among the low 31: 0 for a code word."""
    s = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        s |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << k
    return s


_PAIRS = np.array([[(1 << (i - 1)) | (1 << (j - 1)) for i in range(1, 32) for j in [i ^ s] if i < j <= 31 and j] if s else [0] * 15 for s in range(32)], np.int64)


def covered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into x, anchor, is home) of every anchor within 2 bits of the 32-bit words x."""
    every = np.arange(len(x))
    low, free = x & 0x7FFFFFFF, x & 0x80000000
    s = syndrome(low)
    near = np.where(s > 0, low ^ np.left_shift(1, np.maximum(s, 1) - 1), low)
    off = np.nonzero(s)[0]
    index = [every, every, np.repeat(off, _PAIRS.shape[1])]
    keys = [near | free, near | (free ^ 0x80000000), ((low[off, None] ^ _PAIRS[s[off]]) | free[off, None]).ravel()]
    home = [np.full(len(k), i == 0) for i, k in enumerate(keys)]
    return np.concatenate(index), np.concatenate(keys), np.concatenate(home)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index into fp, anchor key, is home) of every anchor that a fingerprint visits, in both halves."""
    halves = [covered((fp.view(np.uint64) >> np.uint64(32 * h)).astype(np.int64) & 0xFFFFFFFF) for h in (0, 1)]
    return tuple(np.concatenate(x) for x in zip(*[(i, k | h << 32, home) for h, (i, k, home) in enumerate(halves)]))


def forest(members: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span the components of one anchor's home-visitor links; at most len(members) - 1."""
    label = np.arange(len(members))
    a, b = [], []
    x = members.view(np.uint64)
    for i in np.nonzero(home)[0]:
        near = np.nonzero(np.bitwise_count(x ^ x[i]) <= threshold)[0]
        for other in np.unique(label[near]):
            if other != label[i]:
                at = near[label[near] == other][0]
                a.append(members[i])
                b.append(members[at])
                label[label == other] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def link_runs(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int = THRESHOLD, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal `key`: pair by pair in short runs, a spanning forest in longer ones."""
    if len(key) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.nonzero(new)[0]
    length = np.diff(np.append(start, len(key)))
    short = np.repeat(length <= small, length)
    out_a, out_b = [], []
    for d in range(1, int(min(small, length.max()))):
        i = np.nonzero((key[d:] == key[:-d]) & short[d:] & (home[d:] | home[:-d]))[0]
        if len(i) == 0 and not (key[d:] == key[:-d]).any():
            break
        i = i[np.bitwise_count(fp[i].view(np.uint64) ^ fp[i + d].view(np.uint64)) <= threshold]
        out_a.append(fp[i])
        out_b.append(fp[i + d])
    for s, n in zip(start[length > small], length[length > small]):
        a, b = forest(fp[s : s + n], home[s : s + n], threshold)
        out_a.append(a)
        out_b.append(b)
    return np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])


def whole_runs(batches, columns: int, keys: int = 1):
    """The columns of sorted batches as arrays, cut only where one of the first `keys` changes."""
    kept = None
    for batch in batches:
        here = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if kept is not None:
            here = [np.concatenate(x) for x in zip(kept, here)]
        if len(here[0]) == 0:
            continue
        other = np.flatnonzero(np.any([x != x[-1] for x in here[:keys]], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        kept = [x[last:] for x in here]
        if last:
            yield [x[:last] for x in here]
    if kept is not None:
        yield kept


def links(fps: DataFrame, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """(a, b) links between distinct fingerprints `fp` that span every component of the link graph."""
    if threshold > 3:
        raise ValueError("the halves cover thresholds up to 3")

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fp), _ROWS):
                part = fp[i : i + _ROWS]
                k, key, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[k]), pa.array(home)], ["key", "fp", "home"])

    placed = fps.select("fp").mapInArrow(spread, "key long, fp long, home boolean")
    hot = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell))
    if hot.isEmpty():
        cells = placed.withColumn("cell", F.lit(0))
    else:
        slot = F.pmod(F.xxhash64("fp", F.lit("cell")), F.col("parts")).cast("int")
        parts = placed.join(hot.select("key", F.ceil(F.col("n") * 2 / cell).cast("int").alias("parts")), "key", "left")
        parts = parts.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("slot", slot)
        to = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("slot")) * F.col("parts") + F.greatest(j, F.col("slot")))
        cells = parts.select("key", "fp", "home", F.explode(to).alias("cell"))

    def compare(batches):
        for here in whole_runs(batches, 4, 2):
            yield from found(here)

    def found(here):
        key, c, fp, home = here
        if len(key):
            run = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (c[1:] != c[:-1])))
            a, b = link_runs(run, fp, home.astype(bool), threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    ordered = cells.select("key", "cell", "fp", "home").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges(a, b)`; root is the smallest node reachable.

    Alternating large-star and small-star steps, the lineage cut after each; the number of steps grows
    with the logarithm of the largest component. Minima are pre-aggregated before the shuffle and the
    joins back to them are plain equi-joins that adaptive execution can split."""
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = e.groupBy("v").agg(F.min("u").alias("m"))
        e = e.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")), F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return e.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        seen = now
    raise RuntimeError("components did not settle")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(id_col, fp, component_id) for every row: component_id is the smallest id reachable over links.

    Rows with equal fingerprints are one node, so copies never pair up. Blank and null texts share
    fingerprint 0 and link like any other. A null id gets a component from the other ids of its
    group, null if it has none. Repeated rows each get a row; an empty table gives none."""
    fps = cut(fingerprints(df, id_col, text_col).select(F.col(id_col).alias("id"), "fp"))
    counted = cut(fps.groupBy("fp").agg(F.min("id").alias("m"), F.count("*").alias("n")).withColumn("node", F.col("fp")))
    return _labelled(fps, counted, components(links(counted.select("fp"), threshold)), ["fp"]).withColumnRenamed("id", id_col)


def _labelled(rows: DataFrame, counted: DataFrame, comp: DataFrame, keys: list[str]) -> DataFrame:
    """(id, keys, component_id) of every row of rows(id, keys): counted(keys, node, m, n) has the smallest id and number of rows
    of each node. Rows of a component's root meet its name in a plain equi-join that adaptive execution splits."""
    nodes = counted.select(*keys, "node", "m")
    named = comp.join(nodes, "node").select("node", "m", "root")
    best = named.groupBy("root").agg(F.min("m").alias("c"))
    moved = named.join(best, "root").select("node", "c")
    ids = nodes.join(moved, "node", "left").select(*keys, F.coalesce("c", "m").alias("component_id"))
    # nodes of over a HOT_SHARE-th of all rows, so fewer than HOT_SHARE of them, are dealt over SALTS tasks
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counted.where(F.col("n") * HOT_SHARE > total).select(*keys, F.lit(True).alias("hot")))
    salted = ids.join(hot, keys, "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    dealt = rows.join(hot, keys, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int")).drop("hot")
    return dealt.join(salted, [*keys, "salt"]).select("id", *keys, "component_id")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the `width`-word shingles, repeats included; the whole sequence if shorter, none without a word."""
    h = np.array([xxhash.xxh64_intdigest(w, 42) for w in text.lower().split()], np.uint64)
    n = len(h) - width + 1 if len(h) >= width else min(1, len(h))
    x = np.zeros(n, np.uint64)
    for j in range(min(width, len(h))):
        x = _mixed(x * np.uint64(3) + h[j : j + n])
    return x


def wide_fingerprint(text: bytes) -> np.ndarray:
    """WORDS / 2 unsigned longs; a bit is set if in over half of the word pairs' hashes. Blank: zero."""
    x = shingle_hashes(text, PAIR)
    total = np.zeros(32 * WORDS, np.int64)
    lanes = np.arange(1, WORDS // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(x), _ROWS):
        bits = np.unpackbits(_mixed(x[i : i + _ROWS, None] + lanes).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        even = len(bits) // 255 * 255  # as many as a byte can count
        total += bits[:even].reshape(-1, 255, 32 * WORDS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[even:].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(x), bitorder="little").view("<u8")


def alike(one: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Of each of `others`: whether its Jaccard similarity with `one` is `least` or more; all are sorted sets, two empty ones are alike."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    if len(one) == 0:
        return size == 0
    flat = np.concatenate([*others, one[:0]])
    there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(size)])])
    return common >= least * (size + len(one) - common)


def spanning(f: np.ndarray, near: int, sets: list[np.ndarray] | None = None, least: float = 0.0, root: np.ndarray | None = None, light: np.ndarray | None = None):
    """Links (i, j) that join all of one run's members that belong together, fewer than there are members.

    f: a row of longs for each member; two are near within `near` bits of them, and alike if their sets are.
    Members of equal `root` are joined already. Of two that are both not `light`, the comparison is left out.
    A member that has been reached is compared only with those not reached yet, so the members of a dense
    group are compared a few times each; nothing that is near and not joined is left uncompared."""
    n = len(f)
    root = np.arange(n) if root is None else root
    rest = np.arange(n)
    a, b = [], []
    while len(rest):
        own = root[rest] == root[rest[0]]
        todo, rest = list(rest[own]), rest[~own]
        while todo and len(rest):
            x = todo.pop()
            to = rest if light is None or light[x] else rest[light[rest]]
            hit = to[np.bitwise_count(f[to] ^ f[x]).sum(1, dtype=np.int32) <= near]
            if sets is not None and len(hit):
                step = max(1, (1 << 20) // (1 + max(len(sets[j]) for j in hit)))
                hit = np.concatenate([hit[i : i + step][alike(sets[x], [sets[j] for j in hit[i : i + step]], least)] for i in range(0, len(hit), step)])
            if len(hit):
                _, first = np.unique(root[hit], return_index=True)
                a += [x] * len(first)
                b += list(hit[first])
                new = np.isin(root[rest], root[hit])
                todo += list(rest[new])
                rest = rest[~new]
    return np.array(a, np.int64), np.array(b, np.int64)


def short_and_long(key: np.ndarray, k: np.ndarray, f: np.ndarray, near: int, root: np.ndarray, light: np.ndarray | None = None):
    """Links (least root, root) of what belongs together in runs of equal `key`; see `spanning`.

    Each links to the least one, so the same links come from the many keys that near members share. Short runs, of up
    to SMALL members, are compared all at once."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(key)))
    short = np.repeat(length <= SMALL, length)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(min(SMALL, length.max()))):
        at = np.flatnonzero((key[d:] == key[:-d]) & short[d:] & (root[d:] != root[:-d]))
        if light is not None:
            at = at[light[at] | light[at + d]]
        at = at[np.bitwise_count(f[at] ^ f[at + d]).sum(1, dtype=np.int32) <= near]
        i.append(at)
        j.append(at + d)
    for s, n in zip(start[length > SMALL], length[length > SMALL]):
        kk, once = np.unique(k[s : s + n], return_index=True)
        at = s + once
        x, y = spanning(f[at], near, None, 0.0, root[at], None if light is None else np.isin(kk, k[s : s + n][light[s : s + n]]))
        i.append(at[x])
        j.append(at[y])
    ends, both = np.unique(root[np.concatenate([*i, *j])], return_inverse=True)
    x, y = both.reshape(2, -1)
    # roots are joined within a run only: a root of several runs is a node of each
    runs = np.cumsum(np.append(False, key[1:] != key[:-1]))[np.concatenate(i)]
    nodes, both = np.unique(np.concatenate([runs, runs]) * (len(ends) + 1) + both, return_inverse=True)
    x, y = both.reshape(2, -1)
    own = nodes % (len(ends) + 1)
    least = own.copy()
    while len(x):  # as often as the longest way to a least root
        before = least.copy()
        m = np.minimum(least[x], least[y])
        np.minimum.at(least, x, m)
        np.minimum.at(least, y, m)
        if (least == before).all():
            break
    moved = np.flatnonzero(least != own)
    return ends[least[moved]], ends[own[moved]]


def _slot(parts: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("k", F.lit(salt)), parts).cast("long")


def first_cells(members: DataFrame, hot: DataFrame) -> DataFrame:
    """`members` with their cell. Keys of hot(key, n, parts) are dealt over `parts` cells, and about HUBS of their members are in all of them."""
    got = members.join(hot, "key", "left")
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    to = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).when(F.pmod(F.xxhash64("k", F.lit("hub")), F.col("n")) < HUBS, every).otherwise(F.array(_slot(F.col("parts"), "slice")))
    return got.select(*members.columns, F.explode(to).alias("cell"))


def second_cells(members: DataFrame, hot: DataFrame, comp: DataFrame) -> DataFrame:
    """The members of hot keys that are not all joined by comp(node, root), with `root`, `light` and the cell.

    Light are those outside of the key's largest component; each of them shares a cell with every member of its key."""
    here = members.join(F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot, "key").drop("n")
    here = here.join(comp, F.col("k") == F.col("node"), "left").withColumn("root", F.coalesce("root", "k")).drop("node")
    shares = cut(here.groupBy("key", "root", "parts").agg(F.count("*").alias("n")))
    main = shares.groupBy("key", "parts").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    halves = 2 * F.col("parts")
    main = main.select("key", "main", halves.alias("every"), F.greatest(F.lit(1), F.ceil(halves * (F.col("n") - F.col("most")) / F.col("n"))).cast("long").alias("few"))
    got = here.drop("parts").join(main, "key").withColumn("light", F.col("root") != F.col("main"))
    across = F.transform(F.sequence(F.lit(0).cast("long"), F.col("few") - 1), lambda i: F.struct(F.lit(False).alias("light"), (i * F.col("every") + _slot(F.col("every"), "all")).alias("cell")))
    along = F.transform(F.sequence(F.lit(0).cast("long"), F.col("every") - 1), lambda j: F.struct(F.lit(True).alias("light"), (_slot(F.col("few"), "light") * F.col("every") + j).alias("cell")))
    to = F.when(F.col("light"), F.concat(across, along)).otherwise(across)
    return got.select(*members.columns, "root", F.explode(to).alias("z")).select(*members.columns, "root", "z.light", "z.cell")


def candidate_groups(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """(node, root) of the nodes(node, f0, f1, ...) that have another in their group: texts of one group are joined by steps
    of at most NEAR[0] of the first 128 bits between two that visit one anchor.

    The anchors of the first words come first; at those of the others only what they have left apart is compared."""
    longs = [f"f{i}" for i in range(WORDS // 2)]

    def links_in(cells: DataFrame, *more: str) -> DataFrame:
        def compare(batches):
            for key, k, root, f0, f1, *light in whole_runs(batches, 5 + len(more)):
                a, b = short_and_long(key, k, np.stack([f0, f1], 1).view(np.uint64), NEAR[0], root, *(x.astype(bool) for x in light))
                for i in range(0, len(a), _ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(a[i : i + _ROWS]), pa.array(b[i : i + _ROWS])], ["a", "b"])

        # a key has 35 bits; two cells of it that meet in the upper 28 are only compared more
        one = cells.select((F.col("key") + F.shiftleft(F.col("cell").bitwiseAND((1 << 28) - 1), 35)).alias("key"), "k", "root", "f0", "f1", *more)
        return one.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()

    def visits(words: range, at: DataFrame) -> DataFrame:
        def spread(batches):
            for batch in batches:
                k, root, *f = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2 + WORDS // 2))
                for w in words:
                    i, key, _ = covered((f[w // 2].view(np.uint64) >> np.uint64(32 * (w % 2))).astype(np.int64) & 0xFFFFFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array(key | w << 32), *[pa.array(x[i]) for x in (k, root, f[0], f[1])]], ["key", "k", "root", "f0", "f1"])

        return at.repartition(max(1, n // PLACED_ROWS)).mapInArrow(spread, "key long, k long, root long, f0 long, f1 long")

    n, comp = nodes.count(), None
    for words in (range(FIRST), range(FIRST, WORDS)):
        if comp is None:
            at = nodes.select("node", F.col("node").alias("root"), *longs)
        else:
            at = nodes.join(comp, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *longs)
        placed = visits(words, at)
        hot = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).withColumn("parts", F.ceil(F.col("n") / cell)))
        crowded = not hot.isEmpty()
        comp = _joined(comp, links_in(first_cells(placed, hot) if crowded else placed.withColumn("cell", F.lit(0).cast("long"))))
        if crowded:
            comp = _joined(comp, links_in(second_cells(placed.drop("root"), hot, comp), "light"))
    return comp


def _joined(comp: DataFrame | None, more: DataFrame) -> DataFrame:
    """The components of comp(node, root) after the links more(a, b) between its roots and nodes that it does not have."""
    if comp is None:
        return cut(components(more))
    more = cut(more)
    if more.isEmpty():
        return comp
    to = cut(components(more)).select(F.col("node").alias("n"), F.col("root").alias("r"))
    moved = comp.join(to, F.col("root") == F.col("n"), "left").select("node", F.coalesce("r", "root").alias("root"))
    return cut(moved.unionByName(to.join(comp, F.col("n") == F.col("node"), "left_anti").select(F.col("n").alias("node"), F.col("r").alias("root"))))


def checked_groups(members: DataFrame, texts: DataFrame, least: float, cell: int = CELL) -> DataFrame:
    """(node, root) of the texts that are alike by `least` or more, within the groups of
    members(key, k, h1, h2, m, size, f0, f1, ...); texts(id, h1, h2, t) hold the text of a member where id, h1 and h2 are its own."""
    longs = [f"f{i}" for i in range(WORDS // 2)]
    few = members.count() <= MOST_BROADCAST
    same = (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & F.col("x.id").eqNullSafe(F.col("y.m"))
    rows = texts.alias("x").join((F.broadcast(members) if few else members).alias("y"), same).select("y.key", "y.k", *[f"y.{c}" for c in longs], "x.t")

    def shingled(batches):
        only("simhash")
        for batch in batches:
            got = [np.unique(shingle_hashes(x.as_py().encode(), SHINGLES)).tobytes() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.binary())], ["key", "k", *longs, "set"])

    made = rows.mapInArrow(shingled, ", ".join(f"{c} long" for c in ("key", "k", *longs)) + ", set binary").dropDuplicates(["k"])

    def compare(tab: pa.Table) -> pa.Table:
        col = {c: tab.column(c).to_numpy() for c in tab.column_names if c != "set"}
        k, once = np.unique(col["k"], return_index=True)
        f = np.stack([col[c][once] for c in longs], 1).view(np.uint64)
        held = tab.column("set").combine_chunks()
        sets = [np.frombuffer(held[int(i)].as_py(), np.uint64) for i in once]
        light = np.isin(k, col["k"][col["light"].astype(bool)]) if "light" in col else None
        root = col["root"][once] if "root" in col else k
        a, b = spanning(f, NEAR[1], sets, least, root, light)
        return pa.table({"a": root[a], "b": root[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    links_in = lambda cells: cells.groupBy("key", "cell").applyInArrow(compare, "a long, b long").distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    parts = F.ceil(F.greatest(F.col("n") / cell, F.col("s") / CELL_SHINGLES))
    hot = cut(sizes.withColumn("parts", parts).where("parts > 1").select("key", "n", "parts"))
    if hot.isEmpty():
        return components(links_in(made.withColumn("cell", F.lit(0).cast("long"))))
    made = cut(made)
    comp = _joined(None, links_in(first_cells(made, hot)))
    return _joined(comp, links_in(second_cells(made, hot, comp)))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, cell: int = CELL) -> DataFrame:
    """(id_col, component_id) for every row: component_id is the smallest id reachable over texts whose sets of
    five-word shingles have a Jaccard similarity of `least` or more (A-Z lower-cased; shorter texts: one shingle).

    Equal texts (equal in two 64-bit hashes) are one node. Null, empty and blank texts are alike. A null id gets a
    component from the other ids of its group, null if it has none. Repeated rows each get a row; an empty
    table gives none. Further columns are not used. Very long texts are hashed whole; a group is cut by the shingles that it holds."""
    lean(df.sparkSession)
    longs = [f"f{i}" for i in range(WORDS // 2)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("identity"), text).alias("h2"), text.alias("t"))

    def run(batches):
        only("simhash")
        for batch in batches:
            got = [x.as_py().encode() for x in batch.column(3)]
            f = np.array([wide_fingerprint(x) for x in got], np.uint64).reshape(-1, WORDS // 2)
            size = np.array([x.count(b" ") + x.count(b"\n") + 1 for x in got], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), *[pa.array(f[:, i].copy().view(np.int64)) for i in range(WORDS // 2)]], ["id", "h1", "h2", "size", *longs])

    kind = rows.schema["id"].dataType.simpleString()
    fps = cut(rows.mapInArrow(run, f"id {kind}, h1 long, h2 long, size long, " + ", ".join(f"{c} long" for c in longs)))
    counted = fps.groupBy("h1", "h2").agg(F.min("id").alias("m"), F.count("*").alias("n"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in longs])
    counted = cut(counted.withColumn("node", F.monotonically_increasing_id()))  # read from the checkpoint only, so a number stays
    near = candidate_groups(counted, cell)
    members = counted.join(near, "node").select(F.col("root").alias("key"), F.col("node").alias("k"), "h1", "h2", "m", "size", *longs)
    comp = checked_groups(cut(members), rows, least, cell)
    return _labelled(fps.select("id", "h1", "h2"), counted.select("h1", "h2", "node", "m", "n"), comp, ["h1", "h2"]).select(F.col("id").alias(id_col), "component_id")


def op6(spark, sf_dir) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
