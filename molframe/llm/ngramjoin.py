"""N-gram Jaccard self-join of whole texts by count vectors and R-trees.

A text is the set of its 3-word shingles. Shingles are hashed into groups, and the numbers of a set's shingles by group are its count
vector, a point. The sum over groups of the smaller coordinate of two points is no less than the overlap of the sets, so a pair whose sum is
under what the threshold asks for is no link, and neither is any pair of a point and a box of an R-tree whose upper corner has too low a sum.

One tree does not fit a machine, so its top level is a directory that Spark holds as a key. Sets are put into classes of similar size.
Within a class at most L shingles of two linked sets are not common, so if the groups are dealt over L + 1 blocks, one block of the count vectors
is equal in both. A box of the directory is a block with given counts (groups so fine that counts tell the contents), and a set stands in the box of each of
its blocks, as in a tree whose boxes overlap. Boxes with one member need no comparison. In larger classes there are 2 e blocks more
and each set leaves out its e emptiest ones; one equal block that neither leaves out remains. Sets next to the border of a class are put into the next one too.

Below the directory every box has an R-tree of coarse count vectors, packed by halving at the widest coordinate. What passes the bound is
joined to groups by spanning forests, no pair is emitted; then the sets of a group meet, once, and are verified exactly behind trees of finer vectors, again
up to a forest. Equal sets are one node throughout. Boxes and groups larger than a cell are met in the two rounds that `simhash` describes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molframe.llm.common import cut, lean, only, slices, table, text_buffers
from molframe.llm.phrases import _LOWER, MULTIPLIERS, hashes
from molframe.llm.simhash import CELL, CELL_SHINGLES, MOST_BROADCAST, _joined, _labelled, _mixed, components, first_cells, second_cells, whole_runs

WIDTH, PERCENT = 3, 90
#: Bytes of text hashed at once; runs compared pair by pair; rows of a batch that goes out.
SLICE, SMALL, _ROWS = 4 << 20, 16, 1 << 14
#: Children of a leaf and of an inner box.
LEAF, FAN = 16, 8
#: Least number of groups of a count vector, and shingles for each group of larger ones.
GROUPS, PER_GROUP = 64, 16


def _starts(most: int = 1 << 44) -> np.ndarray:
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, out[-1] * 7 // 5))
    return np.array(out, np.int64)


#: The least size of each class.
STARTS = _starts()


def layout(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(blocks, blocks left out) of each class: linked sets of sizes up to M differ in at most L = 2 M (100 - p) / (100 + p) shingles."""
    differ = (2 * (100 - percent) * (STARTS[1:] - 1)) // (100 + percent)
    spare = np.where(differ < 8, 0, np.where(differ < 20, 1, np.where(differ < 40, 2, 3)))
    return differ + 1 + 2 * spare, spare


def sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles of every text; a text of fewer words has its whole sequence as one, a blank one none."""
    lower = _LOWER[data]
    word = ~((data == 32) | (data >= 9) & (data <= 13))
    first, last = word.copy(), word.copy()
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[1:] &= ~word[:-1]
    first[inner] |= word[inner]
    last[:-1] &= ~word[1:]
    last[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = hashes(lower, start, end, MULTIPLIERS[0])
    at = np.searchsorted(start, offsets)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        n = j - i - width + 1 if j - i >= width else min(1, j - i)
        x = np.zeros(n, np.uint64)
        for k in range(min(width, j - i)):
            x = _mixed(x * np.uint64(3) + h[i + k : i + k + n])
        out.append(np.unique(x))
    return out


def counts(of: list[np.ndarray], groups: int) -> np.ndarray:
    """The count vectors of sets, a row each; the group of a shingle is its lowest bits, so halves of a vector add up to the vector of half as many groups."""
    own = np.repeat(np.arange(len(of)), [len(x) for x in of])
    flat = np.concatenate([*of, np.zeros(0, np.uint64)])
    return np.bincount(own * groups + (flat & np.uint64(groups - 1)).astype(np.int64), minlength=len(of) * groups).reshape(len(of), groups).astype(np.int32)


def groups_for(size: int) -> int:
    return max(GROUPS, 1 << max(0, (int(size) // PER_GROUP - 1)).bit_length())


def packed_counts(of: list[np.ndarray]) -> list[bytes]:
    """Coarse count vectors of GROUPS groups, in the least unsigned type that holds a set's size."""
    return [row.astype(f"<u{_bytes(len(x))}").tobytes() for x, row in zip(of, counts(of, GROUPS))]


def _bytes(size: int) -> int:
    return 1 if size < 1 << 8 else 2 if size < 1 << 16 else 4


def unpacked(size: np.ndarray, blobs: np.ndarray) -> np.ndarray:
    out = np.zeros((len(blobs), GROUPS), np.int32)
    for b, (low, high) in {1: (0, 1 << 8), 2: (1 << 8, 1 << 16), 4: (1 << 16, 1 << 62)}.items():
        at = np.flatnonzero((size >= low) & (size < high))
        if len(at):
            out[at] = np.frombuffer(b"".join(blobs[at]), f"<u{b}").reshape(len(at), GROUPS)
    return out


def boxes(of: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """The directory boxes of every set: a key for each block of its class, and of the further classes that a linked set may have."""
    size = np.array([len(x) for x in of], np.int64)
    blocks, spare = layout(percent)
    flat = np.concatenate([*of, np.zeros(0, np.uint64)])
    weight = _mixed(flat)
    high = flat >> np.uint64(32)
    own = np.searchsorted(STARTS, size, "right") - 1
    top = np.searchsorted(STARTS, 100 * size // percent, "right") - 1
    found: list[list[np.ndarray]] = [[] for _ in of]
    for step in range(int((top - own).max(initial=-1)) + 1):
        on = (own + step <= top) & (size > 0)
        kind = np.where(on, own + step, 0)
        b = np.where(on, blocks[kind], 0)
        begin = np.cumsum(b) - b
        kept = np.repeat(on, size)
        block = ((high[kept] * np.repeat(b, size)[kept].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        slot = np.repeat(begin, size)[kept] + block
        total = int(b.sum())
        content, n = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(content, slot, weight[kept])
        text = np.repeat(np.arange(len(of)), b)
        place = np.arange(total) - begin[text]
        key = _mixed(content ^ _mixed((kind[text] * np.int64(1 << 40) + place).astype(np.uint64)))
        order = np.lexsort((n, text))  # the emptiest blocks of a text come first
        key = key[order][np.arange(total) - begin[text] >= spare[kind[text]]]
        each = np.split(key, np.cumsum(np.where(on, b - spare[kind], 0))[:-1])
        for i in np.flatnonzero(on):
            found[i].append(each[i])
    return [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in found]


def needed(percent: int, one, other):
    """100 + p times the least overlap of linked sets of these sizes."""
    return percent * (one + other)


class CountTree:
    """An R-tree of count vectors, packed by halving at the widest coordinate; its boxes keep the upper corner and the least size."""

    def __init__(self, points: np.ndarray, size: np.ndarray, percent: int = PERCENT):
        self.percent, self.order = percent, self._packed(points)
        self.points, self.size = points[self.order], size[self.order]
        self.levels, step = [], LEAF
        high, least = self.points, self.size
        while len(high) > 1:
            at = np.arange(0, len(high), step)
            high, least = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((high, least, step))
            step = FAN

    @staticmethod
    def _packed(points: np.ndarray) -> np.ndarray:
        order, todo = np.arange(len(points)), [(0, len(points))]
        while todo:
            low, high = todo.pop()
            if high - low <= LEAF:
                continue
            part = points[order[low:high]]
            widest = int(np.argmax(part.max(0) - part.min(0)))
            middle = max(LEAF, (high - low) // 2 // LEAF * LEAF)
            order[low:high] = order[low:high][np.argpartition(part[:, widest], middle)]
            todo += [(low, low + middle), (low + middle, high)]
        return order

    def near(self, point: np.ndarray, size: int, alive: np.ndarray) -> np.ndarray:
        """Places (of the points as given) among those alive that the bound does not rule out."""
        p = self.percent
        passes = lambda high, least: (100 + p) * np.minimum(high, point).sum(1, dtype=np.int64) >= needed(p, least, size)
        at, below = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points)), None
        for level in range(len(self.levels) - 1, -1, -1):
            high, least, step = self.levels[level]
            at = at[passes(high[at], least[at])]
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < below]
        at = at[alive[self.order[at]]]
        return self.order[at[passes(self.points[at], self.size[at])]]


def linked(one: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Of each of `others`: whether its overlap with `one` is `percent` of their union or more; all are sorted sets."""
    size = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate([*others, one[:0]])
    if not len(one) or not len(flat):
        return np.zeros(len(others), bool)
    there = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    common = np.diff(np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(size)])])
    return 100 * common >= percent * (size + len(one) - common)


def spanned(points: np.ndarray, size: np.ndarray, percent: int, root: np.ndarray, light: np.ndarray | None = None, of: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join all of one box or group that belong together, fewer than there are members.

    Members of equal `root` are joined already. Of two that are both not `light`, the comparison is left out. A member that has been
    reached searches the tree for those not reached yet; with the sets `of`, what it finds is verified."""
    tree = CountTree(points, size, percent)
    rest = np.ones(len(points), bool)
    a, b = [], []
    kinds, own = np.unique(root, return_inverse=True)
    members = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(kinds)))[:-1])
    for seed in range(len(kinds)):
        if not rest[members[seed][0]]:
            continue
        todo = list(members[seed])
        rest[members[seed]] = False
        while todo:
            x = todo.pop()
            alive = rest if light is None or light[x] else rest & light
            hit = tree.near(points[x], int(size[x]), alive)
            if of is not None and len(hit):
                step = max(1, (1 << 20) // (1 + int(size[hit].max())))
                hit = np.concatenate([hit[i : i + step][linked(of[x], [of[j] for j in hit[i : i + step]], percent)] for i in range(0, len(hit), step)])
            if len(hit):
                new, first = np.unique(own[hit], return_index=True)
                a += [x] * len(new)
                b += list(hit[first])
                for k in new:
                    todo += list(members[k])
                    rest[members[k]] = False
    return np.array(a, np.int64), np.array(b, np.int64)


def starred(run: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (a, b) of runs as links of each member to the least of its run that it is joined to, so the same ones come from many boxes."""
    ends = np.unique(np.concatenate([a, b]))
    m = np.int64(len(ends) + 1)
    nodes, both = np.unique(np.concatenate([run * m + np.searchsorted(ends, a), run * m + np.searchsorted(ends, b)]), return_inverse=True)
    x, y = both.reshape(2, -1)
    own = nodes % m
    least = own.copy()
    while len(x):
        before = least.copy()
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        if (least == before).all():
            break
    moved = np.flatnonzero(least != own)
    return ends[least[moved]], ends[own[moved]]


def box_links(key: np.ndarray, k: np.ndarray, root: np.ndarray, size: np.ndarray, points: np.ndarray, percent: int, light: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links between the roots of members of equal `key` that the bound leaves; short runs are compared all at once, longer ones by their tree."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(key)))
    short = np.repeat(length <= SMALL, length)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(min(SMALL, length.max()))):
        at = np.flatnonzero((key[d:] == key[:-d]) & short[d:] & (root[d:] != root[:-d]))
        if light is not None:
            at = at[light[at] | light[at + d]]
        for s in range(0, len(at), _ROWS):
            part = at[s : s + _ROWS]
            part = part[(100 + percent) * np.minimum(points[part], points[part + d]).sum(1, dtype=np.int64) >= needed(percent, size[part], size[part + d])]
            i.append(part)
            j.append(part + d)
    for s, n in zip(start[length > SMALL].tolist(), length[length > SMALL].tolist()):
        _, once = np.unique(k[s : s + n], return_index=True)
        at = s + once
        sure = None if light is None else np.isin(k[at], k[s : s + n][light[s : s + n]])
        x, y = spanned(points[at], size[at], percent, root[at], sure)
        i.append(at[x])
        j.append(at[y])
    i, j = np.concatenate(i), np.concatenate(j)
    run = np.cumsum(np.append(False, key[1:] != key[:-1]))
    return starred(run[i], root[i], root[j])


def _links(a: np.ndarray, b: np.ndarray):
    for i in range(0, len(a), _ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(a[i : i + _ROWS]), pa.array(b[i : i + _ROWS])], ["a", "b"])


def candidate_groups(nodes: DataFrame, percent: int, cell: int) -> DataFrame:
    """(node, root) of nodes(node, size, boxes, points) joined by steps between two of one box that the bound leaves."""

    def spread(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for i in range(0, len(node), 256):
                keys = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)[i : i + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(node[i : i + 256], [len(x) for x in keys]))], ["key", "k"])

    def shared(batches):
        for key, k in whole_runs(batches, 2):
            same = np.append(key[1:] == key[:-1], False)
            kept = np.flatnonzero(same | np.append(False, same[:-1]))
            for i in range(0, len(kept), _ROWS):
                part = kept[i : i + _ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(k[part])], ["key", "k"])

    placed = nodes.select("node", "boxes").mapInArrow(spread, "key long, k long")
    met = cut(placed.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, k long"))
    once = cut(met.select("k").distinct())
    few = once.count() <= MOST_BROADCAST
    own = nodes.join(F.broadcast(once) if few else once, F.col("node") == F.col("k")).select("k", "size", "points")
    members = met.join(own, "k").select("key", "k", F.col("k").alias("root"), "size", "points")
    hot = cut(met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).withColumn("parts", F.ceil(F.col("n") / cell)))

    def links_in(cells: DataFrame, *more: str) -> DataFrame:
        def compare(batches):
            for key, k, root, size, blobs, *light in whole_runs(batches, 5 + len(more)):
                yield from _links(*box_links(key, k, root, size, unpacked(size, blobs), percent, *(x.astype(bool) for x in light)))

        # cells that meet in one hash are only compared more
        one = cells.select(F.when(F.col("cell") == 0, F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("key"), "k", "root", "size", "points", *more)
        return one.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()

    if hot.isEmpty():
        return cut(components(links_in(members.withColumn("cell", F.lit(0).cast("long")))))
    comp = _joined(None, links_in(first_cells(members, hot)))
    return _joined(comp, links_in(second_cells(members.drop("root"), hot, comp), "light"))


def verified_groups(members: DataFrame, texts: DataFrame, percent: int, cell: int, width: int) -> DataFrame:
    """(node, root) of the sets that are linked, within the groups of members(key, k, size, i, t1, t2); texts(i, t1, t2, t) hold their texts."""
    few = members.count() <= MOST_BROADCAST
    same = (F.col("x.t1") == F.col("y.t1")) & (F.col("x.t2") == F.col("y.t2")) & F.col("x.i").eqNullSafe(F.col("y.i"))
    rows = texts.alias("x").join((F.broadcast(members) if few else members).alias("y"), same).select("y.key", "y.k", "x.t")

    def shingled(batches):
        only("ngramjoin")
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            for i, j in slices(offsets, SLICE):
                own = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array([x.tobytes() for x in own], pa.binary())], ["key", "k", "set"])

    made = rows.mapInArrow(shingled, "key long, k long, set binary").dropDuplicates(["k"])

    def compare(tab: pa.Table) -> pa.Table:
        col = {c: tab.column(c).to_numpy() for c in tab.column_names if c != "set"}
        k, once = np.unique(col["k"], return_index=True)
        held = tab.column("set").combine_chunks()
        own = [np.frombuffer(held[int(i)].as_py(), np.uint64) for i in once]
        size = np.array([len(x) for x in own], np.int64)
        light = np.isin(k, col["k"][col["light"].astype(bool)]) if "light" in col else None
        root = col["root"][once] if "root" in col else k
        a, b = spanned(counts(own, groups_for(int(np.median(size)))), size, percent, root, light, own)
        return pa.table({"a": root[a], "b": root[b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    links_in = lambda cells: cells.groupBy("key", "cell").applyInArrow(compare, "a long, b long").distinct()
    total = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    parts = F.ceil(F.greatest(F.col("n") / cell, F.col("s") / CELL_SHINGLES))
    hot = cut(total.withColumn("parts", parts).where("parts > 1").select("key", "n", "parts"))
    if hot.isEmpty():
        return components(links_in(made.withColumn("cell", F.lit(0).cast("long"))))
    made = cut(made)
    comp = _joined(None, links_in(first_cells(made, hot)))
    return _joined(comp, links_in(second_cells(made, hot, comp)))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH, cell: int = CELL) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row: component_id is the smallest id reachable over texts whose sets of `width`-word
    shingles have 100 * intersection >= `percent` * union (A-Z lower-cased, words split at ASCII white space; fewer words: one shingle).

    Equal sets are one node, so copies never pair up. Null, empty and blank texts have an empty set and link with nothing: their
    component is their own id. A null id gets a component from the other ids of its group, null if it has none. Repeated rows each get a
    row; an empty table gives none. Further columns are not used. Texts are hashed whole; a very long one takes some twenty times its size in its task."""
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    lean(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("i"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("identity"), text).alias("t2"), text.alias("t"))
    kind = rows.schema["i"].dataType.simpleString()

    def run(batches):
        only("ngramjoin")
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for i, j in slices(offsets, SLICE):
                own = sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in own), np.int64).reshape(-1, 2)
                blobs = [pa.array([x.tobytes() for x in boxes(own, percent)], pa.binary()), pa.array(packed_counts(own), pa.binary())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c)[i:j] for c in range(3)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.array([len(x) for x in own], np.int64)), *blobs],
                    ["i", "t1", "t2", "h1", "h2", "size", "boxes", "points"],
                )

    made = cut(rows.mapInArrow(run, f"i {kind}, t1 long, t2 long, h1 long, h2 long, size long, boxes binary, points binary"))
    full = made.where("size > 0")
    counted = full.groupBy("h1", "h2", "size").agg(
        F.min("i").alias("m"), F.count("*").alias("n"), F.max("boxes").alias("boxes"), F.max("points").alias("points"), F.min(F.struct("i", "t1", "t2")).alias("of")
    )
    counted = cut(counted.withColumn("node", F.monotonically_increasing_id()))  # read from the checkpoint only, so a number stays
    near = candidate_groups(counted, percent, cell)
    members = counted.join(near, "node").select(F.col("root").alias("key"), F.col("node").alias("k"), "size", "of.i", "of.t1", "of.t2")
    comp = verified_groups(cut(members), rows, percent, cell, width)
    keys = ["h1", "h2", "size"]
    labelled = _labelled(full.select(F.col("i").alias("id"), *keys), counted.select(*keys, "node", "m", "n"), comp, keys)
    blank = made.where("size = 0").select(F.col("i").alias("id"), "size", F.col("i").alias("component_id"))
    out = labelled.select("id", "size", "component_id").unionByName(blank)
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def op11(spark, sf_dir) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


_SHINGLES = "CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
OP11_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, {_SHINGLES} AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
t AS (SELECT doc_id, hash(x) AS x FROM (SELECT doc_id, unnest(s) AS x FROM s)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {PERCENT} * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id FROM n JOIN reach ON doc_id = a GROUP BY ALL
"""
