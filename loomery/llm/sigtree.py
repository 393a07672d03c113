"""Jaccard join of word n-grams by signature trees, with the components that its links connect.

Two texts link when 100 * |A and B| >= percent * |A or B| over their sets of n-grams (64-bit hashes). Equal
sets are one node. Then, without losing a link:

1. Families. At most H = (100 - percent) / (100 + percent) * (|A| + |B|) members are in only one of two linked sets.
   Members are dealt by hash into more than H segments, so some segment of both is the same. Its hash is a
   key, and sets with a common key are in one family. Sizes are cut into classes by the factor 100 / percent; linked
   sets lie in one class or in neighbouring ones, and each set deals its members once for either neighbour.
   Empty segments are no keys, unless more than the spare ones are empty (see ``segment_keys``).
2. Signature trees. Families are cut by size into blocks. A task builds a tree over a block: leaves
   hold the token bitmap and the size of one set, inner nodes the OR of the bitmaps below, the range of the sizes
   and the most members that share bits with others. Two trees, or one with itself, are traversed together;
   a pair of nodes goes no further when its sizes are too far apart, when all below is connected already, or when the
   largest overlap that bitmaps allow is too small for a link. Pairs of leaves that are left are counted exactly.
3. Only links that connect what was not connected leave a task: fewer than its members. Blocks are first
   joined with themselves; blocks of one family whose members are not connected by then meet in pairs.

Keys are shuffled after equal ones of a batch have become one, so a group of copies sends a row a batch.

Defined results: null, empty and blank texts have empty sets and link with nothing, not even each other. A text of fewer words
than an n-gram has one n-gram, all its words. Rows with a null id link like others; component_id is the smallest id that is not null, null if
there is none. Repeated rows are kept. An empty table gives no rows. Texts of any length are read whole. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import wordvec as V
from .alike import name_of
from .links import components
from .sparkutil import small_batches, written

U = V.U64
#: Members of a block, counting each set as LEAST at least.
BLOCK, LEAST = 1 << 18, 256
FAN = 8
#: Bits for each member of the largest set of a tree, and bytes of all bitmaps of a tree's leaves.
SPARSE, BITMAPS = 8, 64 << 20
#: Node pairs that are looked at together.
PAIRS = 1 << 14
#: Cells of the filter that spares most texts without a family the shuffle.
CELLS = 1 << 24


def ngrams(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; A-Z are lower-cased."""
    w = V.Words(data, offsets, lower=True)
    h = w.hashes()
    start, grams = V.window_hashes(h, w.first, width)
    cut = np.searchsorted(start, w.first).tolist()
    first, counts = w.first.tolist(), w.counts.tolist()
    out = []
    for k, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(grams[cut[k] : cut[k + 1]]))
        elif n:
            whole = U(n)
            for x in h[first[k] : first[k + 1]]:
                whole = V.mix64(np.array([whole ^ x]))[0]
            out.append(np.array([whole]))
        else:
            out.append(np.zeros(0, U))
    return out


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = V.flat(column)
    for i, j in V.spans(offsets):
        yield from ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def classes(largest: int, percent: int) -> np.ndarray:
    """The first size of each class up to one beyond that of ``largest``."""
    out = [1]
    while out[-1] <= largest or len(out) < 3:
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    for _ in range(2):
        out.append(max(out[-1] + 1, -(-100 * out[-1] // percent)))
    return np.array(out, np.int64)


def segment_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of every key of every set.

    A pair of neighbouring classes has H + 1 + spare segments. A set of which at least H + 1 hold
    members has, for any linked one, a segment with members that is the same in both. A set with fewer also gives
    keys of its empty segments, and so does any other such set, so two of them meet as well.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([np.zeros(0, U), *sets])
    own = np.repeat(np.arange(len(sets)), sizes)
    bounds = classes(int(sizes.max(initial=0)), percent)
    differ = (100 - percent) * 2 * (bounds[2:] - 1) // (100 + percent)
    spread = differ + 1 + (differ + 1) // 16
    cls = np.searchsorted(bounds, sizes, "right") - 1
    who, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for pair in (cls, cls - 1):
        ok = (pair >= 0) & (sizes > 0)
        ok[ok] &= differ[pair[ok]] > 0  # else only equal sets link
        m = np.where(ok, spread[np.maximum(pair, 0)], 0)
        base = np.cumsum(m) - m
        part = np.flatnonzero(ok[own])
        if not len(part):
            continue
        o, t = own[part], flat[part]
        salt = V.mix64(pair.astype(np.int64).view(U) + U(0x51ED27))
        at = base[o] + (V.mix64(t ^ salt[o]) % m[o].astype(U)).astype(np.int64)
        total = np.zeros(int(m.sum()), U)
        np.add.at(total, at, V.mix64(t + U(0x2545F4914F6CDD1D)))
        held = np.bincount(at, minlength=len(total)) > 0
        doc = np.repeat(np.arange(len(sets)), m)
        segment = np.arange(len(total)) - base[doc]
        few = np.bincount(doc[held], minlength=len(sets)) < np.where(ok, differ[np.maximum(pair, 0)] + 1, 0)
        given = held | few[doc]
        who.append(doc[given])
        keys.append(V.mix64(total[given] ^ V.mix64(salt[doc[given]] + segment[given].astype(U))))
    return np.concatenate(who), np.concatenate(keys)


def nodes(df: DataFrame, width: int) -> DataFrame:
    """(doc_id, fk, g, n) of each row of df (doc_id, fk, text): the name and the size of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(sets_of(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([name_of(s) for s in sets], pa.int64()), pa.array(list(map(len, sets)), pa.int64())], names=["doc_id", "fk", "g", "n"])

    return df.mapInArrow(run, "doc_id long, fk long, g long, n long")


def _starred(key: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (key, g): where each key begins, and the distinct (g, first g of its key) of the others."""
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    lead = g[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
    other = lead != g
    pairs = np.unique(np.stack([g[other], lead[other]], axis=1), axis=0)
    return np.flatnonzero(fresh), pairs[:, 0], pairs[:, 1]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node) of every other node of the sets that links (a, b) connect."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        p, q = root[x], root[y]
        open_ = p != q
        if not open_.any():
            break
        np.minimum.at(root, np.maximum(p, q)[open_], np.minimum(p, q)[open_])
        while not np.array_equal(deeper := root[root], root):
            root = deeper
    other = np.flatnonzero(root != np.arange(len(names)))
    return names[other], names[root[other]]


def shared_keys(df: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): pairs of set names that connect all sets with a common key. A task gives those of its keys as stars."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = V.flat(batch.column(0))
            g, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in V.spans(offsets):
                sets = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                who, found = segment_keys(sets, percent)
                g.append(np.array([name_of(s) for s in sets], np.int64)[who])
                key.append(found.view(np.int64))
            g, key = np.concatenate(g), np.concatenate(key)
            order = np.lexsort((g, key))
            g, key = g[order], key[order]
            first, a, b = _starred(key, g)
            # pairs travel under a key of their own, which spreads them
            cols = [np.concatenate([key[first], V.mix64(a.view(U)).view(np.int64)]), np.concatenate([g[first], a]), np.concatenate([g[first], b])]
            for k in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 50_000]) for c in cols], names=["key", "g", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, g, b = (np.asarray(batch.column(k)) for k in range(3))
            pair = g != b
            held.append((g[pair], b[pair]))
            key, g = key[~pair], g[~pair]
            if len(key):
                if last is not None and last[0] == key[0]:
                    key, g = np.append(last[0], key), np.append(last[1], g)
                first, a, lead = _starred(key, g)
                last = int(key[-1]), int(g[first[-1]])
                held.append((a, lead))
            size += len(held[-1][0]) + int(pair.sum())
            if size > 1 << 20:  # as many as there are sets at most stay
                held = [stars(*map(np.concatenate, zip(*held)))]
                size = 0
        if held:
            a, b = stars(*map(np.concatenate, zip(*held)))
            for k in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[k : k + 50_000]), pa.array(b[k : k + 50_000])], names=["a", "b"])

    rows = df.select("text").mapInArrow(deal, "key long, g long, b long")
    return rows.repartition("key").sortWithinPartitions("key", "g").mapInArrow(meet, "a long, b long")


class Tree:
    """A signature tree over sets: levels from the leaves up, each with bitmaps, size ranges, collisions and labels."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        maps = np.empty((len(sets), bits // 64), U)
        for a in range(0, len(sets), 64):
            part = sets[a : a + 64]
            set_ = np.zeros((len(part), bits), bool)
            set_[np.repeat(np.arange(len(part)), n[a : a + 64]), (np.concatenate(part) % U(bits)).astype(np.int64)] = True
            maps[a : a + 64] = np.packbits(set_, axis=1).view(U)
        self.levels = [(maps, n, n, n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, clash = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(clash, at)))

    def labelled(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the one label of all below each node, or -1."""
        out = [label]
        for _ in self.levels[1:]:
            at = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def traverse(x: Tree, y: Tree, xl: np.ndarray, yl: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leaves of x, leaves of y, largest possible overlaps) of pairs that may link and have different labels."""
    same = x is y
    lx, ly = x.labelled(xl), y.labelled(yl)
    # the trees need not be equally high: the lower one's root waits
    stack = [(len(x.levels) - 1, len(y.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        ma, la, ha, ca = x.levels[i]
        mb, lb, hb, cb = y.levels[j]
        ok = (100 * ha[a] >= percent * lb[b]) & (100 * hb[b] >= percent * la[a])
        ok &= (lx[i][a] != ly[j][b]) | (lx[i][a] < 0)
        if same and not i:
            ok &= a < b
        a, b = a[ok], b[ok]
        most = np.minimum(np.bitwise_count(ma[a] & mb[b]).sum(axis=1, dtype=np.int64) + np.minimum(ca[a], cb[b]), np.minimum(ha[a], hb[b]))
        ok = (100 + percent) * most >= percent * (la[a] + lb[b])
        a, b, most = a[ok], b[ok], most[ok]
        if not len(a):
            continue
        if not i and not j:
            yield a, b, most
            continue
        # the larger node is opened; both at once where they are as high, as in a tree with itself
        ka = np.arange(FAN) if i >= j else np.zeros(1, np.int64)
        kb = np.arange(FAN) if j >= i else np.zeros(1, np.int64)
        na = (a[:, None, None] * (FAN if i >= j else 1) + ka[None, :, None]) + 0 * kb[None, None, :]
        nb = (b[:, None, None] * (FAN if j >= i else 1) + kb[None, None, :]) + 0 * ka[None, :, None]
        na, nb = na.ravel(), nb.ravel()
        ni, nj = i - (i >= j), j - (j >= i)
        ok = (na < len(x.levels[ni][0])) & (nb < len(y.levels[nj][0]))
        if same:
            ok &= na <= nb
        na, nb = na[ok], nb[ok]
        stack += [(ni, nj, na[k : k + PAIRS], nb[k : k + PAIRS]) for k in range(0, len(na), PAIRS)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    both = int(np.count_nonzero(b[np.minimum(b.searchsorted(a), len(b) - 1)] == a))
    return (100 + percent) * both >= percent * (len(a) + len(b))


def connections(left: list[np.ndarray], right: list[np.ndarray] | None, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what labels do not, by numbers in left followed by right; links of left alone if right is None."""
    sets = left + (right or [])
    _, root = np.unique(label, return_inverse=True)
    root = root.tolist()
    top = list(range(max(root, default=-1) + 1))
    found = []

    def find(k: int) -> int:
        k = root[k]
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    def try_(i: int, j: int) -> None:
        p, q = find(i), find(j)
        if p != q and linked(sets[i], sets[j], percent):
            top[max(p, q)] = min(p, q)
            found.append((i, j))

    if right is None and len(left) <= FAN:
        for j in range(len(left)):
            for i in range(j):
                if 100 * min(len(left[i]), len(left[j])) >= percent * max(len(left[i]), len(left[j])):
                    try_(i, j)
        return found
    largest = max(map(len, sets))
    bits = max(256, 1 << (SPARSE * largest - 1).bit_length())
    while bits > 256 and bits // 8 * len(sets) > BITMAPS:
        bits //= 2
    x = Tree(left, bits)
    y = x if right is None else Tree(right, bits)
    shift = 0 if right is None else len(left)
    if right is None:  # a set near all others connects most of them at once
        maps, n, _, clash = x.levels[0]
        share = sum(np.unpackbits(maps[k : k + 64].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(maps), 64))
        middle = np.packbits(2 * share > len(maps)).view(U)
        hub = int(np.bitwise_count(maps ^ middle).sum(axis=1, dtype=np.int64).argmin())
        most = np.bitwise_count(maps & maps[hub]).sum(axis=1, dtype=np.int64) + np.minimum(clash, clash[hub])
        for k in np.flatnonzero((100 + percent) * np.minimum(most, np.minimum(n, n[hub])) >= percent * (n + n[hub])).tolist():
            try_(hub, k)
    now = np.array([find(k) for k in range(len(sets))], np.int64)
    for a, b, most in traverse(x, y, now[: len(left)], now[shift : shift + len(y.sets)], percent):
        # the likeliest first: each link spares others
        for i, j in np.stack([a, b + shift], axis=1)[np.argsort(-most, kind="stable")].tolist():
            try_(i, j)
    return found


def tested(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): labels that links connect, as stars. rows: family, x, y (block numbers), side, g, label, text; a group is one (family, x, y)."""

    def group(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        side, g, label = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (3, 4, 5))
        sets = [s for b in held for s in sets_of(b.column(6), width)]
        # near sets side by side: by size, then by their least member
        order = sorted(range(len(sets)), key=lambda k: (side[k], len(sets[k]), int(sets[k][0]) if len(sets[k]) else 0, int(g[k])))
        sets, g, label, side = [sets[k] for k in order], g[order], label[order], side[order]
        cut = int(np.searchsorted(side, 1))
        cross = cut < len(sets)
        found = np.array(connections(sets[:cut], sets[cut:] if cross else None, label, percent), np.int64).reshape(-1, 2)
        return list(zip(*(c.tolist() for c in stars(label[found[:, 0]], label[found[:, 1]]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(k)) for k in range(3)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                if a == b:
                    continue
                if now is not None and now != tuple(keys[a]):
                    out += group(held)
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
        if held:
            out = group(held)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return rows.select("family", "x", "y", "side", "g", "label", "text").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "side", "g").mapInArrow(run, "a long, b long")


def marked(df: DataFrame, column: str) -> np.ndarray:
    """A filter of fixed size in which the values of a column are marked."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, bool)
        for batch in batches:
            seen[(V.mix64(np.asarray(batch.column(0)).view(U)) % U(CELLS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["seen"])

    out = np.zeros(CELLS // 8, np.uint8)
    for r in df.select(column).coalesce(8).mapInArrow(mark, "seen binary").toLocalIterator():
        out |= np.frombuffer(r["seen"], np.uint8)
    return out


def texts(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (g, n, fk, family, block) with the text of each."""
    marks = marked(placed, "fk")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (V.mix64(np.asarray(batch.column(0)).view(U)) % U(CELLS)).astype(np.int64)
            yield batch.filter(pa.array(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    return docs.select("fk", "text").mapInArrow(pick, "fk long, text string").dropDuplicates(["fk"]).join(placed, "fk")


def place(members: DataFrame) -> DataFrame:
    """members (family, g, n, ...) with ``block``: by size, about BLOCK members each, from a histogram of sizes."""
    weight = F.greatest(F.col("n"), F.lit(LEAST))
    sizes = members.groupBy("family", "n").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum(F.col("c") * weight).over(Window.partitionBy("family").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("g"), F.col("c")) * weight) / BLOCK).cast("long")
    return members.join(at, ["family", "n"]).withColumn("block", block).drop("c", "before")


def connected(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """(g, root) of all sets: the name of one set of all that links connect. docs: fk, text. found: g, n, fk of each distinct set."""
    family = components(shared_keys(docs, width, percent))
    members = found.join(family.select(F.col("node").alias("g"), F.col("root").alias("family")), "g")
    held = written(texts(docs, place(members)), "families")
    alone = held.select("family", F.col("block").alias("x"), F.col("block").alias("y"), F.lit(0).alias("side"), "g", F.col("g").alias("label"), "text")
    # a set is in one block: what its block connects has the block's star for a label
    label = written(tested(alone, width, percent), "labels").select(F.col("a").alias("g"), F.col("b").alias("label"))
    every = found.select("g").join(label, "g", "left").withColumn("label", F.coalesce("label", "g"))
    blocks = held.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    several = written(blocks.groupBy("family").agg(F.count(F.lit(1)).alias("k")).where("k > 1").join(blocks, "family").drop("k"), "blocks")
    if several.isEmpty():
        return every.withColumnRenamed("label", "root")
    open_ = held.join(several.select("family").distinct(), "family", "left_semi").join(label, "g", "left").withColumn("label", F.coalesce("label", "g"))
    whole = open_.groupBy("family", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"))
    b = several.join(whole, ["family", "block"])
    x, y = (b.select("family", *[F.col(c).alias(f"{p}{c}") for c in ("block", "low", "high", "l0", "l1")]) for p in "xy")
    near = (F.col("xhigh") * 100 >= F.col("ylow") * percent) & (F.col("yhigh") * 100 >= F.col("xlow") * percent)
    done = (F.col("xl0") == F.col("xl1")) & (F.col("yl0") == F.col("yl1")) & (F.col("xl0") == F.col("yl0"))
    pairs = written(x.join(y, "family").where((F.col("xblock") < F.col("yblock")) & near & ~done).select("family", F.col("xblock").alias("x"), F.col("yblock").alias("y")), "pairs")
    sides = [open_.join(pairs.withColumn("block", F.col(c)), ["family", "block"]).select("family", "x", "y", F.lit(k).alias("side"), "g", "label", "text") for k, c in enumerate("xy")]
    root = components(tested(sides[0].unionByName(sides[1]), width, percent)).select(F.col("node").alias("label"), "root")
    return every.join(root, "label", "left").select("g", F.coalesce("root", "label").alias("root"))


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: component_id is the smallest id that links reach, itself included."""
    small_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{doc_id}`").cast("long"), body).alias("fk"), body.alias("text"))
    every = written(nodes(docs, width), "nodes")
    found = written(every.where("n > 0").groupBy("g").agg(F.min("doc_id").alias("least"), F.min("fk").alias("fk"), F.first("n").alias("n")), "sets")
    root = connected(docs.select("fk", "text"), found.select("g", "n", "fk"), width, percent)
    joined = found.select("g", "least").join(root, "g")
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    label = written(joined.join(best, "root").select("g", "component_id"), "labels")
    out = every.join(label, "g", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
