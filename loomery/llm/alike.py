"""Near-duplicates by the exact Jaccard similarity of word shingles; deletion variants of fingerprints propose first, prefixes find all the rest.

Two texts are linked when their sets of shingles (64-bit hashes) have a Jaccard similarity of at least
4/5. Candidates come from prefix filtering, which loses none: in any one order of all shingles, the
first n - ceil(4n/5) + 1 shingles of two such sets have one in common, and from the first common one on
enough must be left on both sides. The order puts shingles that a sample finds common last; it decides
what the search costs, never what it finds.

The SimHash of each set goes through the one-wildcard segment variants of simhash.links first: fingerprints that
differ in at most ``NEAR_BITS`` bits propose a link, which counts only if their sets are alike. What they connect is not looked
for again; what they miss, prefixes find.

Nothing emits all pairs of a group of copies. Equal sets are one node, and a set's parity sketch holds the
parity of its members in each of its cells: a power of two, ``BITS`` at least and no fewer than members up to
``MOST_BITS``; folding a sketch gives the one of half the cells. First sets that share one of their ``HUBS`` least shingles
under different mixings are paired with one of them only: the hub, whose sketch is nearest to the majority's
in each cell. The nearest hub of each node is verified and connects it; a second round does so for one node of
each connected group. Then all pairs that could be alike and are not yet connected are verified. Before, pairs go whose sketches differ in more cells than alike sets may differ in
members; that loses none either, as each cell that differs needs a member of its own. They go where they meet: runs of equal shingles give their
members alone, runs of the same members become one, and only then sketches join them and pairs are made. Shingles that the sample expects in more than
``MAX_RUN`` texts are cut into blocks, and every two blocks meet in a group of their own.

Defined results: null and empty texts have no shingles and are alike; a text of fewer words than a
shingle has one shingle. Rows with a null id stay. Rows of one id with different texts are documents of their
own; of rows of one id and text one stays. An empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordvec as V
from .links import components
from .simhash import links, shingle_hashes, vote
from .sparkutil import free_name, small_batches, written

MAX_RUN = 4096
#: Texts of the sample that finds common shingles, and how many of these are told to the tasks.
SAMPLE, COMMON = 5000, 100_000
#: Fewest and most cells of a parity sketch, and cells of the filter that picks texts to be read again.
BITS, MOST_BITS, CELLS = 1024, 1 << 16, 1 << 24
HUBS = 4
#: Bits in which fingerprints may differ that propose a link.
NEAR_BITS = 4


def alike(both, a, b):
    """True where sets of a and b members with ``both`` in common have a Jaccard similarity of 4/5 or more."""
    return 9 * both >= 4 * (a + b)


def shingle_sets(column: pa.Array, width: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = V.flat(column)
    for i, j in V.spans(offsets):
        for h in shingle_hashes(V.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), width, seed):
            yield np.unique(h)


def text_hash(text: str):
    """What tells texts of one id apart; null and empty ones are one."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def parity(shingles: np.ndarray) -> bytes:
    """The parity sketch of a set."""
    bits = min(MOST_BITS, max(BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0))
    odd = np.bincount((shingles & V.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch as one of ``size`` bytes, a power of two that its own size is a multiple of."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), axis=0)


class Sketches:
    """Sketches side by side, for the number of cells in which pairs of them differ."""

    def __init__(self, sketches: list[bytes]):
        self.size = np.fromiter(map(len, sketches), np.int64, len(sketches))
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.size).tolist():
            # alike sets differ by a quarter in size, so by one fold at most
            own = np.flatnonzero((self.size == size) | (self.size == 2 * size))
            at = np.full(len(sketches), -1)
            at[own] = np.arange(len(own))
            self.tables[size] = at, np.stack([folded(sketches[i], size) for i in own.tolist()])

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Cells that differ between x and y, 0 (nothing is known) where more than a fold lies between them."""
        small, large = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        out = np.zeros(len(x), np.int64)
        for size, (at, table) in self.tables.items():
            mine = np.flatnonzero((small == size) & (large <= 2 * size))
            step = max(1, (1 << 25) // size)
            for k in range(0, len(mine), step):
                m = mine[k : k + step]
                out[m] = np.bitwise_count(table[at[x[m]]] ^ table[at[y[m]]]).sum(axis=1, dtype=np.int64)
        return out


def name_of(shingles: np.ndarray) -> int:
    """The XXH64 of a set, as a signed number."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).astype(np.int64))


def common_shingles(docs: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, about how many documents hold each) of shingles that a sample of documents repeats."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(1, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), width, seed))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, V.U64), *sets]).view(np.int64))], names=["key"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    found = some.mapInArrow(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).collect()
    keys = np.array([r["key"] for r in found], np.int64).view(V.U64)
    order = np.argsort(keys)
    return keys[order], np.ceil(np.array([r["n"] for r in found], float) / share).astype(np.int64)[order]


def nodes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], width: int, seed: int) -> DataFrame:
    """(g, node, th, n, prefix, sketch, least, f0) of each distinct set: its name, the smallest id that has it and that one's
    text hash, its size, first shingles, parities, least shingles and fingerprint."""
    keys, often = common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n, prefix, sketch, least = [], [], [], [], []
            held, size, prints = [], 0, []
            for s in shingle_sets(batch.column(1), width, seed):
                held.append(s)
                size += len(s)
                if size > 1 << 20:
                    prints.append(vote(held))
                    held, size = [], 0
                g.append(name_of(s))
                n.append(len(s))
                sketch.append(parity(s))
                least.append(np.array([s[V.mix64(s + V.U64(k)).argmin()] for k in range(HUBS)] if len(s) else [], V.U64).tobytes())
                first = s
                if len(s):
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        first = s[np.argsort(np.where(keys[at] == s, often[at], 0), kind="stable")]
                    first = first[: len(s) - (4 * len(s) + 4) // 5 + 1]
                prefix.append(first.tobytes())
            prints.append(vote(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(g, pa.int64()), pa.array(n, pa.int32()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary()), pa.array(least, pa.binary()), pa.array(np.concatenate(prints).view(np.int64))], names=["doc_id", "th", "g", "n", "prefix", "sketch", "least", "f0"])

    made = docs.select("doc_id", "text", text_hash("text").alias("th")).mapInArrow(run, "doc_id long, th long, g long, n int, prefix binary, sketch binary, least binary, f0 long")
    # all but the id and its text hash are the same for all rows of one g
    found = made.groupBy("g").agg(F.min(F.struct("doc_id", "th")).alias("id"), *[F.first(c).alias(c) for c in ("n", "prefix", "sketch", "least", "f0")])
    return found.select("g", F.col("id.doc_id").alias("node"), F.col("id.th").alias("th"), "n", "prefix", "sketch", "least", "f0")


def proposed(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of names that deletion variants of their fingerprints connect: stars, within one fingerprint and between them.

    A member of stars of several variants is paired with one of their centres only, so there are no more pairs than names.
    """
    prints = written(sets.groupBy("f0").agg(F.min("g").alias("node")), "prints")
    same = sets.select("f0", "g").join(prints, "f0").where("g <> node").select(F.col("g").alias("a"), F.col("node").alias("b"))
    pairs = same.unionByName(links(prints, NEAR_BITS)).groupBy("a").agg(F.min("b").alias("b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def postings(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], every: bool) -> DataFrame:
    """(key, block, label, g, n, pos, sketch): a row for each shingle of each prefix, in each block where it meets others.

    Not ``every``: a row for each of the least shingles, with the sketch of ``BITS`` cells (null otherwise), in its own block only.
    """
    often = common[1] > MAX_RUN
    keys, parts = common[0][often], -(-common[1][often] // MAX_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, g, n = (np.asarray(batch.column(k)) for k in range(3))
            raw = [np.frombuffer(p, V.U64) for p in batch.column(3).to_pylist()]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw))
            key = np.concatenate([np.zeros(0, V.U64), *raw])
            own = np.repeat(np.arange(len(raw)), sizes)
            pos = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            block = np.zeros(len(key), np.int64)
            if len(keys) and len(key):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                nb = np.where(keys[at] == key, parts[at], 1)
                mine = (V.mix64(g[own].view(V.U64)) % nb.astype(V.U64)).astype(np.int64)
                if not every:
                    nb, block = np.ones(len(key), np.int64), mine
                again = np.repeat(np.arange(len(key)), nb)
                other = np.arange(len(again)) - np.repeat(np.cumsum(nb) - nb, nb)
                block = np.minimum(other, mine[again]) * nb[again] + np.maximum(other, mine[again]) if every else block
                key, own, pos = key[again], own[again], pos[again]
            small = None if every else pa.array([folded(x, BITS // 8).tobytes() for x in batch.column(4).to_pylist()], pa.binary())
            for a in range(0, len(key), 100_000):
                o = own[a : a + 100_000]
                cols = [key[a : a + 100_000].view(np.int64), block[a : a + 100_000].astype(np.int32), label[o], g[o], n[o], pos[a : a + 100_000].astype(np.int32)]
                sketch = pa.nulls(len(o), pa.binary()) if small is None else small.take(pa.array(o))
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), sketch], names=["key", "block", "label", "g", "n", "pos", "sketch"])

    return sets.select("label", "g", "n", "prefix" if every else "least", "sketch").mapInArrow(run, "key long, block int, label long, g long, n int, pos int, sketch binary")


def hubs(cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each member of a run of equal (key, block) with the run's hub."""
    key, block, g, sketch = cols[0], cols[1], cols[3], cols[6]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    size = np.diff(np.append(first, len(key)))
    run = np.repeat(np.arange(len(first)), size)
    most = np.packbits(2 * np.add.reduceat(np.unpackbits(sketch, axis=1), first, axis=0, dtype=np.int16) > size[:, None], axis=1)
    apart = np.bitwise_count(sketch ^ most[run]).sum(axis=1, dtype=np.int64)
    hub = np.repeat(g[np.lexsort((g, apart, run))[first]], size)
    other = hub != g
    return np.minimum(g, hub)[other], np.maximum(g, hub)[other]


def meetings(run: np.ndarray, label: np.ndarray, n: np.ndarray, pos: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of pairs of each run, sorted by size, that have different labels and may be alike, a step apart at a time."""
    n, left = n.astype(np.int64), n.astype(np.int64) - pos
    at, step = np.arange(len(run)), 1
    while True:
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        # rows of a run stand by size: once the next is too large, so are all after it
        at = at[4 * n[at + step] <= 5 * n[at]]
        if not len(at):
            return
        to = at + step
        ok = alike(np.minimum(left[at], left[to]), n[at], n[to]) & (label[at] != label[to])
        yield at[ok], to[ok]
        step += 1


def members(cols: list[np.ndarray]) -> pa.RecordBatch:
    """(sig, label, g, n, pos) of the members of runs of equal (key, block) that may be alike with another; sig: a hash of all of a run's."""
    key, block, label, g, n, pos = cols[:6]
    run = np.cumsum(np.append(0, (key[1:] != key[:-1]) | (block[1:] != block[:-1])))
    some = np.zeros(len(run), bool)
    for x, y in meetings(run, label, n, pos):
        some[x] = some[y] = True
    at = np.flatnonzero(some)
    run = run[at]
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(at) else np.zeros(0, int)
    sig = V.mix64(np.add.reduceat(V.mix64(g[at].view(V.U64)), first)) if len(at) else np.zeros(0, V.U64)
    sig = np.repeat(sig, np.diff(np.append(first, len(at)))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (sig, label[at], g[at], n[at], pos[at])], names=["sig", "label", "g", "n", "pos"])


def partners(cols: list) -> pa.RecordBatch:
    """Distinct pairs (a, b) of names within runs of equal sig that have different labels, may be alike and whose sketches allow it."""
    sig, label, g, n, pos, sketch = cols
    run, size, held = np.cumsum(np.append(0, sig[1:] != sig[:-1])), n.astype(np.int64), Sketches(sketch)
    found = [np.zeros((0, 2), np.int64)]
    for x, y in meetings(run, label, n, pos):
        # members that differ are na + nb - 2 * both, and 9 * both >= 4 * (na + nb)
        near = 9 * held.apart(x, y) <= size[x] + size[y]
        a, b = g[x[near]], g[y[near]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def star(cols: list[np.ndarray]) -> pa.RecordBatch:
    a, b = hubs(cols)
    pairs = np.unique(np.stack([a, b], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def in_runs(rows: DataFrame, keys: int, done: Callable[[list], pa.RecordBatch], schema: str, least: int, sketches: Callable | None = None) -> DataFrame:
    """done over whole runs of rows that are sorted by their first ``keys`` columns, about ``least`` rows at a time.

    sketches: what becomes of the last column, a list of bytes; it is left out otherwise.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size = weight = 0

        def joined(parts: list) -> list:
            return [[x for p in parts for x in p[k]] if isinstance(parts[0][k], list) else np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols: list = [np.asarray(batch.column(k)) for k in range(len(names) - 1)]
            if sketches is not None:
                cols.append(sketches(batch.column(len(names) - 1).to_pylist()))
            held.append(cols)
            size, weight = size + batch.num_rows, weight + batch.nbytes
            if size < least and weight < 1 << 26:
                continue
            tail = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
            if len(tail):  # the last run may go on in the next batch
                cut = int(tail[-1]) + 1
                yield done(joined([*held[:-1], [c[:cut] for c in cols]]))
                held = [[c[cut:] for c in cols]]
                size, weight = len(cols[0]) - cut, 0
        if size:
            yield done(joined(held))

    return rows.mapInArrow(run, schema)


def candidates(sets: DataFrame, common: tuple[np.ndarray, np.ndarray], every: bool) -> DataFrame:
    """Distinct pairs (a, b) of partners() over all shingles, or of hubs() over the least ones of each set."""
    rows = postings(sets, common, every).repartition("key", "block").sortWithinPartitions("key", "block", "n", "g")
    if not every:
        matrix = lambda x: np.frombuffer(b"".join(x), np.uint8).reshape(-1, BITS // 8)
        return in_runs(rows, 2, star, "a long, b long", MAX_RUN, matrix).distinct()
    met = in_runs(rows, 2, members, "sig long, label long, g long, n int, pos int", 50_000)
    # in runs of the same members the least place of each is the one that rules out least
    met = met.groupBy("sig", "g").agg(F.first("label").alias("label"), F.first("n").alias("n"), F.min("pos").alias("pos"))
    full = met.join(sets.select("g", "sketch"), "g").select("sig", "label", "g", "n", "pos", "sketch")
    return in_runs(full.repartition("sig").sortWithinPartitions("sig", "n", "g"), 1, partners, "a long, b long", 20_000, list).distinct()


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, apart): the pairs whose parity sketches do not rule them out, and in how many cells these differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2)).astype(np.int64) + np.asarray(batch.column(3))
            k = np.arange(len(n))
            apart = Sketches(batch.column(4).to_pylist() + batch.column(5).to_pylist()).apart(k, k + len(n))
            good = pa.array(9 * apart <= n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(good) for k in range(2)), pa.array(apart).filter(good)], names=["a", "b", "apart"])

    x = sets.select(F.col("g").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    y = sets.select(F.col("g").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    small = F.least("na", "nb")
    rows = pairs.join(x, "a").join(y, "b").where(4 * (F.col("na") + F.col("nb")) <= 9 * small)
    return rows.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, apart long")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(g, text) of the nodes in wanted (g, node). A filter of fixed size spares most other texts the shuffle."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(CELLS, bool)
        for batch in batches:
            seen[(V.mix64(np.asarray(batch.column(0)).view(V.U64)) % V.U64(CELLS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["seen"])

    marks = np.zeros(CELLS // 8, np.uint8)
    for r in wanted.select("node").coalesce(6).mapInArrow(mark, "seen binary").toLocalIterator():
        marks |= np.frombuffer(r["seen"], np.uint8)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (V.mix64(np.asarray(batch.column(0)).view(V.U64)) % V.U64(CELLS)).astype(np.int64)
            yield batch.filter(pa.array(marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1))

    some = docs.select("doc_id", "text").mapInArrow(pick, "doc_id long, text string")
    return written(some.join(wanted, some["doc_id"] == wanted["node"]).select("g", "text"), "texts")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, width: int, seed: int) -> DataFrame:
    """The pairs whose sets are alike, counted over all shingles."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            # a text that stands in many pairs of a batch is cut once
            texts = [batch.column(k).fill_null("").dictionary_encode() for k in (2, 3)]
            cut = [list(shingle_sets(t.dictionary, width, seed)) for t in texts]
            for k, (i, j) in enumerate(zip(texts[0].indices.to_pylist(), texts[1].indices.to_pylist())):
                x, y = cut[0][i], cut[1][j]
                # a repeated id has other texts too
                same = name_of(x) == a[k] and name_of(y) == b[k]
                good.append(bool(same and alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in range(2)], names=["a", "b"])

    held = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("g")).distinct().join(sets.select("g", "node"), "g"), docs)
    x, y = held.select(F.col("g").alias("a"), F.col("text").alias("x")), held.select(F.col("g").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def labelled(sets: DataFrame, sure: DataFrame) -> DataFrame:
    """sets with ``label``, the least name that the links ``sure`` connect them to."""
    label = written(components(sure), "labels").withColumnRenamed("node", "g")
    return sets.join(label, "g", "left").withColumn("label", F.coalesce("root", "g")).drop("root")


def firsts(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, th), the smallest id and its text hash, of each group that links connect; docs: doc_id (not null) and text."""
    small_batches(docs.sparkSession)
    common = common_shingles(docs, width, seed)
    sets = written(nodes(docs, common, width, seed), "sets")
    # deletion variants first, then the hubs of all sets, then those of one node of each connected group
    tried = written(possible(proposed(sets), sets).select("a", "b"), "tried")
    sure = written(verified(tried, docs, sets, width, seed), "alike")
    known = labelled(sets, sure)
    for some in (known, None):
        near = possible(candidates(known.where("label = g") if some is None else some, common, every=False), sets)
        both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "apart")
        best = both.groupBy("p.a").agg(F.min(F.struct("apart", "p.b")).alias("best")).select("a", F.col("best.b").alias("b"))
        new = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = written(new.join(tried, ["a", "b"], "left_anti"), "tried")
        found = written(verified(new, docs, sets, width, seed), "alike")
        tried, sure = tried.unionByName(new), sure.unionByName(found)
        known = labelled(sets, sure)
    rest = written(candidates(known, common, every=True).join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = written(verified(rest, docs, sets, width, seed), "alike")
        known = labelled(sets, sure.unionByName(more))
    return known.groupBy("label").agg(F.min(F.struct("node", "th")).alias("first")).select(F.col("first.node").alias("doc_id"), F.col("first.th").alias("th"))


def keep_one(df: DataFrame, width: int = 5, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of df of which one document of each group stays, that with the smallest id; null ids stay."""
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    keep_id, keep_th = free_name(df, "keep_id"), free_name(df, "keep_th")
    first = written(firsts(docs, width, seed), "firsts").select(F.col("doc_id").alias(keep_id), F.col("th").alias(keep_th))
    own = df.withColumn(keep_id, F.col(f"`{doc_id}`").cast("long")).withColumn(keep_th, text_hash(text))
    kept = own.join(first, [keep_id, keep_th], "left_semi").dropDuplicates([keep_id, keep_th])
    return kept.select(*[F.col(f"`{c}`") for c in df.columns]).unionByName(df.where(F.col(f"`{doc_id}`").isNull()))
