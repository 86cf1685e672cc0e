"""Near-duplicate documents by min-max hashing (op5).

1. Every document gets its set of word shingles, a hash of the set, and a
   signature: minimum and maximum under each of PERMUTATIONS permutations, cut
   into bands of ROWS values.
2. Documents of one set become one node (the smallest doc_id).
3. Nodes that share a band meet in buckets. A first round compares each node
   to few leaders of its bucket by signature (8 bits a value) and confirms the
   likely pairs on full sets; that joins most copies.
4. In buckets that still hold several components, nodes stay that have a
   partner of another component whose signature is alike within SAFE below the
   bound (more than five standard deviations of the estimate: what truly passes
   is missed once in 10^7). Those alone get their full sets, and all nodes of
   different components are compared exactly, without emitting pairs: only
   links that join components come out. Buckets over BLOCK nodes are dealt to
   blocks and pairs of blocks in both steps.
5. Links become components, in both rounds.

Two sets share no band with probability 7e-7 at a likeness of 0.85, and 1e-4
at 0.80.

Sets that more than one in HOT_PARTS of all documents hold are at most
HOT_PARTS, so they are broadcast; copies of other sets meet by a join.

Defined results: null, empty and blank texts have no shingles and no links;
null doc_ids take no part (component_id null, kept); rows that repeat a doc_id
keep their rows; ties go to the smallest doc_id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm import shingles
from tessera.llm.shingles import MinMax, mix
from tessera.llm.words import slices
from tessera.session import cut, discard, ship

PERMUTATIONS, BANDS, ROWS, BLOCK = 90, 30, 6, 512
SLOTS = 1 << 20
SAFE, HOT_PARTS, HOT_LEAST = 0.15, 4096, 256


class Signer:
    """Band keys and the short signature of a set, by min-max hashing."""

    def __init__(self):
        self.family = MinMax(PERMUTATIONS)
        self.factors = np.random.default_rng(77).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, s: np.ndarray) -> tuple[np.ndarray, bytes]:
        v = mix(self.family.values(s))
        return band_keys(v[: BANDS * ROWS], self.factors), (v >> np.uint64(56)).astype(np.uint8).tobytes()


def band_keys(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band (row of factors) of signature values."""
    sums = (values.reshape(factors.shape) * factors).sum(1, dtype=np.uint64)
    return mix(sums + np.arange(len(factors), dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, words: int, signer=Signer, lower: bool = True) -> DataFrame:
    """doc_id, n, set hash (h1, h2), band keys and the short signature."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own = signer()
        for b in slices(batches):
            n, h1, h2, keys, short = [], [], [], [], []
            for s in shingles.shingle_sets(b.column("text"), words, lower):
                n.append(len(s))
                if not len(s):
                    h1.append(0), h2.append(0), keys.append([]), short.append(b"")
                    continue
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((whole & (1 << 64) - 1) - (1 << 63))
                h2.append((whole >> 64) - (1 << 63))
                band, one = own.sign(s)
                keys.append(band)
                short.append(one)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                names=["doc_id", "n", "h1", "h2", "bands", "short"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, bands array<long>, short binary")


def by_key(rows: DataFrame, keyed: DataFrame, total: int) -> DataFrame:
    """rows joined to a written table keyed(key, c, ...), c the number of rows
    that have the key, of `total` in all. Keys of over 1 in HOT_PARTS of them are
    at most HOT_PARTS: they are broadcast, so no key of the join is hot. The
    rest grows with the data and is joined alike at every size."""
    limit = max(HOT_LEAST, total // HOT_PARTS)
    hot = keyed.where(F.col("c") > limit)
    few = rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(keyed.where(F.col("c") <= limit).hint("merge"), "key")
    return few.unionByName(rows.join(F.broadcast(hot), "key"))


def _groups(members: DataFrame, inside_only: bool) -> DataFrame:
    """Members with the block pairs (lo, hi) of their bucket that they go to."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    m = members.withColumn("blocks", blocks).withColumn("own", own)
    if inside_only:
        return m.withColumn("lo", F.col("own")).withColumn("hi", F.col("own"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return m.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))


def _alike(short: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (short == one).mean(1)


def _leaders(t: pa.Table, likely: float) -> list[tuple[int, int]]:
    """Each node with the first leader it looks like; others lead in turn."""
    node = t.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    node, short, out = node[order], _matrix(t)[order], []
    left = np.arange(len(node))
    while len(left) > 1:
        first, rest = left[0], left[1:]
        near = _alike(short[rest], short[first]) >= likely
        out += [(int(node[first]), int(x)) for x in node[rest[near]] if x != node[first]]
        left = rest[~near]
    return out


def _joins(t: pa.Table, percent: int, lo: int, hi: int) -> list[tuple[int, int]]:
    """Links between nodes of different components, by exact comparison of
    their sets; in a pair of blocks only those that cross it. Components that
    a link joins count as one from then on, so nodes already joined are not
    compared, and at most one link fewer than there are components come out."""
    node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
    _, root = np.unique(t.column("comp").to_numpy(), return_inverse=True)
    lists = t.column("shingles").combine_chunks()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    # numbers for the block's shingles: a set is then marked in one array
    _, flat = np.unique(lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], return_inverse=True)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
    rows = np.arange(len(node)) if lo == hi else np.flatnonzero(own == lo)
    against = rows if lo == hi else np.flatnonzero(own == hi)
    out = []
    for r in rows:
        a = against[(root[against] != root[r]) & (100 * np.minimum(size[against], size[r]) >= percent * np.maximum(size[against], size[r]))]
        a = a[a > r] if lo == hi else a
        if not len(a):
            continue
        mine = flat[offsets[r] : offsets[r + 1]]
        mark[mine] = True
        parts = np.concatenate([flat[offsets[k] : offsets[k + 1]] for k in a])
        both = np.add.reduceat(mark[parts].astype(np.int64), np.concatenate([[0], np.cumsum(size[a])[:-1]]))
        mark[mine] = False
        for k in a[100 * both >= percent * (size[a] + size[r] - both)]:
            if root[k] != root[r]:
                root[root == root[k]] = root[r]
                out.append((int(min(node[r], node[k])), int(max(node[r], node[k]))))
    return out


def _plausible(t: pa.Table, least: float, percent: int, lo: int, hi: int) -> np.ndarray:
    """Rows with a partner of another component that by size and signature may
    pass the bound; in a pair of blocks only partners across it count."""
    own, comp, size, short = t.column("own").to_numpy(), t.column("comp").to_numpy(), t.column("n").to_numpy(), _matrix(t)
    out = np.zeros(t.num_rows, bool)
    rows = np.flatnonzero(own == lo)
    against = rows if lo == hi else np.flatnonzero(own == hi)
    for r in rows:
        a = against[(comp[against] != comp[r]) & (100 * np.minimum(size[against], size[r]) >= percent * np.maximum(size[against], size[r]))]
        if len(a):
            a = a[_alike(short[a], short[r]) >= least]
            out[a] = True
            out[r] |= len(a) > 0
    return out


def _matrix(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("short").to_pylist()), np.uint8).reshape(t.num_rows, -1)


def _pairs(grouped: DataFrame, choose) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        found = choose(t, key[1].as_py(), key[2].as_py()) if t.num_rows > 1 else []
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    return grouped.groupBy("key", "lo", "hi").applyInArrow(run, "u long, v long").distinct()


def _candidates(grouped: DataFrame, percent: int) -> DataFrame:
    """(key, node) of the rows that _plausible leaves."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        keep = _plausible(t, percent / 100 - SAFE, percent, key[1].as_py(), key[2].as_py()) if t.num_rows > 1 else np.zeros(t.num_rows, bool)
        return t.select(["key", "node"]).filter(pa.array(keep))

    return grouped.groupBy("key", "lo", "hi").applyInArrow(run, "key long, node long").distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, words: int, lower: bool = True) -> DataFrame:
    """(node, shingles) of the documents in nodes. Slots of a hash, at most
    SLOTS of them, keep most other texts out before the exact join."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = nodes.select(slot("node").alias("slot")).distinct()
    near = docs.select("doc_id", "text").withColumn("slot", slot("doc_id")).join(F.broadcast(slots), "slot", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [x.view(np.int64) for x in shingles.shingle_sets(b.column("text"), words, lower)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return near.select("doc_id", "text").mapInArrow(run, "node long, shingles array<long>").join(nodes, "node", "left_semi")


def confirm(docs: DataFrame, pairs: DataFrame, words: int, percent: int, lower: bool = True) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are alike enough."""
    pairs = cut(pairs, "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = cut(shingle_sets(docs, nodes, words, lower), "sets")
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    joined = pairs.join(left, "u").join(right, "v").select("u", "v", both.alias("both"), (F.size("a") + F.size("b") - both).alias("all"))
    links = cut(joined.where(100 * F.col("both") >= percent * F.col("all")).select("u", "v"), "links")
    discard(sets)
    discard(pairs)
    return links


def near_classes(docs: DataFrame, words: int = 5, percent: int = 80, signer=Signer, lower: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of
    docs(doc_id, text). A signer makes the signatures that candidates come from."""
    ship(docs.sparkSession)
    signed = cut(signatures(docs, words, signer, lower), "signed")
    alive = signed.where("n > 0 and doc_id is not null")
    same = ["h1", "h2", "n"]
    copies = alive.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count("*").alias("c")).where("c > 1")
    copies = cut(copies, "copies")
    rows = signed.count()
    limit = max(HOT_LEAST, rows // HOT_PARTS)
    hot = copies.where(F.col("c") > limit).select(*same, F.col("node").alias("hot"))  # at most HOT_PARTS rows
    some = copies.where(F.col("c") <= limit).select(*same, "node")
    marked = alive.join(F.broadcast(hot), same, "left")
    few = marked.where("hot is null").join(some.hint("merge"), same, "left").withColumn("node", F.coalesce("node", "doc_id"))
    many = marked.where("hot is not null").withColumn("node", F.col("hot"))
    mine = lambda c: F.when(F.col("doc_id") == F.col("node"), F.col(c)).alias(c)
    tied = cut(few.unionByName(many).select("doc_id", "n", "node", mine("bands"), mine("short")), "tied")
    own = tied.where("doc_id = node")
    banded = own.select("node", F.explode("bands").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = cut(by_key(banded, shared, rows * BANDS).join(own.select("node", "n", "short"), "node"), "members")

    likely = percent / 100 - 0.03
    first = confirm(docs, _pairs(_groups(members.select("key", "node", "c", "short"), True), lambda t, lo, hi: _leaders(t, likely)), words, percent, lower)
    early = comp = cut(components(first).withColumnRenamed("component", "comp"), "comp")
    placed = members.select("key", "node", "c").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).where("x <> y")
    open_keys = cut(several.select("key", "c"), "open-keys")
    still = cut(by_key(placed.drop("c"), open_keys, rows * BANDS), "open")
    signs = own.select("node", "n", "short")
    chosen = cut(_candidates(_groups(still.join(signs, "node"), False), percent), "chosen")
    counts = cut(chosen.groupBy("key").agg(F.count("*").alias("c")), "counts")
    again = by_key(chosen.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), counts, rows * BANDS)
    sets = cut(shingle_sets(docs, chosen.select("node").distinct(), words, lower), "sets")
    second = _pairs(_groups(again.select("key", "node", "c", "comp").join(sets, "node"), False), lambda t, lo, hi: _joins(t, percent, lo, hi))
    # what the first round joined stays joined: its stars go into the last graph
    comp = cut(components(second.unionByName(comp.select(F.col("node").alias("u"), F.col("comp").alias("v")))).withColumnRenamed("component", "comp"), "comp")

    ends = tied.select("doc_id", "n", "node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    linked = ends.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = cut(linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "classes")
    for done in (signed, copies, tied, shared, members, first, early, open_keys, still, chosen, counts, sets, comp):
        discard(done)
    return out
