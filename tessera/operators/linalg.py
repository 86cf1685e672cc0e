"""Linear algebra over long triplets and rows of arrays.

Large sides stay distributed; what comes to the driver is k columns wide, and
its size is set by parameters. Random matrices are functions of (index, seed),
made where they are needed rather than sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vocab import lists, row_slices
from tessera.session import cut, ship

PAIR_BLOCK = 1 << 14  # pairs whose numbers of Omega are made at once
NARROW = 64  # columns up to which sums by key are expressions
BROADCAST_NUMBERS, HOT_PARTS = 1 << 22, 4096  # 32 MB of numbers
WIDE = 512  # columns over which a Gram matrix travels by rows
SLICE_CELLS = 1 << 18  # cells of packed rows that are multiplied at once


@dataclass
class Packed:
    """Triplets (i, j, v) by rows (i long, js array<int>, ns): columns rise in a
    row and small ones are frequent; weigh(i, j, n, sizes) gives the values of the
    cells of some rows from their counts where they are used. flipped: the
    transposed matrix."""

    rows: DataFrame
    weigh: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    flipped: bool = False

    @property
    def sparkSession(self):
        return self.rows.sparkSession

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(slice, sizes of its rows, columns and values of its cells)."""
        for batch in batches:
            for b in row_slices(batch, "js", SLICE_CELLS):
                sizes = b.column("js").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                i, j, n = b.column("i").to_numpy(zero_copy_only=False), *(b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("js", "ns"))
                if len(j):
                    yield b, sizes, j, np.asarray(self.weigh(i, j, n.astype(np.float64), sizes), np.float64)

    def plain(self) -> Packed:
        """This matrix without its frame, as workers get it."""
        return replace(self, rows=None)

    def cells(self) -> DataFrame:
        """(i, j, v)."""
        ship(self.sparkSession)
        own = self.plain()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, sizes, j, v in own.slices(batches):
                i = np.repeat(b.column("i").to_numpy(zero_copy_only=False), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((j.astype(np.int64), i, v) if own.flipped else (i, j.astype(np.int64), v))], names=["i", "j", "v"])

        return self.rows.mapInArrow(run, "i long, j long, v double")


@dataclass
class Beside:
    """[left right]: columns of the right matrix come after the first `offset`."""

    left: Packed
    right: Packed
    offset: int
    flipped: bool = False

    @property
    def sparkSession(self):
        return self.left.sparkSession


def _sums_by(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(x[order], first, axis=0)


def _rows_out(keys: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(keys), 10_000):
        part = x[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 10_000].astype(np.int64)), lists(part.reshape(-1), np.full(len(part), x.shape[1]))], names=["i", "x"])


def _spread(rows: DataFrame, own: Packed, k: int, of: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(i, x): sums by column of packed rows' values times of(rows), k numbers a
    row. Each task adds up the frequent columns, and others by slices."""
    lead = max(1, BROADCAST_NUMBERS // k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((0, k))
        for b, sizes, j, v in own.slices(batches):
            at, x = _sums_by(j, np.repeat(of(b), sizes, axis=0) * v[:, None])
            near = int(np.searchsorted(at, lead))
            if near and at[near - 1] >= len(total):
                total = np.r_[total, np.zeros((min(lead, max(2 * len(total), int(at[near - 1]) + 1)) - len(total), k))]
            low = int(np.searchsorted(at, 0))
            total[at[low:near]] += x[low:near]
            for part in (slice(0, low), slice(near, None)):
                yield from _rows_out(at[part], x[part])
        used = np.flatnonzero(total.any(1))
        for lo in range(0, len(used), 10_000):
            yield from _rows_out(used[lo : lo + 10_000], total[used[lo : lo + 10_000]])

    return add_rows(rows.mapInArrow(run, "i long, x array<double>"), k)


def _packed_image(m: Packed, k: int, seed: int, offset: int = 0) -> DataFrame:
    """random_image of a packed matrix; offset is added to its columns."""
    own = m.plain()
    if m.flipped:
        return _spread(m.rows, own, k, lambda b: uniform_rows(b.column("i").to_numpy(zero_copy_only=False) + offset, k, seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sizes, j, v in own.slices(batches):
            ju, back = np.unique(j, return_inverse=True)
            x = uniform_rows(ju.astype(np.int64) + offset, k, seed)[back] * v[:, None]
            full = sizes > 0
            yield from _rows_out(b.column("i").to_numpy(zero_copy_only=False)[full], np.add.reduceat(x, (np.cumsum(sizes) - sizes)[full], axis=0))

    return add_rows(m.rows.mapInArrow(run, "i long, x array<double>"), k)


def _packed_times(m: Packed, rows: DataFrame, k: int) -> DataFrame:
    """times_rows of a packed matrix. By rows: P's rows of frequent columns are
    sent out, cells of others are joined to theirs. By columns: the rows meet
    those of P, and their cells stay with them."""
    own = m.plain()
    p = rows.select(F.col("i").cast("long").alias("_k"), F.col("x").cast("array<double>").alias("x"))
    if m.flipped:
        both = m.rows.join(p, F.col("i") == F.col("_k")).drop("_k")
        return _spread(both, own, k, lambda b: b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
    lead = BROADCAST_NUMBERS // k
    sent = p.where((F.col("_k") >= 0) & (F.col("_k") < lead)).toArrow()
    at = sent.column(0).to_numpy()
    near = np.zeros((int(at.max(initial=-1)) + 1, k))
    near[at] = sent.column(1).combine_chunks().flatten().to_numpy().reshape(-1, k) if len(at) else near
    shared = m.sparkSession.sparkContext.broadcast(near)

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b, sizes, j, v in own.slices(batches):
            x = np.zeros((len(j), k))
            known = (j >= 0) & (j < len(table))
            x[known] = table[j[known]] * v[known, None]
            full = sizes > 0
            yield from _rows_out(b.column("i").to_numpy(zero_copy_only=False)[full], np.add.reduceat(x, (np.cumsum(sizes) - sizes)[full], axis=0))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sizes, j, v in own.slices(batches):
            far = (j < 0) | (j >= lead)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("i").to_numpy(zero_copy_only=False), sizes)[far]), pa.array(j[far].astype(np.int64)), pa.array(v[far])], names=["i", "j", "v"])

    parts = m.rows.mapInArrow(here, "i long, x array<double>")
    rest = p.where((F.col("_k") < 0) | (F.col("_k") >= lead))
    if rest.limit(1).count():
        far = m.rows.mapInArrow(others, "i long, j long, v double").join(rest, F.col("j") == F.col("_k"))
        parts = parts.unionByName(far.select("i", F.transform("x", lambda c: c * F.col("v")).alias("x")))
    return add_rows(parts, k)


def uniform_rows(keys: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows of k numbers in [-1, 1), each a function of its key and the seed."""
    x = (keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(seed * 0x94D049BB133111EB & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 52) - 1


def _packed(rows: DataFrame, key: str, column: str = "x") -> DataFrame:
    return rows.select(F.col(key), F.col(column).cast("array<double>").alias(column))


def random_image(cells: DataFrame | Packed | Beside, k: int, seed: int) -> DataFrame:
    """(i, x): B Omega of (i, j, v), Omega uniform in [-1, 1). Partial sums of a
    batch are added before the shuffle."""
    ship(cells.sparkSession)
    if isinstance(cells, Packed):
        return _packed_image(cells, k, seed)
    if isinstance(cells, Beside):
        return add_rows(_packed_image(cells.left, k, seed).unionByName(_packed_image(cells.right, k, seed, cells.offset)), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                i, j, v = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "v"))
                u, back = np.unique(i, return_inverse=True)
                ju, jback = np.unique(j, return_inverse=True)
                total = np.zeros((len(u), k))
                np.add.at(total, back, uniform_rows(ju, k, seed)[jback] * v[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "x"])

    parts = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).mapInArrow(run, "i long, x array<double>")
    return add_rows(parts, k)


def add_rows(parts: DataFrame, k: int, key: str = "i") -> DataFrame:
    """Sum arrays of k numbers by key; wide ones in Arrow, where k sums as
    expressions would be too much generated code."""
    if k <= NARROW:
        return parts.groupBy(key).agg(*[F.sum(F.col("x")[d]).alias(f"x{d}") for d in range(k)]).select(key, F.array(*[F.col(f"x{d}") for d in range(k)]).alias("x"))

    def add(group: pa.Table) -> pa.Table:
        total = group.column("x").combine_chunks().flatten().to_numpy().reshape(-1, k).sum(0)
        return pa.table({key: group.column(key).slice(0, 1), "x": pa.array([total], pa.list_(pa.float64()))})

    return parts.select(key, "x").groupBy(key).applyInArrow(add, f"`{key}` {dict(parts.dtypes)[key]}, x array<double>")


def times_rows(cells: DataFrame | Packed | Beside, rows: DataFrame, k: int, left: str = "i", inner: str = "j") -> DataFrame:
    """(i, x): B P of triplets (i, j, v) and rows (i, x) of P keyed by B's inner
    index. P is broadcast if it has at most BROADCAST_NUMBERS numbers; else
    inner indices with over 1 / HOT_PARTS of the cells (at most HOT_PARTS of
    them) are, so that no key of the join that is left is hot. Products are
    added up by outer index inside each batch before they travel."""
    ship(cells.sparkSession)
    rows = rows if hasattr(rows, "_tessera_path") else cut(rows, "rows")
    if isinstance(cells, Packed):
        return _packed_times(cells, rows, k)
    if isinstance(cells, Beside):
        later = (F.col("i") + (cells.offset if cells.flipped else -cells.offset)).alias("i")
        if cells.flipped:
            return _packed_times(flip(cells.left), rows, k).unionByName(_packed_times(flip(cells.right), rows, k).select(later, "x"))
        own = rows.where(F.col("i") < cells.offset), rows.where(F.col("i") >= cells.offset).select(later, "x")
        return add_rows(_packed_times(cells.left, own[0], k).unionByName(_packed_times(cells.right, own[1], k)), k)
    p = rows.select(F.col("i").alias("_k"), "x")
    if rows.count() * k <= BROADCAST_NUMBERS:
        prod = cells.join(F.broadcast(p), F.col(inner) == F.col("_k"))
    else:
        per = cells.groupBy(F.col(inner).alias("_j")).agg(F.count("*").alias("_c"))
        per = cut(per, "inner")
        limit = per.agg(F.sum("_c")).first()[0] / HOT_PARTS
        hot = cut(per.where(F.col("_c") > limit).select("_j"), "hot")
        lead = p.join(F.broadcast(hot), F.col("_k") == F.col("_j"), "left_semi")
        many = cells.join(F.broadcast(hot), F.col(inner) == F.col("_j"), "left_semi").join(F.broadcast(lead), F.col(inner) == F.col("_k"))
        few = cells.join(F.broadcast(hot), F.col(inner) == F.col("_j"), "left_anti").join(p, F.col(inner) == F.col("_k"))
        prod = many.select(left, "v", "x").unionByName(few.select(left, "v", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u, back = np.unique(b.column("i").to_numpy(zero_copy_only=False), return_inverse=True)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) * b.column("v").to_numpy(zero_copy_only=False)[:, None]
                order = np.argsort(back, kind="stable")
                total = np.add.reduceat(x[order], np.searchsorted(back[order], np.arange(len(u))), axis=0)
                ends = pa.array(np.arange(len(u) + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.ListArray.from_arrays(ends, pa.array(total.reshape(-1)))], names=["i", "x"])

    parts = prod.select(F.col(left).cast("long").alias("i"), F.col("v").cast("double").alias("v"), F.col("x").cast("array<double>").alias("x")).mapInArrow(run, "i long, x array<double>")
    return add_rows(parts, k)


def gram(rows: DataFrame, k: int, column: str = "x") -> np.ndarray:
    """X'X of rows of k numbers: one pass, k x k sums from each task; those of
    a wide matrix travel and come to the driver by rows, not by cells."""
    ship(rows.sparkSession)
    if k > WIDE:
        return _wide_gram(rows, k, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(total.reshape(-1)), pa.array(np.arange(k * k))], names=["g", "at"])

    sums = rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "g double, at long").groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(k * k)
    for r in sums:
        out[r["at"]] = r["g"]
    return out.reshape(k, k)


def _wide_gram(rows: DataFrame, k: int, column: str) -> np.ndarray:
    doubles = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((k, k)), False
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                total += x.T @ x
                some = True
        for lo in range(0, k if some else 0, 256):
            part = total[lo : lo + 256]
            ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)))], names=["at", "g"])

    def add(group: pa.Table) -> pa.Table:
        total = group.column("g").combine_chunks().flatten().to_numpy().reshape(-1, k).sum(0)
        return pa.table({"at": group.column("at").slice(0, 1), "g": pa.array([total], doubles)})

    parts = rows.select(F.col(column).cast("array<double>").alias("x")).mapInArrow(run, "at long, g array<double>")
    sums = parts.groupBy("at").applyInArrow(add, "at long, g array<double>").toArrow()
    out = np.zeros((k, k))
    if sums.num_rows:
        out[sums.column("at").to_numpy()] = sums.column("g").combine_chunks().flatten().to_numpy().reshape(-1, k)
    return out


def dense_rows(cells: DataFrame, k: int) -> DataFrame:
    """(i, x): rows of k numbers of (i, j, v), zero where there is no cell."""
    ship(cells.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sizes = b.column("js").value_lengths().to_numpy()
                x = np.zeros((b.num_rows, k))
                x[np.repeat(np.arange(b.num_rows), sizes), b.column("js").flatten().to_numpy()] = b.column("vs").flatten().to_numpy()
                yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(list(x), pa.list_(pa.float64()))], names=["i", "x"])

    few = cells.where(F.col("j") < k).groupBy(F.col("i").cast("long").alias("i")).agg(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))).alias("c"))
    return few.select("i", F.col("c.j").alias("js"), F.col("c.v").alias("vs")).mapInArrow(run, "i long, x array<double>")


def cross_gram(rows: DataFrame, a: str, b: str, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A'A, A'B and B'B of two array columns, in one pass."""
    g = gram(rows.select(F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).alias("x")), p + q)
    return g[:p, :p], g[:p, p:], g[p:, p:]


def right_multiply(rows: DataFrame, m: np.ndarray, key: str = "i") -> DataFrame:
    """(key, x): rows times a small matrix."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, m.shape[0])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(x @ m), pa.list_(pa.float64()))], names=[key, "x"])

    return _packed(rows, key).mapInArrow(run, f"`{key}` {kind}, x array<double>")


def orthonormal(rows: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Q of rows (i, x), by the Cholesky factor of the Gram matrix, twice for
    accuracy; columns without weight come out as zeros."""
    whole = np.eye(k)
    for _ in range(2):
        g = gram(rows, k)
        w, v = np.linalg.eigh(g)
        keep = w > max(w.max(initial=0), 1e-300) * 1e-13
        t = v * np.where(keep, 1 / np.sqrt(np.where(keep, w, 1)), 0)
        rows, whole = right_multiply(rows, t), whole @ t
    return rows, whole


def signed(u: np.ndarray) -> np.ndarray:
    """Columns' signs, so that each one's largest entry is positive."""
    return np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def flip(cells: DataFrame | Packed | Beside) -> DataFrame | Packed | Beside:
    if isinstance(cells, Packed | Beside):
        return replace(cells, flipped=not cells.flipped)
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def randomized_svd(cells: DataFrame | Packed | Beside, k: int, power: int = 0, seed: int = 77777, oversample: int = 0) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(left rows (i, x), singular values, right rows (i, x)) of (i, j, v), by
    a random range of k + oversample columns, `power` passes of B B' with
    orthonormal columns in between, and a small decomposition."""
    width = k + oversample
    y = cut(random_image(cells, width, seed), "image")
    back = flip(cells)
    for _ in range(power):
        q, _ = orthonormal(y, width)
        z = cut(times_rows(back, q, width), "image")
        y = cut(times_rows(cells, z, width), "image")
    q, _ = orthonormal(y, width)
    q = cut(q, "range")
    r = cut(times_rows(back, q, width), "reduced")  # (Q'B)' by rows
    w, u = np.linalg.eigh(gram(r, width))
    order = np.argsort(-w)[:k]
    d, u = np.sqrt(np.maximum(w[order], 0)), u[:, order]
    left = right_multiply(q, u)
    # a column's sign: that of the sum of its cubes
    cubes = left.agg(*[F.sum(F.pow(F.col("x")[c], F.lit(3.0))).alias(f"s{c}") for c in range(len(order))]).first()
    s = np.array([-1.0 if (c or 0) < 0 else 1.0 for c in cubes])
    return right_multiply(q, u * s), d, right_multiply(r, u * s / np.where(d > 0, d, 1))


def random_range(cells: DataFrame | Packed | Beside, k: int, power: int = 0, seed: int = 77777) -> DataFrame:
    """(i, x): an orthonormal basis of the random range."""
    y = cut(random_image(cells, k, seed), "image")
    for _ in range(power):
        q, _ = orthonormal(y, k)
        y = cut(times_rows(cells, cut(times_rows(flip(cells), q, k), "image"), k), "image")
    return orthonormal(y, k)[0]


def plain_projection(cells: DataFrame | Packed | Beside, k: int, seed: int = 77777, both_sides: bool = False) -> DataFrame:
    """(i, x): B Omega; or [B' Omega | B Omega'] with k/2 columns each, zeros
    where an index has no cells on a side."""
    if not both_sides:
        return random_image(cells, k, seed)
    if k % 2:
        raise ValueError("both sides need an even number of columns")
    half, zeros = k // 2, F.array_repeat(F.lit(0.0), k // 2)
    a = random_image(flip(cells), half, seed).select("i", F.col("x").alias("a"))
    b = random_image(cells, half, seed + 1).select("i", F.col("x").alias("b"))
    return a.join(b, "i", "full").select("i", F.concat(F.coalesce("a", zeros), F.coalesce("b", zeros)).alias("x"))


def exact_svd(rows: DataFrame, k: int, n_columns: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(left rows, d, V) of rows (i, x) with few columns, from the Gram matrix."""
    w, v = np.linalg.eigh(gram(rows, n_columns))
    order = np.argsort(-w)[:k]
    d, v = np.sqrt(np.maximum(w[order], 0)), v[:, order]
    v = v * signed(v)
    return right_multiply(rows, v / np.where(d > 0, d, 1)), d, v


def principal_components(rows: DataFrame, k: int, n_columns: int) -> tuple[np.ndarray, np.ndarray]:
    """(variances, loadings) of the covariance of rows (x)."""
    g = gram(rows.select(F.concat(F.array(F.lit(1.0)), F.col("x").cast("array<double>")).alias("x")), n_columns + 1)
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    w, v = np.linalg.eigh((g[1:, 1:] - n * np.outer(mean, mean)) / (n - 1))
    order = np.argsort(-w)[:k]
    return w[order], v[:, order] * signed(v[:, order])


def canonical_correlations(rows: DataFrame, a: str, b: str, p: int, q: int, center: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(correlations, weights of a, weights of b) of two blocks of columns."""
    one = F.array(F.lit(1.0))
    g = gram(rows.select(F.concat(one, F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).alias("x")), 1 + p + q)
    s = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / g[0, 0] if center else g[1:, 1:]

    def whiten(m: np.ndarray) -> np.ndarray:
        w, v = np.linalg.eigh(m)
        keep = w > w.max(initial=0) * 1e-10
        return v[:, keep] / np.sqrt(w[keep])

    wa, wb = whiten(s[:p, :p]), whiten(s[p:, p:])
    u, d, vt = np.linalg.svd(wa.T @ s[:p, p:] @ wb)
    n = len(d)
    return np.clip(d, 0, 1), wa @ u[:, :n], wb @ vt.T[:, :n]


def varimax(loadings: np.ndarray, rounds: int = 1000, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(rotated loadings, rotation) of greatest variance of squared loadings,
    rows scaled to unit length first."""
    h = np.sqrt((loadings**2).sum(1))
    a, r, last = loadings / np.where(h > 0, h, 1)[:, None], np.eye(loadings.shape[1]), 0.0
    for _ in range(rounds):
        z = a @ r
        u, s, vt = np.linalg.svd(a.T @ (z**3 - z * (z**2).mean(0)))
        r = u @ vt
        if s.sum() < last * (1 + least):
            break
        last = s.sum()
    return (a @ r) * h[:, None], r


def rank_one(cells: DataFrame, rounds: int = 50, least: float = 1e-3) -> tuple[DataFrame, float, DataFrame]:
    """(u rows (i, x), d, v rows) of (i, j, v) by alternating least squares;
    stops when d changes by less than `least` of itself."""
    v = cells.select(F.col("j").alias("i")).distinct().withColumn("x", F.array(F.lit(1.0)))
    d = 0.0
    for _ in range(rounds):
        u = times_rows(cells, v, 1)
        nu = u.agg(F.sqrt(F.sum(F.col("x")[0] * F.col("x")[0]))).first()[0] or 1.0
        u = cut(u.select("i", F.array(F.col("x")[0] / nu).alias("x")), "als")
        v = times_rows(flip(cells), u, 1)
        now = v.agg(F.sqrt(F.sum(F.col("x")[0] * F.col("x")[0]))).first()[0] or 0.0
        v = cut(v.select("i", F.array(F.col("x")[0] / (now or 1.0)).alias("x")), "als")
        done, d = abs(now - d) <= least * max(now, 1e-300), now
        if done:
            break
    return u, d, v


def leverages(rows: DataFrame, k: int, key: str = "i") -> DataFrame:
    """(key, leverage): the diagonal of X (X'X)^-1 X'."""
    inverse = np.linalg.pinv(gram(rows, k))
    root = np.linalg.cholesky(inverse + np.eye(k) * 1e-15) if k else inverse
    return right_multiply(rows, root, key).select(key, F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x).alias("leverage"))


class _PairSums:
    """Sums of v_j v_k Omega_jk over the pairs j <= k of a row, with the numbers
    of uniform_rows for the key j << 32 | k, made in place in blocks."""

    def __init__(self, k: int, seed: int):
        self.k, self.mask = k, np.uint64(seed * 0x94D049BB133111EB & (1 << 64) - 1)
        self.columns = np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        self.base, self.x, self.t = (np.empty(PAIR_BLOCK, np.uint64) for _ in range(3))
        self.f, self.w = np.empty(PAIR_BLOCK), np.empty(PAIR_BLOCK)

    def _add(self, m: int, sums: np.ndarray) -> None:
        base, x, t, f, w = (a[:m] for a in (self.base, self.x, self.t, self.f, self.w))
        for c in range(self.k):
            np.add(base, self.columns[c], out=x)
            np.bitwise_xor(x, self.mask, out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.right_shift(x, np.uint64(shift), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.right_shift(x, np.uint64(31), out=t)
            np.bitwise_xor(x, t, out=x)
            np.right_shift(x, np.uint64(11), out=x)
            np.copyto(f, x.view(np.int64))
            f *= 1 / (1 << 52)
            f -= 1
            sums[c] += f @ w

    def of(self, j: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Sums of a row of rising columns j with values v."""
        sums, m = np.zeros(self.k), 0
        low = j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        high = low << np.uint64(32)
        for a in range(len(j)):
            at = a
            while at < len(j):
                n = min(len(j) - at, PAIR_BLOCK - m)
                np.add(low[at : at + n], high[a], out=self.base[m : m + n])
                np.multiply(v[at : at + n], v[a], out=self.w[m : m + n])
                at, m = at + n, m + n
                if m == PAIR_BLOCK:
                    self._add(m, sums)
                    m = 0
        if m:
            self._add(m, sums)
        return sums


def quadratic_image(cells: DataFrame | Packed, k: int, seed: int) -> DataFrame:
    """(i, x): a random projection of the products v_j v_k of all pairs j <= k
    of the cells (i, j, v) of each row. A pair's Omega row is hashed from j and
    k where it is used; a row's pairs are made in blocks and never leave it.
    Rows are dealt out by hash, since their work goes by the square of their
    length."""
    ship(cells.sparkSession)
    own = cells.plain() if isinstance(cells, Packed) else Packed(None, lambda i, j, n, sizes: n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _PairSums(k, seed)
        for b, sizes, j, v in own.slices(batches):
            ends = np.cumsum(sizes)
            x = np.array([pairs.of(j[lo:hi], v[lo:hi]) for lo, hi in zip(ends - sizes, ends, strict=True)])
            yield from _rows_out(b.column("i").to_numpy(zero_copy_only=False), x)

    if isinstance(cells, Packed):
        rows = cells.rows.repartition(F.xxhash64("i"))
    else:
        pairs = F.sort_array(F.collect_list(F.struct(F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))))
        rows = cells.groupBy(F.col("i").cast("long").alias("i")).agg(pairs.alias("c")).select("i", F.col("c.j").alias("js"), F.col("c.v").alias("ns"))
    return rows.mapInArrow(run, "i long, x array<double>")


def quadratic_range(cells: DataFrame | Packed, k: int, power: int = 0, seed: int = 77777) -> DataFrame:
    """(i, x): an orthonormal basis of the random range of all products of
    columns, with `power` passes of B B' over the columns themselves."""
    y = cut(quadratic_image(cells, k, seed), "image")
    for _ in range(power):
        q, _ = orthonormal(y, k)
        y = cut(times_rows(cells, cut(times_rows(flip(cells), q, k), "image"), k), "image")
    return orthonormal(y, k)[0]


def top_loadings(rows: DataFrame, k: int, columns: list[int], top: int = 20, key: str = "i") -> DataFrame:
    """(component, place, key, v): the rows of largest |v| of each of the given
    columns of rows (key, x); component -1: largest sum of squares over them."""
    values = F.array(*[F.struct(F.lit(c).alias("component"), F.col("x")[c].alias("v")) for c in columns], F.struct(F.lit(-1).alias("component"), F.aggregate(F.array(*[F.col("x")[c] * F.col("x")[c] for c in columns]), F.lit(0.0), lambda s, v: s + v).alias("v")))
    long = rows.select(key, F.explode(values).alias("s")).select("s.component", key, "s.v")
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.abs("v")), key))
    return long.withColumn("place", place).where(F.col("place") <= top)


def subspace_agreement(rows: DataFrame, a: str, b: str, p: int, q: int, least: float = 0.9) -> dict:
    """How far two sets of directions span the same space: the number and share
    of canonical correlations of at least `least`."""
    r, _, _ = canonical_correlations(rows, a, b, p, q, center=False)
    high = int((r >= least).sum())
    return {"directions": len(r), "high": high, "share": high / max(len(r), 1)}


def centred_comparison(rows: DataFrame, k: int, n_columns: int) -> list[dict]:
    """Singular values of rows (x) as they are and with column means taken off,
    side by side, from one Gram matrix."""
    g = gram(rows.select(F.concat(F.array(F.lit(1.0)), F.col("x").cast("array<double>")).alias("x")), n_columns + 1)
    n, total = g[0, 0], g[0, 1:]
    plain, centred = (np.sort(np.sqrt(np.maximum(np.linalg.eigvalsh(m), 0)))[::-1] for m in (g[1:, 1:], g[1:, 1:] - np.outer(total, total) / max(n, 1)))
    return [{"place": c + 1, "plain": float(plain[c]), "centred": float(centred[c])} for c in range(min(k, n_columns))]


def column_squares(rows: DataFrame, k: int) -> list[float]:
    """Sums of squares of each component."""
    return [float(x or 0) for x in rows.agg(*[F.sum(F.col("x")[d] * F.col("x")[d]) for d in range(k)]).first()]


def random_rotation(n: int, seed: int) -> np.ndarray:
    """A random orthogonal n x n matrix; n rows must fit the driver."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))
