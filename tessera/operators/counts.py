"""Document x type and type x type counts as long triplets, and their scalings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import vocab as V
from tessera.operators.linalg import Packed
from tessera.operators.vocab import indexed_arrays, lists, row_slices, settled
from tessera.session import cut, ship

GROUP_DOCS = 4096
#: Pairs that are counted before they travel, in a part of the shuffle, and in
#: one row of packed pairs.
SLICE_PAIRS, PART_PAIRS, ROW_PAIRS = 1 << 22, 1 << 22, 1 << 16


def as_ids(rows: DataFrame | V.Texts, vocab: DataFrame) -> DataFrame:
    """(doc_id, ids) of documents as indices, as texts, as arrays of tokens
    (doc_id, toks) or as tokens (doc_id, tok)."""
    if isinstance(rows, V.Texts):
        return indexed_arrays(rows, vocab)
    if "ids" in rows.columns:
        return rows
    return indexed_arrays(rows if "toks" in rows.columns else rows.groupBy("doc_id").agg(F.collect_list("tok").alias("toks")), vocab)


def document_rows(ids: DataFrame) -> DataFrame:
    """(doc_id, js, ns): the types of each document with tokens, rising, and
    their counts. A document is counted where it is read; only those that share
    their doc_id with another are brought together first."""
    ship(ids.sparkSession)
    if ids.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count():
        ids = ids.groupBy("doc_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in row_slices(batch, "ids", V.SLICE_TOKENS):
                sizes = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(sizes), dtype=np.int64) << 32, sizes)
                keys, n = np.unique(at + b.column("ids").flatten().to_numpy(zero_copy_only=False) + 1, return_counts=True)
                per = np.bincount(keys >> 32, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(((keys & 0xFFFFFFFF) - 1).astype(np.int32), per), lists(n.astype(np.int32), per)], names=["doc_id", "js", "ns"])

    return ids.where(F.size("ids") > 0).select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(ids.dtypes)['doc_id']}, js array<int>, ns array<int>")


def row_cells(rows: DataFrame) -> DataFrame:
    """(doc_id, idx, n) of document_rows, which the result remembers."""
    out = rows.select("doc_id", F.explode(F.arrays_zip("js", "ns")).alias("c")).select("doc_id", F.col("c.js").alias("idx"), F.col("c.ns").cast("long").alias("n"))
    out._tessera_rows = rows
    return out


def document_counts(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, idx, n) of documents in a form that as_ids takes: types of OOV
    add up."""
    return row_cells(document_rows(as_ids(rows, vocab)))


def document_lengths(dtm: DataFrame) -> DataFrame:
    """(doc_id, m): tokens of each document."""
    return dtm.groupBy("doc_id").agg(F.sum("n").alias("m"))


def document_frequency(dtm: DataFrame) -> DataFrame:
    """(idx, df): documents that hold the type."""
    return dtm.groupBy("idx").agg(F.count("*").alias("df"))


def column_sums(cells: DataFrame, key: str, value: str = "n") -> DataFrame:
    return cells.groupBy(key).agg(F.sum(value).alias("total"))


def scale_documents(dtm: DataFrame, how: str, n_docs: int | None = None) -> DataFrame:
    """(doc_id, idx, v): counts scaled by w (raw), r (1/sqrt of the row sum), c
    (1/sqrt of the column sum), b (both), n (rows sum to one) or t (tf-idf,
    n * ln(N / df); N documents with tokens unless given)."""
    n = F.col("n").cast("double")
    rows = lambda d: d.join(document_lengths(dtm), "doc_id")
    columns = lambda d: d.join(column_sums(dtm, "idx").withColumnRenamed("total", "f"), "idx")
    if how == "w":
        out, v = dtm, n
    elif how == "r":
        out, v = rows(dtm), n / F.sqrt("m")
    elif how == "c":
        out, v = columns(dtm), n / F.sqrt("f")
    elif how == "b":
        out, v = columns(rows(dtm)), n / F.sqrt(F.col("m") * F.col("f"))
    elif how == "n":
        out, v = rows(dtm), n / F.col("m")
    elif how == "t":
        out = dtm.join(document_frequency(dtm), "idx")
        if n_docs is None:
            out = out.crossJoin(F.broadcast(dtm.agg(F.countDistinct("doc_id").alias("docs"))))
            v = n * F.log(F.col("docs") / F.col("df"))
        else:
            v = n * F.log(F.lit(float(n_docs)) / F.col("df"))
    else:
        raise ValueError(f"no scaling {how!r}; one of w r c b n t")
    return out.select("doc_id", "idx", v.alias("v"))


def expected_scaling(dtm: DataFrame) -> DataFrame:
    """(doc_id, idx, v): n / sqrt(row sum * column sum + 1/2)."""
    both = dtm.join(document_lengths(dtm), "doc_id").join(column_sums(dtm, "idx").withColumnRenamed("total", "f"), "idx")
    return both.select("doc_id", "idx", (F.col("n") / F.sqrt(F.col("m") * F.col("f") + 0.5)).alias("v"))


def column_entropy(dtm: DataFrame, n_docs: int | None = None) -> DataFrame:
    """(idx, entropy): -sum p ln p over documents, divided by ln N."""
    cells = dtm.join(column_sums(dtm, "idx").withColumnRenamed("total", "f"), "idx").withColumn("p", F.col("n") / F.col("f"))
    size = dtm.agg(F.countDistinct("doc_id").alias("docs")) if n_docs is None else dtm.sparkSession.range(1).select(F.lit(n_docs).alias("docs"))
    per = cells.groupBy("idx").agg((F.lit(0.0) - F.sum(F.col("p") * F.log("p"))).alias("h"))
    return per.crossJoin(F.broadcast(size)).select("idx", (F.col("h") / F.log("docs")).alias("entropy"))


def entropy_weighted(dtm: DataFrame) -> DataFrame:
    """(doc_id, idx, v): rows that sum to one, times 1 - column entropy."""
    return scale_documents(dtm, "n").join(column_entropy(dtm), "idx").select("doc_id", "idx", (F.col("v") * (1 - F.col("entropy"))).alias("v"))


def top_by_tfidf(dtm: DataFrame, k: int = 5000) -> DataFrame:
    """The k types of highest total tf-idf: (idx, score, place)."""
    score = scale_documents(dtm, "t").groupBy("idx").agg(F.sum("v").alias("score"))
    top = score.orderBy(F.desc("score"), "idx").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "idx")))


def column_pairs(dtm: DataFrame, types: int | None = None) -> DataFrame:
    """(doc_id, j, k, v): products of the counts of all type pairs j <= k of
    each document, or of those of the first `types` types. dtm: triplets, or the
    rows of document_rows, which then stay where they are. Pairs are written
    row by row from a document's own arrays."""
    dtm = getattr(dtm, "_tessera_rows", dtm)
    if "js" in dtm.columns:
        c = F.arrays_zip(F.col("js").alias("idx"), F.col("ns").cast("array<long>").alias("n"))
        rows = dtm.select("doc_id", (c if types is None else F.filter(c, lambda s: s["idx"] < types)).alias("c"))
    else:
        few = dtm if types is None else dtm.where(F.col("idx") < types)
        rows = few.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("c"))
    rows = rows.select("doc_id", F.col("c.idx").alias("js"), F.col("c.n").alias("ns"))
    a = rows.select("doc_id", "js", "ns", F.posexplode("js").alias("at", "j"))
    rest = F.size("js") - F.col("at")
    b = a.select("doc_id", "j", F.element_at("ns", F.col("at") + 1).alias("x"), F.arrays_zip(F.slice("js", F.col("at") + 1, rest).alias("k"), F.slice("ns", F.col("at") + 1, rest).alias("y")).alias("r"))
    return b.select("doc_id", "j", "x", F.explode("r").alias("r")).select("doc_id", "j", F.col("r.k").alias("k"), (F.col("x") * F.col("r.y")).alias("v"))


# --- bigrams over the whole corpus order


def _following(arrays: DataFrame, need: int) -> DataFrame:
    """(doc_id, tail, following): the last `need` tokens of each document and
    the `need` tokens after it in corpus order. Documents are grouped by range
    of doc_id; inside a group a window sees few short rows, and between groups
    the same is done again with the groups' first tokens, until one is left."""
    lo, hi, n = arrays.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    ends = arrays.select("doc_id", F.slice("toks", 1, need).alias("head"), F.slice("toks", F.greatest(F.size("toks") - need + 1, F.lit(1)), need).alias("tail")).where(F.size("head") > 0)
    groups = max(1, -(-n // GROUP_DOCS))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // groups))
    ends = ends.withColumn("grp", F.floor((F.col("doc_id") - F.lit(lo or 0)) / F.lit(width)).cast("long"))
    inside = Window.partitionBy("grp").orderBy("doc_id").rowsBetween(1, need)
    own = ends.withColumn("after", F.slice(F.flatten(F.collect_list("head").over(inside)), 1, need))
    if groups == 1:
        return own.select("doc_id", "tail", F.col("after").alias("following"))
    first = ends.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("doc_id"))).where(F.col("r") <= need)
    first = first.groupBy("grp").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("r", "head"))), lambda s: s["head"])), 1, need).alias("start"))
    later = _following(cut(first.select(F.col("grp").alias("doc_id"), F.col("start").alias("toks")), "starts"), need)
    later = later.select(F.col("doc_id").alias("grp"), F.col("following").alias("later"))
    return own.join(later, "grp").select("doc_id", "tail", F.slice(F.concat("after", "later"), 1, need).alias("following"))


def each_pair(arrays: DataFrame, skip: int = 0) -> DataFrame:
    """(left, right) of every token and the (skip+1)-th after it, over documents
    in the order of doc_id."""
    need = skip + 1
    inside = arrays.where(F.size("toks") > need).select(F.explode(F.arrays_zip(F.slice("toks", 1, F.size("toks") - need).alias("left"), F.slice("toks", need + 1, F.size("toks") - need).alias("right"))).alias("p"))
    t = F.size("tail")
    ends = _following(arrays, need)
    reach = F.slice("following", need - t + 1, t)
    across = ends.select(F.explode(F.arrays_zip(F.slice("tail", 1, F.size(reach)).alias("left"), reach.alias("right"))).alias("p"))
    return inside.select("p.left", "p.right").unionByName(across.select("p.left", "p.right"))


def raw_pairs(arrays: DataFrame, skip: int = 0) -> DataFrame:
    """(left, right, c): counts of each_pair."""
    return each_pair(arrays, skip).groupBy("left", "right").agg(F.count("*").alias("c"))


def bigram_rows(ids: DataFrame, skip: int = 0) -> DataFrame:
    """(i, js, ns): counts of pairs by their first index, at most ROW_PAIRS in a
    row; the second indices rise inside a row. Pairs are counted in slices
    and travel as arrays, sorted, so that parts are merged rather than hashed. An
    index under HOT_PARTS has its pairs in many parts, any other in one."""
    ship(ids.sparkSession)
    need, hot = skip + 1, V.HOT_PARTS
    own = ids.select("doc_id", F.col("ids").alias("toks"))
    parts = int(max(64, -(-(ids.agg(F.sum(F.size("ids"))).first()[0] or 0) // PART_PAIRS)))
    across = _following(own, need).select(F.concat("tail", "following").alias("ids"))

    def deal(keys: np.ndarray) -> pa.RecordBatch:
        keys, n = np.unique(keys, return_counts=True)
        i = keys >> 32
        mixed = np.where(i < hot, keys, i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        part = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(parts)
        order = np.argsort(part.astype(np.int32), kind="stable")
        per = np.bincount(part.astype(np.int64), minlength=parts)
        used = np.flatnonzero(per)
        keys = keys[order]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(lists(x.astype(np.int32), per[used]) for x in (keys >> 32, keys & 0xFFFFFFFF, n[order]))], names=["part", "i", "j", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for b in row_slices(batch, "ids", SLICE_PAIRS // 4):
                sizes = b.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                flat = b.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.repeat(np.cumsum(sizes), sizes)
                at = np.flatnonzero(np.arange(len(flat)) + need < ends)
                held.append(flat[at] << 32 | flat[at + need] & 0xFFFFFFFF)
                size += len(at)
                if size >= SLICE_PAIRS:
                    yield deal(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield deal(np.concatenate(held))

    def merge(group: pa.Table) -> pa.Table:
        i, j, n = (group.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j", "n"))
        keys = i << 32 | j & 0xFFFFFFFF
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        n, keys = np.add.reduceat(n[order], first), keys[first]
        i = keys >> 32
        begin = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        begin = np.unique(np.r_[begin, np.arange(0, len(i), ROW_PAIRS)])
        per = np.diff(np.r_[begin, len(i)])
        return pa.table({"i": i[begin].astype(np.int32), "js": lists(keys.astype(np.int32), per), "ns": lists(n, per)})

    counted = ids.select("ids").unionByName(across).mapInArrow(count, "part int, i array<int>, j array<int>, n array<int>")
    return counted.groupBy("part").applyInArrow(merge, "i int, js array<int>, ns array<long>")


def pair_cells(rows: DataFrame) -> DataFrame:
    """(i, j, n) of bigram_rows."""
    return rows.select("i", F.explode(F.arrays_zip("js", "ns")).alias("c")).select("i", F.col("c.js").alias("j"), F.col("c.ns").alias("n"))


def bigram_counts(rows: DataFrame, vocab: DataFrame, skip: int = 0) -> DataFrame:
    """(i, j, n) over type indices of documents in a form that as_ids takes."""
    return pair_cells(bigram_rows(as_ids(rows, vocab), skip))


def cross_bigrams(arrays: DataFrame | V.Texts, rows: DataFrame, columns: DataFrame, skip: int = 0, transpose: bool = False) -> DataFrame:
    """(i, j, n) with the row index from one vocabulary and the column index
    from another; pairs with a type that either lacks are dropped."""
    v = lambda d, t, i: d.select(F.col("type").alias(t), F.col("idx").alias(i))
    pairs = raw_pairs(arrays.arrays() if isinstance(arrays, V.Texts) else arrays, skip)
    left, right = ("right", "left") if transpose else ("left", "right")
    out = pairs.join(v(rows, left, "i"), left).join(v(columns, right, "j"), right)
    return out.groupBy("i", "j").agg(F.sum("c").alias("n"))


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in cells.columns if c not in ("i", "j")])


def concat_columns(a: DataFrame, b: DataFrame, offset: int) -> DataFrame:
    """[A B] of (i, j, v): B's columns come after the first `offset`."""
    return a.unionByName(b.withColumn("j", F.col("j") + offset))


def margins(cells: DataFrame) -> DataFrame:
    """(side, idx, total): row and column sums of (i, j, n)."""
    return cells.groupBy(F.col("i").alias("idx")).agg(F.sum("n").alias("total")).select(F.lit("row").alias("side"), "idx", "total").unionByName(
        cells.groupBy(F.col("j").alias("idx")).agg(F.sum("n").alias("total")).select(F.lit("column").alias("side"), "idx", "total")
    )


def frequencies(vocab: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """(first indices, frequencies) of the runs of equally frequent types, if
    indices go by frequency as ranked() gives them; else None. N tokens have
    at most sqrt(2 N) different frequencies."""
    runs = sorted(tuple(r) for r in vocab.groupBy("freq").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n")).select("lo", "hi", "n", "freq").collect())
    upto = 0
    for lo, hi, n, _ in runs:
        if lo != upto or hi - lo + 1 != n:
            return None
        upto = hi + 1
    return np.array([r[0] for r in runs], np.int64), np.array([r[3] for r in runs], np.float64)


def _freq(runs: tuple[np.ndarray, np.ndarray], idx: np.ndarray) -> np.ndarray:
    """Frequencies of types; tokens without a type weigh nothing."""
    return np.where(idx < 0, np.inf, runs[1][np.maximum(np.searchsorted(runs[0], idx, "right") - 1, 0)])


def scaled_rows(rows: DataFrame, how: str, runs: tuple[np.ndarray, np.ndarray] | None, over_types: bool = False) -> Packed:
    """document_rows, scaled by w, r, c, b or n as scale_documents does with the
    types' frequencies as column sums; over_types also divides by the square
    roots of these."""

    def weigh(i: np.ndarray, j: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        m = np.repeat(np.add.reduceat(n, np.cumsum(sizes) - sizes), sizes) if how in "rbn" else None
        v = {"w": lambda: n, "r": lambda: n / np.sqrt(m), "c": lambda: n / np.sqrt(_freq(runs, j)), "b": lambda: n / np.sqrt(m * _freq(runs, j)), "n": lambda: n / m}[how]()
        return v / np.sqrt(_freq(runs, j)) if over_types else v

    return Packed(rows.select(F.col("doc_id").cast("long").alias("i"), "js", "ns"), weigh)


_BIGRAM_SCALES = {
    "w": lambda n, fi, fj: n,
    "r": lambda n, fi, fj: n / np.sqrt(fi()),
    "c": lambda n, fi, fj: n / np.sqrt(fj()),
    "b": lambda n, fi, fj: n / np.sqrt(fi() * fj()),
    "left": lambda n, fi, fj: n / fi(),
    "right": lambda n, fi, fj: n / fj(),
}


def scaled_bigram_rows(rows: DataFrame, how: str, runs: tuple[np.ndarray, np.ndarray]) -> Packed:
    """bigram_rows, scaled as scale_bigrams does."""
    if how not in _BIGRAM_SCALES:
        raise ValueError(f"no scaling {how!r}; one of {' '.join(_BIGRAM_SCALES)}")

    def weigh(i: np.ndarray, j: np.ndarray, n: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return _BIGRAM_SCALES[how](n, lambda: np.repeat(_freq(runs, i), sizes), lambda: _freq(runs, j))

    return Packed(rows.select(F.col("i").cast("long").alias("i"), "js", "ns"), weigh)


def scale_bigrams(cells: DataFrame, vocab: DataFrame, how: str) -> DataFrame:
    """(i, j, v): by type frequencies. r, c, b: 1/sqrt on rows, columns, both;
    left, right: 1/freq on rows or columns; w: raw. Where indices go by
    frequency, the few runs of equal frequencies are sent out; else types are
    joined."""
    if how not in _BIGRAM_SCALES:
        raise ValueError(f"no scaling {how!r}; one of {' '.join(_BIGRAM_SCALES)}")
    vocab = settled(vocab)
    if runs := frequencies(vocab):
        ship(cells.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, j, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "n"))
                yield pa.RecordBatch.from_arrays([b.column("i"), b.column("j"), pa.array(_BIGRAM_SCALES[how](n, lambda: _freq(runs, i), lambda: _freq(runs, j)).astype(np.float64))], names=["i", "j", "v"])  # noqa: B023

        kinds, known = dict(cells.dtypes), [c for c in "ij" if how in ({"i": ("r", "b", "left"), "j": ("c", "b", "right")}[c])]
        for c in known:
            cells = cells.where(F.col(c) >= 0)
        return cells.select("i", "j", F.col("n").cast("double").alias("n")).mapInArrow(run, f"i {kinds['i']}, j {kinds['j']}, v double")
    fi = vocab.select(F.col("idx").alias("i"), F.col("freq").cast("double").alias("fi"))
    fj = vocab.select(F.col("idx").alias("j"), F.col("freq").cast("double").alias("fj"))
    n = F.col("n").cast("double")
    value = {"w": n, "r": n / F.sqrt("fi"), "c": n / F.sqrt("fj"), "b": n / F.sqrt(F.col("fi") * F.col("fj")), "left": n / F.col("fi"), "right": n / F.col("fj")}
    out = cells
    if how in ("r", "b", "left"):
        out = out.join(fi, "i")
    if how in ("c", "b", "right"):
        out = out.join(fj, "j")
    return out.select("i", "j", value[how].alias("v"))


def unified_matrix(cells: DataFrame, rows: DataFrame, vocab: DataFrame, n_types: int) -> DataFrame:
    """(i, j, v) of [F^-1/2 B F^-1/2 | F^-1/2 W']: types by types and documents;
    documents' columns are n_types + doc_id. W's rows, of document_rows, sum to
    one."""
    b = scale_bigrams(cells, vocab, "b")
    w = scaled_rows(rows, "n", frequencies(vocab), over_types=True).cells().where("j >= 0")
    return concat_columns(b.withColumn("j", F.col("j").cast("long")), w.select(F.col("j").cast("int").alias("i"), F.col("i").alias("j"), "v"), n_types)
