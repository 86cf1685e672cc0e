"""Vocabularies: token counts, out-of-vocabulary collapse and rank index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut, discard, ship

OOV, EOL = "OOV", "EOL"


def token_arrays(docs: DataFrame, skip_initial: int = 0, mark_eol: bool = False, cleaner=None) -> DataFrame:
    """(doc_id, toks) of docs(doc_id, text): white-space tokens, the first
    skip_initial dropped, EOL after the last where asked for."""
    text = cleaner(F.col("text")) if cleaner else F.col("text")
    toks = T.drop_first(T.tokens(text), skip_initial)
    return docs.select("doc_id", (F.concat(toks, F.array(F.lit(EOL))) if mark_eol else toks).alias("toks"))


def tokens(docs: DataFrame, skip_initial: int = 0, mark_eol: bool = False, cleaner=None) -> DataFrame:
    """(doc_id, pos, tok), one row a token."""
    return token_arrays(docs, skip_initial, mark_eol, cleaner).select("doc_id", F.posexplode("toks").alias("pos", "tok"))


def type_counts(toks: DataFrame) -> DataFrame:
    """(type, freq) of every type."""
    return toks.groupBy(F.col("tok").alias("type")).agg(F.count("*").alias("freq"))


def collapse(counts: DataFrame, min_freq: int = 3) -> DataFrame:
    """(type, freq): types rarer than min_freq summed under OOV. A literal OOV
    token adds to that sum."""
    kept = F.when(F.col("freq") < min_freq, F.lit(OOV)).otherwise(F.col("type"))
    return counts.groupBy(kept.alias("type")).agg(F.sum("freq").alias("freq"))


def ranked(types: DataFrame) -> DataFrame:
    """types with idx: place by falling frequency, ties by falling type.

    Places come from a running total over (freq, first letters) groups and a
    row number inside each, so no task sorts the whole vocabulary."""
    group = types.withColumn("head", F.substring("type", 1, 2))
    sizes = group.groupBy("freq", "head").agg(F.count("*").alias("n"))
    at = Window.orderBy(F.desc("freq"), F.desc("head"))
    sizes = sizes.select(F.col("freq").alias("f1"), F.col("head").alias("h1"), (F.sum("n").over(at) - F.col("n")).alias("before"))
    inside = Window.partitionBy("freq", "head").orderBy(F.desc("type"))
    numbered = group.withColumn("inside", F.row_number().over(inside))
    both = numbered.join(sizes, (F.col("freq") == F.col("f1")) & (F.col("head") == F.col("h1")))
    return both.select(*types.columns, (F.col("before") + F.col("inside") - 1).cast("int").alias("idx"))


def rare_types(counts: DataFrame, min_freq: int = 3) -> DataFrame:
    """The types that OOV stands for, with their counts."""
    return counts.where(F.col("freq") < min_freq)


#: Tokens of so many types, the most frequent, get their index where they are
#: read. Rows of pairs of the HOT_PARTS most frequent types are dealt out by both
#: indices, those of other types by the first.
BROADCAST_TYPES, HOT_PARTS = 1 << 17, 4096
SLICE_TOKENS = 1 << 20


def settled(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a written table, so that several steps read one
    result."""
    return vocab if hasattr(vocab, "_tessera_path") else cut(vocab, "types")


def _lengths(column: pa.Array) -> np.ndarray:
    n = column.value_lengths() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)
    return n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about `most` list items, or bytes
    of text, each."""
    ends = np.cumsum(_lengths(batch.column(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """A list column of consecutive runs of values."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values if isinstance(values, pa.Array) else pa.array(values))


@dataclass
class Texts:
    """docs(doc_id, text) whose white-space tokens are split in Arrow where they
    are read, or arrays(doc_id, toks)."""

    frame: DataFrame
    skip_initial: int = 0
    mark_eol: bool = False

    @property
    def column(self) -> str:
        return "toks" if "toks" in self.frame.columns else "text"

    def arrays(self) -> DataFrame:
        """(doc_id, toks)."""
        return self.frame if self.column == "toks" else token_arrays(self.frame, self.skip_initial, self.mark_eol)

    def rows(self) -> DataFrame:
        return self.frame.select("doc_id", self.column)

    def reader(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
        """Of batches of rows(): (slice, flat tokens, tokens a row)."""
        column, skip, eol = self.column, self.skip_initial, self.mark_eol

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for b in row_slices(batch, column, SLICE_TOKENS if column == "toks" else 8 * SLICE_TOKENS):
                    if column == "toks":
                        yield b, b.column(column).flatten().cast(pa.string()), _lengths(b.column(column))
                        continue
                    text = b.column(column).cast(pa.large_string()).fill_null("")
                    parts = pc.ascii_split_whitespace(text)
                    flat = parts.flatten()
                    row = np.repeat(np.arange(len(text)), _lengths(parts))
                    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
                    if skip or not full.all():
                        if skip:
                            upto = np.cumsum(full)
                            begin = np.searchsorted(row, np.arange(len(text)))
                            full &= upto - np.r_[0, upto][begin][row] > skip
                        flat, row = flat.filter(pa.array(full)), row[full]
                    sizes = np.bincount(row, minlength=len(text))
                    flat = flat.cast(pa.string())
                    if eol:
                        at = np.arange(len(flat)) + row
                        order = np.full(len(flat) + len(text), len(flat))
                        order[at] = np.arange(len(flat))
                        flat, sizes = pa.concat_arrays([flat, pa.array([EOL])]).take(pa.array(order)), sizes + 1
                    yield b, flat, sizes

        return read

    def type_counts(self) -> DataFrame:
        """(type, freq) of every type; counted by slices first."""
        ship(self.frame.sparkSession)
        read = self.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, flat, _ in read(batches):
                n = flat.value_counts()
                yield pa.RecordBatch.from_arrays([n.field(0), n.field(1)], names=["type", "n"])

        return self.rows().mapInArrow(run, "type string, n long").groupBy("type").agg(F.sum("n").alias("freq"))

    def lengths(self) -> DataFrame:
        """(doc_id, m): tokens of each document that has any."""
        ship(self.frame.sparkSession)
        read = self.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, _, sizes in read(batches):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes.astype(np.int64))], names=["doc_id", "m"])

        return self.rows().mapInArrow(run, f"doc_id {dict(self.frame.dtypes)['doc_id']}, m long").where("m > 0").groupBy("doc_id").agg(F.sum("m").alias("m"))


def indexed_arrays(arrays: DataFrame | Texts, vocab: DataFrame) -> DataFrame:
    """(doc_id, ids), written: the type index of every token of Texts or of
    arrays(doc_id, toks) in its order; unknown tokens get that of OOV, or -1 where the
    vocabulary has none. The most frequent types are sent out; tokens of the
    others, each of them rare, travel by themselves and come back to their row."""
    vocab, texts = settled(vocab), arrays if isinstance(arrays, Texts) else Texts(arrays)
    ship(texts.frame.sparkSession)
    read = texts.reader()
    size = vocab.count()
    oov = vocab.where(F.col("type") == OOV).agg(F.coalesce(F.max("idx"), F.lit(-1)).cast("int")).first()[0]
    lead = vocab.where(F.col("idx") < BROADCAST_TYPES).select(F.col("type").cast("string"), F.col("idx").cast("int")).toArrow().combine_chunks()
    names, index = pa.array(lead.column(0).to_pylist(), pa.string()), lead.column(1).to_numpy()
    whole = size <= BROADCAST_TYPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, flat, sizes in read(batches):
            coded = flat.dictionary_encode(null_encoding="encode")
            at = pc.index_in(coded.dictionary, value_set=names, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.where(at >= 0, index[at] if len(index) else -1, oov if whole else -1).astype(np.int32)
            codes = coded.indices.to_numpy(zero_copy_only=False)
            ids = known[codes] if len(codes) else np.zeros(0, np.int32)
            columns, n = [b.column("doc_id"), lists(ids, sizes)], ["doc_id", "ids"]
            if not whole:
                far = ids < 0
                upto = np.r_[0, np.cumsum(far)]
                ends = np.r_[0, np.cumsum(sizes)]
                columns.append(lists(coded.dictionary.take(pa.array(codes[far])), np.diff(upto[ends])))
                n.append("far")
            yield pa.RecordBatch.from_arrays(columns, names=n)

    kind = dict(texts.frame.dtypes)["doc_id"]
    first = texts.rows().mapInArrow(run, f"doc_id {kind}, ids array<int>" + ("" if whole else ", far array<string>"))
    if whole:
        return cut(first, "ids")
    first = cut(first.withColumn("row", F.monotonically_increasing_id()), "ids")
    rest = vocab.where(F.col("idx") >= BROADCAST_TYPES).select(F.col("type").alias("_t"), F.col("idx").cast("int").alias("idx"))
    far = first.select("row", F.posexplode("far").alias("k", "tok")).join(rest, F.col("tok") == F.col("_t"))
    back = far.groupBy("row").agg(F.collect_list(F.struct("k", "idx")).alias("f")).select(F.col("row").alias("_row"), F.col("f.k").alias("k"), F.col("f.idx").alias("idx"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in row_slices(batch, "ids", SLICE_TOKENS):
                sizes, found = (b.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in ("ids", "k"))
                ids = b.column("ids").flatten().to_numpy(zero_copy_only=False).copy()
                open_ = np.flatnonzero(ids < 0)
                start = np.searchsorted(open_, np.r_[0, np.cumsum(sizes)[:-1]])
                k, idx = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("k", "idx"))
                ids[open_] = oov
                ids[open_[np.repeat(start, found) + k]] = idx
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(ids, sizes)], names=["doc_id", "ids"])

    both = first.drop("far").join(back, F.col("row") == F.col("_row"), "left").select("doc_id", "ids", "k", "idx")
    out = cut(both.mapInArrow(fill, f"doc_id {kind}, ids array<int>"), "ids")
    discard(first)
    return out


def totals(docs: DataFrame, counts: DataFrame, min_freq: int = 3) -> DataFrame:
    """One row: n_lines, n_tokens, n_types, n_kept, n_oov."""
    rare = F.col("freq") < min_freq
    own = counts.agg(F.sum("freq").alias("n_tokens"), F.count("*").alias("n_types"), F.count_if(~rare).alias("n_kept"), F.coalesce(F.sum(F.when(rare, F.col("freq"))), F.lit(0)).alias("n_oov"))
    return docs.agg(F.count("*").alias("n_lines")).crossJoin(own)


def top_share(counts: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, share): the part of all tokens that the k most frequent types hold."""
    top = counts.orderBy(F.desc("freq"), F.desc("type")).limit(max(ks))
    place = Window.orderBy(F.desc("freq"), F.desc("type"))
    cumulative = top.select(F.row_number().over(place).alias("k"), F.sum("freq").over(place.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    whole = counts.agg(F.sum("freq").alias("total"))
    return cumulative.where(F.col("k").isin(*ks)).crossJoin(whole).select("k", (F.col("c") / F.col("total")).alias("share"))


def zipf(counts: DataFrame, top: int = 500) -> DataFrame:
    """One row (slope, intercept) of ln freq on ln rank over the top types."""
    best = counts.orderBy(F.desc("freq"), F.desc("type")).limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.desc("type")))
    logs = best.select(F.log("freq").alias("y"), F.log(rank).alias("x"))
    return logs.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


@dataclass
class Vocabulary:
    """A corpus's vocabulary, as frames that compute when asked.

    types: (type, freq, idx) after the collapse; oov: the collapsed types."""

    docs: DataFrame
    skip_initial: int = 0
    mark_eol: bool = True
    min_freq: int = 3

    def __post_init__(self) -> None:
        self.arrays = token_arrays(self.docs, self.skip_initial, self.mark_eol)
        self.tokens = self.arrays.select("doc_id", F.posexplode("toks").alias("pos", "tok"))
        self.texts = Texts(self.docs, self.skip_initial, self.mark_eol)
        self.counts = self.texts.type_counts()
        self._types = self._ids = None
        self.oov = rare_types(self.counts, self.min_freq)

    @property
    def types(self) -> DataFrame:
        """(type, freq, idx), written once: every use reads the same table."""
        if self._types is None:
            self._types = cut(ranked(collapse(self.counts, self.min_freq)), "types")
        return self._types

    @property
    def ids(self) -> DataFrame:
        """(doc_id, ids): the documents as type indices, written once."""
        if self._ids is None:
            self._ids = indexed_arrays(self.texts, self.types)
        return self._ids

    def n_types(self) -> int:
        return self.types.count()

    def n_tokens(self) -> int:
        return self.counts.agg(F.coalesce(F.sum("freq"), F.lit(0))).first()[0]

    def type_index(self, word: str) -> int | None:
        """The index of a word, OOV's where it is unknown."""
        rows = {r["type"]: r["idx"] for r in self.types.where(F.col("type").isin(word, OOV)).collect()}
        return rows.get(word, rows.get(OOV))

    def top(self, k: int = 10) -> DataFrame:
        return self.types.orderBy(F.desc("freq"), F.desc("type")).limit(k)

    def frequencies(self) -> DataFrame:
        """Types with counts in lexicographic order."""
        return self.types.select("type", "freq").orderBy("type")

    def first_oov(self, n: int) -> DataFrame:
        return self.oov.orderBy("type").limit(n)

    def bigrams(self, skip: int = 0) -> DataFrame:
        from tessera.operators.counts import bigram_counts

        return bigram_counts(self.ids, self.types, skip)

    def document_counts(self) -> DataFrame:
        from tessera.operators.counts import document_counts

        return document_counts(self.ids, self.types)


def lowercase_types(lines: DataFrame, downcase: bool = True) -> DataFrame:
    """(type): the distinct tokens of lines(text)."""
    c: Column = T.ascii_lower(F.col("text")) if downcase else F.col("text")
    return lines.select(F.explode(T.tokens(c)).alias("type")).distinct()
