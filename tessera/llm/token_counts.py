"""Token counts without ids (op9).

1. Documents go through in slices of SLICE bytes. A slice has its distinct
   pre-tokens, numbered, and for each document the numbers with their
   frequencies. A pre-token is a run of the model's space marks with the run of
   other characters after it: no piece of the vocabulary holds a mark after
   another character (checked when the model is loaded), so pieces never cross
   from one pre-token to the next.
2. The distinct pre-tokens of all slices meet in one shuffle by pre-token,
   sorted, and the library counts the pieces of each distinct one once.
3. Counts, packed by slice in runs of ROWS, join the frequencies by slice and
   number, and are summed by document.

Per slice a pre-token travels once, however often it occurs, so common ones are
no hot keys; frequencies travel packed. Slices are made twice from the same
rows, once for each side of the join; their key is a hash of their pre-tokens,
and rows that came out differently the second time raise an error.

Defined results: null and empty texts have 0 bytes and 0 tokens; doc_id may be
null or repeated, each row gets its own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.words import Held, numbered, raw, slices, strings
from tessera.session import ship

DEFAULT_FILE = "piece_bpe_32k.model"
LIMIT, SLICE, ROWS = 4096, 8 << 20, 1 << 20
MARK = "▁".encode()
_INSTANCES: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts of a sentencepiece model's pieces, by distinct pre-token."""

    def __init__(self, path: str, most: int = 64 << 20):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.library.id_to_piece(i) for i in range(self.library.get_piece_size()))
        if any("▁" in n.lstrip("▁") for n in names) or self.library.encode(" x y", out_type=str)[0][0] != "▁":
            raise ValueError("this model's pieces cross spaces; its pre-tokens can't be counted apart")
        self.counts = Held(most)
        self.single = len(self.library.encode("a ")) - len(self.library.encode("a"))

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        if path not in _INSTANCES:
            _INSTANCES[path] = cls(path)
        _INSTANCES[path].counts.claim()
        return _INSTANCES[path]

    def pieces(self, pretokens: list[bytes]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        out = list(map(self.counts.get, pretokens))
        new = [k for k, n in enumerate(out) if n is None]
        texts = [pretokens[k].decode("utf-8", "replace").replace("▁", " ") for k in new]
        for k, ids in zip(new, self.library.encode(texts, num_threads=1) if new else [], strict=True):
            out[k] = len(ids) if pretokens[k] else self.single
            self.counts.keep(pretokens[k], out[k])
        return np.array(out, np.int64)


def pretokens(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all texts, each without the mark that it begins with;
    offsets of texts among them)."""
    data, offsets = raw(column)
    if len(data) > 2 and MARK in data.tobytes():  # marks inside a text act as spaces
        texts = [bytes(data[a:b]).replace(MARK, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        data, offsets = raw(pa.array(texts, pa.binary()))
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    first = first[:n]
    space = data == 32
    begins = space.copy()  # the first space of a run begins a pre-token and is its mark; a text's start has a mark of its own
    begins[1:] &= ~space[:-1] | first[1:]
    begins[first] = False
    event = np.flatnonzero(begins | first)
    own = begins[event]
    start = event + own - np.cumsum(own)  # among the bytes that stay
    size = n - int(np.count_nonzero(begins))
    return strings(data[~begins], np.append(start, size)), np.searchsorted(event, offsets)


class Slice:
    """Distinct pre-tokens of some texts, and their frequencies by text."""

    def __init__(self, column: pa.Array):
        import xxhash

        items, at = pretokens(column)
        found = items.dictionary_encode()
        self.words, numbers = found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = raw(self.words)
        self.key = xxhash.xxh3_64_intdigest(data.tobytes() + offsets.tobytes()) - (1 << 63)
        self.texts, self.n_bytes = len(column), np.diff(raw(column)[1])
        text = np.repeat(np.arange(len(column)), np.diff(at))
        pairs, self.times = np.unique(text * len(self.words) + numbers, return_counts=True)
        self.numbers = pairs % max(len(self.words), 1)
        self.sizes = np.bincount(pairs // max(len(self.words), 1), minlength=len(column)) if len(column) else np.zeros(0, np.int64)


def packed(numbers: np.ndarray, values: np.ndarray) -> bytes:
    """Steps between numbers, and values, by bytes of equal weight, compressed."""
    import zstandard

    steps = np.diff(numbers, prepend=0)  # a step may go back
    return zstandard.ZstdCompressor(1).compress(b"".join(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (steps, values)))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and values of packed()."""
    import zstandard

    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(2, 4, -1)
    steps, values = (x.T.copy().view("<i4")[:, 0].astype(np.int64) for x in both)
    return np.cumsum(steps), values


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    import public_tokenizers

    path = path or public_tokenizers.path(DEFAULT_FILE)
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.token_counts import Slice

        for b in slices(batches, most=SLICE):
            one = Slice(b.column("text"))
            n = len(one.words)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, one.key)), pa.array(np.arange(n), pa.int32()), one.words.view(pa.binary())], names=["key", "number", "word"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.token_counts import Slice

        for b in slices(batches, most=SLICE):
            if b.num_rows:
                one = Slice(b.column("text"))
                row = {"key": one.key, "words": len(one.words), "n_bytes": one.n_bytes.tolist(), "sizes": one.sizes.tolist(), "packed": packed(one.numbers, one.times)}
                arrays = [pa.array([row[c]], t) for c, t in (("key", pa.int64()), ("words", pa.int64()), ("n_bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("packed", pa.binary()))]
                ids = b.column("doc_id")
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], names=[*row, "doc_ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.token_counts import PieceCounter, packed

        counter = PieceCounter.of(path)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, number, n = (np.concatenate([h[c] for h in held]) for c in range(3))
            order = np.lexsort((number, key))
            key, number, n = key[order], number[order], n[order]
            at = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            data = [packed(x, y) for x, y in zip(np.split(number, at[1:]), np.split(n, at[1:]), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(data, pa.binary())], names=["key", "packed"])

        for b in batches:
            if b.num_rows:
                numbers, words = numbered(b.column("word"))
                held.append((b.column("key").to_numpy(), b.column("number").to_numpy().astype(np.int64), counter.pieces(words)[numbers]))
            if sum(len(h[0]) for h in held) >= ROWS:
                yield flush()
                held = []
        if held:
            yield flush()

    def add(counts: pa.Table, freqs: pa.Table) -> pa.Table:
        from tessera.llm.token_counts import unpacked

        out: list[pa.Table] = []
        parts = [unpacked(x) for x in counts.column("packed").to_pylist()]
        for row in range(freqs.num_rows):
            size = freqs.column("words")[row].as_py()
            known = np.full(size, -1, np.int64)
            for number, n in parts:
                known[number] = n
            if (known < 0).any():
                raise RuntimeError("documents changed between two readings; write them to a table first")
            sizes = freqs.column("sizes")[row].values.to_numpy()
            numbers, times = unpacked(freqs.column("packed")[row].as_py())
            total = np.concatenate([[0], np.cumsum(known[numbers] * times)]) if size else np.zeros(1, np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            tokens = total[ends[1:]] - total[ends[:-1]]
            out.append(pa.table({"doc_id": freqs.column("doc_ids")[row].values, "n_bytes": freqs.column("n_bytes")[row].values, "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)}))
        if counts.num_rows and not out:
            raise RuntimeError("documents changed between two readings; write them to a table first")
        return pa.concat_tables(out)

    words = docs.mapInArrow(distinct, "key long, number int, word binary")
    counts = words.repartition("word").sortWithinPartitions("word").mapInArrow(pieces, "key long, packed binary")
    freqs = docs.mapInArrow(frequencies, f"key long, words long, n_bytes array<long>, sizes array<long>, packed binary, doc_ids array<{kind}>")
    return counts.groupBy("key").cogroup(freqs.groupBy("key")).applyInArrow(add, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
