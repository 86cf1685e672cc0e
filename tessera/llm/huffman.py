"""Token ids in files of length-limited canonical Huffman codes (op2).

Steps: ids per document (public tokenizer, end id appended) are written once to
the shared folder; their counts, summed over the whole table, give one
canonical code of at most LIMIT bits (package-merge); documents are range
partitioned and sorted by doc_id, and each partition writes blocks of whole
documents; blocks are read back and decoded by table look-up.

File format: Parquet rows (part, block, first_doc_id, n_docs, n_tokens,
tokens_before: of the part's earlier blocks, data), in ascending doc_id order over parts and blocks, beside one row with the code
lengths of all ids. `data` is self-contained (little-endian):
magic "THC1" | uint32 documents | uint64 tokens | uint64 bits |
uint32 tokens a checkpoint | uint32 null doc_ids | int64 doc_id x documents |
uint32 tokens x documents | uint64 bit offset x checkpoints | uint64 bit words
(most significant bit first). A block decodes without any other block, and
inside it every checkpoint starts a lane of its own, so that all lanes advance
together through the look-up table.

Defined results: null and empty texts hold the end id alone; null doc_ids sort
first; repeated doc_ids keep their rows, ordered by length and ids; an empty
table gives files without blocks and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.wordbpe import WordBpe, crc_of, tokenizer_path
from tessera.llm.words import slices
from tessera.session import cut, discard, shared_dir, ship

END_ID = 1
LIMIT = 18
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 128
IDS = 1 << 16
_HEAD = struct.Struct("<4sIQQII")


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0: no code."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    marks, merged = [], leaves
    for level in range(limit):
        if level:
            pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            at = np.argsort(both, kind="stable")
            marks.append(at < len(leaves))
            merged = both[at]
        else:
            marks.append(np.ones(len(leaves), bool))
    take, got = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for mark in reversed(marks):
        n = int(mark[:take].sum())
        got[:n] += 1
        take = 2 * (take - n)
    lengths[order] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as canonical Huffman codes are given."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - before
        at = np.flatnonzero(lengths == n)
        codes[at] = np.arange(code, code + len(at), dtype=np.uint64)
        code, before = code + len(at), n
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """For each window of limit bits: id << 8 | length."""
    table = np.zeros(1 << limit, np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    values = order.astype(np.uint32) << 8 | lengths[order]
    filled = np.repeat(values, spans)
    table[: len(filled)] = filled
    return table


def encode_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids' bits in uint64 words, and each id's bit offset with the end."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    words = np.zeros(int(offsets[-1] >> 6) + 2, np.uint64)
    if not len(ids):
        return words, offsets
    start, value = offsets[:-1], codes[ids]
    word, room = start >> 6, 64 - (start & 63) - n
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.add.reduceat(high, first)  # bits are disjoint: a sum is an or
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words, offsets


def encode_block(keys: list[int | None], docs: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint16)
    words, offsets = encode_bits(ids, codes, lengths)
    nulls = sum(k is None for k in keys)
    head = _HEAD.pack(b"THC1", len(docs), len(ids), int(offsets[-1]), CHECKPOINT, nulls)
    table = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([len(d) for d in docs], "<u4").tobytes()
    return head + table + offsets[:-1:CHECKPOINT].astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode_block(data: bytes, table: np.ndarray, limit: int = LIMIT) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, tokens of each document and all ids of a block."""
    magic, docs, tokens, bits, step, nulls = _HEAD.unpack_from(data)
    if magic != b"THC1":
        raise ValueError("this isn't a block of token ids")
    at = _HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    sizes = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    at += 12 * docs
    lanes = -(-tokens // step)
    position = np.frombuffer(data, "<u8", lanes, at).astype(np.int64)
    raw = np.frombuffer(data, np.uint8, -1, at + 8 * lanes).view("<u8").astype(np.uint64)
    words = np.concatenate([raw, np.zeros(1, np.uint64)])
    out = np.zeros((step, lanes), np.uint16)
    down, mask = np.uint64(64 - limit), np.int64(63)
    for k in range(step):
        if k and lanes and (lanes - 1) * step + k >= tokens:  # the last lane has ended
            position = position[: lanes - 1]
        if not len(position):
            break
        word, bit = position >> 6, (position & mask).astype(np.uint64)
        window = words[word] << bit | (words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit)
        hit = table[window >> down]
        out[k, : len(position)] = hit >> 8
        position = position + (hit & 255)
    ids = out.T.reshape(-1)[:tokens]
    return [None] * nulls + keys[nulls:].tolist(), sizes, ids


def tokenise(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (zstd of little-endian uint16) of docs. The first
    row of each slice also carries the slice's counts of ids, so that nobody
    has to unpack the ids to count them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from tessera.llm.wordbpe import WordBpe

        bpe, press = WordBpe.of(path), zstandard.ZstdCompressor(1)
        for b in slices(batches):
            ids = bpe.encode(b.column("text"), end_id)
            counts = np.bincount(np.concatenate(ids), minlength=IDS) if ids else np.zeros(0, np.int64)
            used = np.flatnonzero(counts)
            first = [used.astype("<u2").tobytes() + counts[used].astype("<u4").tobytes()] if ids else []
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([press.compress(x.tobytes()) for x in ids], pa.binary()), pa.array(first + [None] * (len(ids) - 1), pa.binary())],
                names=["doc_id", "n_tokens", "ids", "counts"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def _unpacked(b: pa.RecordBatch) -> list[np.ndarray]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    return [np.frombuffer(press.decompress(x), "<u2") for x in b.column("ids").to_pylist()]


def id_counts(ids: DataFrame) -> np.ndarray:
    """Occurrences of every id over the whole table; the vocabulary bounds what
    reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for b in batches:
            for one in b.column("counts").to_pylist():
                n = len(one) // 6
                total[np.frombuffer(one, "<u2", n)] += np.frombuffer(one, "<u4", n, 2 * n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.where("counts is not null").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(IDS, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, out: str, path: str | None = None, end_id: int = END_ID, limit: int = LIMIT) -> np.ndarray:
    """Encode docs(doc_id, text) into files below out; the code lengths."""
    spark = docs.sparkSession
    ship(spark)
    ids = cut(tokenise(docs, path or tokenizer_path(), end_id), "ids")
    lengths = code_lengths(id_counts(ids), limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm.huffman import canonical, encode_block

        part, block, codes = TaskContext.get().partitionId(), 0, canonical(lengths)
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            row = [part, block, keys[0], len(keys), tokens, before, encode_block(keys, held, codes, lengths)]
            kinds = (pa.int32(), *[pa.int64()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "first_doc_id", "n_docs", "n_tokens", "tokens_before", "data"])

        tokens = before = 0
        for b in batches:
            for key, one in zip(b.column("doc_id").to_pylist(), _unpacked(b), strict=True):
                keys.append(key)
                held.append(one)
                tokens += len(one)
                if tokens >= BLOCK_TOKENS:
                    yield flush()
                    keys, held, tokens, before, block = [], [], 0, before + tokens, block + 1
        if keys:
            yield flush()

    ordered = ids.drop("counts").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    blocks = ordered.mapInArrow(run, "part int, block long, first_doc_id long, n_docs long, n_tokens long, tokens_before long, data binary")
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    spark.createDataFrame([(limit, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{out}/code")
    discard(ids)
    return lengths


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files below out: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, and with with_ids the ids as uint16."""
    code = spark.read.parquet(f"{out}/code").first()
    limit, lengths = code["max_bits"], np.frombuffer(bytes(code["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{out}/blocks")
    # one row for each written part: bounded by the number of partitions
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    totals = np.cumsum([0, *[r["n"] for r in parts]])
    before = {r["part"]: int(t) for r, t in zip(parts, totals[:-1], strict=True)}
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.huffman import decode_block, decode_table

        table = decode_table(lengths, limit)
        for b in batches:
            for part, inside, data in zip(b.column("part").to_pylist(), b.column("tokens_before").to_pylist(), b.column("data").to_pylist(), strict=True):
                keys, sizes, ids = decode_block(data, table, limit)
                ends = np.cumsum(sizes, dtype=np.int64)
                each = np.split(ids, ends[:-1])
                columns = [pa.array(keys, pa.int64()), pa.array(before[part] + inside + ends - sizes, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array([crc_of(x) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype("<u2").tobytes() for x in each], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return blocks.select("part", "tokens_before", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def encode_and_read(docs: DataFrame) -> DataFrame:
    """write() to a fresh folder of the shared storage, then read()."""
    out = shared_dir(docs.sparkSession, "token-files")
    write(docs, out)
    return read(docs.sparkSession, out)
