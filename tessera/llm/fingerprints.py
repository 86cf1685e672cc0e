"""Document fingerprints by MinHash (op10).

COUNT universal hash permutations (a * x + b mod 2^64) over the hashes of word
shingles, in vectorised numpy; a fingerprint holds 16 bits of each minimum as
hex digits. The likeness of two fingerprints is the share of equal places,
less what equal 16-bit values give by chance.

`compare_next` walks the table in descending doc_id without a global sort in
one task: documents go to ranges of (doc_id, hash of the text), bounded by a
sample, so that null or repeated doc_ids fill several ranges; each range also
gets a copy of the first document of the range after it (the last range: of the
first), and tasks stream through their sorted ranges.

`near_groups` cuts the fingerprint's COUNT values into BANDS bands, joins
documents that share a band in Spark, and verifies Jaccard on full shingle sets
(the buckets, confirmation and components are those of minmax_dedup, with this
module's signatures). At a likeness of 0.8 two sets share no band with
probability 5e-8.

Defined results: null texts count as empty; texts without words share one
fingerprint; null doc_ids come last; of repeated doc_ids the text of smaller
hash is first; a single document is its own next; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minmax_dedup import band_keys, near_classes
from tessera.llm.shingles import mix, shingles_of, word_hashes
from tessera.llm.words import slices
from tessera.session import ship

COUNT, WORDS, BANDS = 128, 5, 32
SAMPLE = 64  # rows of the sample for each range
_MOST = np.uint64((1 << 64) - 1)


class Family:
    """The permutations, and fingerprints under them."""

    def __init__(self, count: int = COUNT, words: int = WORDS, seed: int = 97):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, np.uint64)
        self.words = words

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of the smallest hash under each permutation."""
        low = np.full(len(self.a), _MOST)
        for at in range(0, len(shingles), 1024):
            np.minimum(low, (self.a[:, None] * shingles[None, at : at + 1024] + self.b[:, None]).min(1), out=low)
        return (mix(low) >> np.uint64(48)).astype(">u2")

    def prints(self, texts: list[str]) -> list[np.ndarray]:
        """The fingerprints of texts."""
        column = pa.array([t.encode("utf-8", "replace") for t in texts], pa.binary())
        return [self.values(shingles_of(w, self.words)) for w in word_hashes(column, lower=False)]

    def sign(self, shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Band keys of the fingerprint, and 8 bits of each value."""
        v = self.values(shingles).astype(np.uint64)
        factors = np.random.default_rng(31).integers(0, 1 << 63, (BANDS, len(v) // BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
        return band_keys(v + np.uint64(1), factors), (v >> np.uint64(8)).astype(np.uint8).tobytes()


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Estimated Jaccard likeness of two fingerprints, 0 to 1."""
    chance = 1 / 65536
    return float(np.clip(((x == y).mean() - chance) / (1 - chance), 0, 1))


def edited(text: str, following: str) -> str:
    """The text, its last third replaced by as many characters of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprint(docs: DataFrame, count: int = COUNT, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint of every row of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.fingerprints import Family

        family = Family(count, words)
        for b in slices(batches):
            prints = [v.tobytes().hex() for v in family.prints([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def _turn(key: int | None, h: int) -> tuple[bool, int, int]:
    """A row's place in the walk: descending ids, nulls last, then the hash."""
    return key is None, -(key or 0), h


def _ranged(docs: DataFrame) -> DataFrame:
    """Rows with their range, and copies of range heads for the range before."""
    ranges = 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    share = min(1.0, SAMPLE * ranges / max(docs.count(), 1))
    # about SAMPLE rows for each range; bounds decide where a row is worked on, not what comes out
    some = sorted(_turn(r["doc_id"], r["h"]) for r in docs.select("doc_id", "h").sample(share, 7).collect())
    bounds = sorted({some[len(some) * k // ranges] for k in range(1, ranges)}) if some else []

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for b in batches:
            for key, h in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), strict=True):
                turn = _turn(key, h)
                at = bisect_right(bounds, turn)
                if at not in best or turn < best[at]:
                    best[at] = turn
        rows = [(at, None if t[0] else -t[1], t[2]) for at, t in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["range", "doc_id", "h"])

    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), (-F.coalesce("doc_id", F.lit(0))).alias("turn"), "h")).alias("m")
    # one row for each range: bounded by the number of partitions
    tops = docs.select("doc_id", "h").mapInArrow(heads, "range int, doc_id long, h long").groupBy("range").agg(least).orderBy("range").collect()
    before = {tuple(r["m"]): tops[k - 1]["range"] for k, r in enumerate(tops)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "copy", "doc_id", "h", "text"]
        for b in batches:
            turns = [_turn(key, h) for key, h in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), strict=True)]
            columns = [b.column(c) for c in names[2:]]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, t) for t in turns], pa.int32()), pa.array([False] * b.num_rows), *columns], names=names)
            again = [k for k, t in enumerate(turns) if t in before]
            if again:
                to = pa.array([before[turns[k]] for k in again], pa.int32())
                yield pa.RecordBatch.from_arrays([to, pa.array([True] * len(again)), *[c.take(pa.array(again)) for c in columns]], names=names)

    return docs.mapInArrow(route, "range int, copy boolean, doc_id long, h long, text string")


def compare_next(docs: DataFrame, count: int = COUNT, words: int = WORDS, with_text: bool = False) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like the
    document's is to that and to the next document's; with_text adds the
    edited text."""
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _ranged(docs).repartition(parts, "range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "h", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] + ["edited_text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.fingerprints import Family, edited, likeness

        family = Family(count, words)
        last, place = None, None  # the row that waits for its next one: id, text, fingerprint
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            due: list[tuple] = []  # row, its edited text, the next one's fingerprint
            for at, copy, key, text, own in zip(*(b.column(c).to_pylist() for c in ("range", "copy", "doc_id")), texts, family.prints(texts), strict=True):
                if copy and last is None:
                    continue
                if last is not None:
                    if place != at:
                        raise RuntimeError("a range has no copy of the next one's head")
                    due.append((last, edited(last[1], text), own))
                last, place = (None, None) if copy else ((key, text, own), at)
            out: list[tuple] = []
            for (row, e, following), g in zip(due, family.prints([e for _, e, _ in due]), strict=True):
                k, t, f = row
                out.append((k, len(t), hashlib.sha256(e.encode("utf-8", "replace")).hexdigest(), f.tobytes().hex(), g.tobytes().hex(), likeness(f, g), likeness(f, following)) + ((e,) if with_text else ()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in zip(range(len(names)), kinds)], names=names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + (", edited_text string" if with_text else ""))


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: classes of documents whose
    shingle sets are alike, by bands of the fingerprint and verified Jaccard."""
    return near_classes(docs, words, percent, signer=lambda: Family(COUNT, words), lower=False)
