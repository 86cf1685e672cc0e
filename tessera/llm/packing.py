"""Hierarchical multi-length packing (op4).

Documents become ids with an end id. Whole windows are cut from documents
longer than the longest window; each remaining piece is routed to the tier of
the smallest window that holds it. Tiers are packed from the longest down: a
piece opens a window, and its gap is filled from shorter tiers, by the longest
piece that fits and at last by the head of one that does not. What is left at
the end of a partition goes into windows of falling powers of two. Windows
are then dealt to step groups, longest first, each to the lightest group.

Packing runs over units of a bounded number of tokens inside each partition,
without a shuffle; a unit hands what it can't place to the next one, and step
groups are balanced inside a unit. So sequences follow from how the input is
split: other splits give other, equally full sequences.

Defined results: null and empty texts are the end id alone; a repeated row is
packed again; doc_id may be null; other columns are ignored; an empty table
gives no rows. Each id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.wordbpe import WordBpe, tokenizer_path
from tessera.llm.words import slices
from tessera.session import ship

WINDOWS = (4096, 2048, 1024, 512, 256)
END_ID = 2
UNIT_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
LEAST = 1


class Packer:
    """Packs (document number, start, length) pieces into windows."""

    def __init__(self, windows: tuple[int, ...] = WINDOWS):
        self.windows = tuple(sorted(windows, reverse=True))
        if any(w & (w - 1) for w in self.windows):
            raise ValueError("windows must be powers of two")
        self.done: list[list[tuple[int, int, int]]] = []
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, document: int, length: int) -> None:
        top, start = self.windows[0], 0
        while length - start >= top:
            self.done.append([(document, start, top)])
            start += top
        if length > start:
            self.pool.append((length - start, document, start))

    def tier(self, length: int) -> int:
        return next(w for w in reversed(self.windows) if w >= length)

    def close(self, last: bool) -> None:
        """Pack the pool; but for the last call, an unfilled window stays in it."""
        pool = sorted(self.pool)
        while pool:
            length, document, start = pool.pop()
            window = self.tier(length)
            placed, gap = [(document, start, length)], window - length
            while gap and pool:
                k = bisect_right(pool, (gap, float("inf"), 0))
                if k:
                    n, d, s = pool.pop(k - 1)
                    placed.append((d, s, n))
                    gap -= n
                    continue
                n, d, s = pool.pop(bisect_left(pool, (gap,)))  # the shortest that doesn't fit
                placed.append((d, s, gap))
                insort(pool, (n - gap, d, s + gap))
                gap = 0
            if not gap:
                self.done.append(placed)
            elif not last:
                pool = [(n, d, s) for d, s, n in placed]
                break
            else:
                self._halve(placed)
        self.pool = pool

    def _halve(self, placed: list[tuple[int, int, int]]) -> None:
        """Windows of falling powers of two; what is under LEAST ids ends short."""
        left = sum(n for *_, n in placed)
        queue = placed[::-1]
        while queue:
            size = 1 << (left.bit_length() - 1)
            size, now = (size if size >= LEAST else left), []
            left -= size
            while size:
                d, s, n = queue.pop()
                now.append((d, s, min(n, size)))
                if n > size:
                    queue.append((d, s + size, n - size))
                size -= min(n, size)
            self.done.append(now)


def step_groups(sizes: list[int], tokens: int) -> list[int]:
    """A group for each window, so that groups carry about as many tokens."""
    groups = max(1, round(sum(sizes) / tokens))
    loads, out = [(0, g) for g in range(groups)], [0] * len(sizes)
    import heapq

    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, g = heapq.heappop(loads)
        out[k] = g
        heapq.heappush(loads, (load + sizes[k], g))
    return out


_SCHEMA = "doc_id {0}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, windows: tuple[int, ...] = WINDOWS, unit_tokens: int = UNIT_TOKENS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text): where it lies in its document
    and in its sequence, the sequence's window and step group; with_ids adds
    the piece's ids (little-endian uint16)."""
    path = path or tokenizer_path()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessera.llm.packing import Packer, step_groups

        bpe, packer = WordBpe.of(path), Packer(windows)
        base = TaskContext.get().partitionId() << 36
        sequences = groups = number = held = 0
        ids: dict[int, np.ndarray] = {}
        keys: dict[int, object] = {}
        kind = [pa.int64()]

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal sequences, groups
            done, packer.done = packer.done, []
            sizes = [sum(n for *_, n in w) for w in done]
            group = step_groups(sizes, step_tokens)
            rows: list[list] = [[] for _ in range(9 + with_ids)]
            for at, (w, size, g) in enumerate(zip(done, sizes, group, strict=True)):
                offset, window = 0, size if size & (size - 1) == 0 else packer.tier(size)
                for d, s, n in w:
                    part = ids[d][s : s + n]
                    row = (keys[d], s, n, zlib.crc32(part.astype("<u4").tobytes()), len(ids[d]), base + sequences + at, offset, window, base + groups + g) + ((part.tobytes(),) if with_ids else ())
                    for column, v in zip(rows, row, strict=True):
                        column.append(v)
                    offset += n
            sequences += len(done)
            groups += max(group, default=-1) + 1
            types = [kind[0], *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in _SCHEMA.split(", ")] + ["ids"] * with_ids
            for k in range(0, len(rows[0]), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 8192], t) for c, t in zip(rows, types)], names=names)
            kept = {d for _, d, _ in packer.pool}
            for d in [d for d in ids if d not in kept]:
                del ids[d], keys[d]

        for b in slices(batches):
            kind[0] = b.column("doc_id").type
            for key, one in zip(b.column("doc_id").to_pylist(), bpe.encode(b.column("text"), end_id), strict=True):
                ids[number], keys[number] = one, key
                packer.add(number, len(one))
                number, held = number + 1, held + len(one)
                if held >= unit_tokens:
                    packer.close(last=False)
                    held = 0
                    yield from emit()
        packer.close(last=True)
        yield from emit()

    schema = _SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()) + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
