"""Words of whole Arrow columns at once, and what workers keep between tasks.

Texts are split and numbered in C++ (Arrow's split and dictionary encoding), so
that Python only sees the distinct words of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Held(dict):
    """Results by key that a worker process keeps between tasks: at most `most`
    bytes (an estimate: lengths and OVERHEAD an entry), and for one operator at
    a time. What it holds only saves time and never changes a result."""

    OVERHEAD = 160
    _owner: Held | None = None

    def __init__(self, most: int = 24 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def claim(self) -> None:
        """Empty what another operator left in this process."""
        if Held._owner is not self:
            if Held._owner is not None:
                Held._owner.forget()
            Held._owner = self

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def keep(self, key, value) -> None:
        """Add an entry; everything held before goes where room runs out."""
        size = len(key) + (len(value) if type(value) is bytes else 8) + self.OVERHEAD
        if self.held + size > self.most:
            self.forget()
        self[key] = value
        self.held += size


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    column = column.cast(pa.binary()).fill_null(b"") if column.null_count else column.cast(pa.binary())
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices that hold about `most` bytes of a text column each
    (a longer text alone), so that what is made of a slice stays small. Spark
    bounds the batches themselves in bytes. At the end the process gives back
    what it no longer uses, as it may wait long for its next task."""
    try:
        for b in batches:
            _, offsets = raw(b.column(column))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
                yield b.slice(at, to - at)
                at = to
            if not b.num_rows:
                yield b
    finally:
        give_back()


def give_back() -> None:
    """Return free memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of these bytes, which are not checked to be UTF-8."""
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(items: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """(number of each item, the distinct items by number)."""
    found = items.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary.view(pa.binary()).to_pylist()


def split(column: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(numbers, offsets, words) of the runs of bytes other than ASCII white
    space (0x20, 0x09-0x0D) in each text: text t holds the distinct words
    numbered numbers[offsets[t]:offsets[t + 1]]. A table maps bytes first."""
    data, offsets = raw(column)
    data = data if table is None else table[data]
    lists = pc.ascii_split_whitespace(strings(data, offsets))
    ends, items = lists.offsets.to_numpy().astype(np.int64), lists.values
    full = pc.binary_length(items).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        items = items.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    numbers, words = numbered(items)
    return numbers, ends, words
