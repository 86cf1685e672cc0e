"""Whole-text encoding with a public word-level BPE file, a batch at a time.

The tokenizer drops white space and splits what is left into pre-tokens, whose
ids don't depend on their neighbours. Over the bytes of a whole batch numpy
finds the pre-tokens of plain chunks (printable ASCII and Latin-1 letters);
chunks with anything else, or that could hold a special token, stay whole.
Arrow numbers the distinct ones, the library encodes each once (a bounded
memory keeps ids between batches), and ids are gathered by number.

The plain path knows the split pattern and normalisation of one kind of file:
each file is compared with the library on a probe text when it is loaded, and
where they differ every text goes to the library whole.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa

from tessera.llm.words import Held, numbered, raw, strings

DEFAULT_FILE = "word_bpe_49k.json"
#: Pre-tokens whose normalisation is plain lower-casing.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_INSTANCES: dict[str, WordBpe] = {}
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_PROBE = "It's  Él's 'software' we'll, they'RE ÀÖØÞß÷ x2 1999 'd'm 've''s a'b-c_d\tÿes!?\n<|end|> 日本 ｆｕｌｌ naïvé ​."


def _classes() -> np.ndarray:
    kind = np.full(256, _ODD, np.uint8)
    kind[33:127] = _OTHER
    for lo, hi in ((65, 91), (97, 123)):
        kind[lo:hi] = _LETTER
    kind[48:58] = _DIGIT
    kind[[32, 9, 10, 11, 12, 13]] = _SPACE
    return kind


_KIND = _classes()


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """Byte-level BPE's printable name for each byte value."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens and odd chunks of all texts, offsets of texts among them)."""
    n = len(data)
    kind = _KIND[data]
    first = np.zeros(n + 1, bool)  # a text's first byte begins anew
    first[offsets] = True
    first = first[:n]
    after = np.zeros(n, np.uint8)
    after[:-1] = data[1:]
    after[np.flatnonzero(first[1:])] = 0  # what follows belongs to another text
    two = (data == 0xC3) & (after >= 0x80) & (after < 0xC0) & (after != 0x97) & (after != 0xB7)
    at = np.flatnonzero(two)  # U+00C0 to U+00FF, all letters but the signs of multiplication and division
    kind[at] = kind[at + 1] = _LETTER
    before = np.full(n, _SPACE, np.uint8)
    before[1:] = kind[:-1]
    before[first] = _SPACE
    inside = kind != _SPACE
    chunk = inside & (before == _SPACE)
    odd = (kind == _ODD) | ((data == 60) & (after == 124))  # "<|" may begin a special token
    bad = np.zeros(n, bool)
    at_odd = np.flatnonzero(odd)
    if len(at_odd):
        begins = np.flatnonzero(chunk)
        ends = np.append(begins[1:], n)
        hit = np.unique(np.searchsorted(begins, at_odd, side="right") - 1)
        size = ends[hit] - begins[hit]
        bad[np.repeat(begins[hit] - np.cumsum(size) + size, size) + np.arange(size.sum())] = True
        bad &= inside
    begin = chunk | (inside & ~bad & ((kind != before) | (kind == _DIGIT)))
    quote = np.flatnonzero((data == 39) & begin & ~bad)
    if len(quote):
        low = data | 32  # letters alone matter here
        here = lambda p, k: np.where(p + k < n, low[np.minimum(p + k, n - 1)], 0) * (np.where(p + k < n, kind[np.minimum(p + k, n - 1)], 0) == _LETTER) * ~_crossed(first, p, k, n)
        a, b = here(quote, 1), here(quote, 2)
        one = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, k in ((quote[one], 2), (quote[pair & ~one], 3)):
            begin[hit + 1] = False
            end = hit[hit + k < n] + k
            begin[end] |= inside[end]
    lower = data.copy()
    plain = ~bad
    lower[plain & (data >= 65) & (data <= 90)] += 32
    second = at + 1
    up = second[(data[second] <= 0x9E) & plain[second]]
    lower[up] += 32
    starts = np.flatnonzero(begin)
    sizes = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return strings(lower[inside], np.concatenate([[0], np.cumsum(sizes)])), np.searchsorted(starts, offsets)


def _crossed(first: np.ndarray, p: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether another text begins between p and p + k."""
    out = np.zeros(len(p), bool)
    for j in range(1, k + 1):
        out |= first[np.minimum(p + j, n - 1)]
    return out


class WordBpe:
    """Encoder of one tokenizer file; ids come as little-endian uint16."""

    def __init__(self, path: str, most: int = 64 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept as uint16; this vocabulary is larger")
        self.model, self.names, self.ids = self.library.model, _byte_names(), Held(most)
        self.plain = sys.byteorder == "little"
        probe = [_PROBE, _PROBE.upper(), "'s"]
        own = self._batch(pa.array(probe))
        want = [e.ids for e in self.library.encode_batch(probe, add_special_tokens=False)]
        self.plain = [own[0][own[1][k] : own[1][k + 1]].tolist() for k in range(len(probe))] == want

    @classmethod
    def of(cls, path: str) -> WordBpe:
        """The process's instance for a file."""
        if path not in _INSTANCES:
            _INSTANCES[path] = cls(path)
        _INSTANCES[path].ids.claim()
        return _INSTANCES[path]

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of each pre-token or odd chunk."""
        out, tokenize, whole = list(map(self.ids.get, units)), self.model.tokenize, []
        for k in [k for k, found in enumerate(out) if found is None]:
            unit = units[k]
            if unit.isalpha() or unit.isdigit():  # of bytes: ASCII alone
                out[k] = array("H", [t.id for t in tokenize(unit.decode())]).tobytes()
            else:
                s = unit.decode("utf-8", "replace")
                if not _PLAIN.fullmatch(s) or "<|" in s:
                    whole.append((k, s))
                    continue
                out[k] = array("H", [t.id for t in tokenize(s if s.isascii() else unit.decode("latin-1").translate(self.names))]).tobytes()
            self.ids.keep(unit, out[k])
        if whole:
            for (k, _), e in zip(whole, self.library.encode_batch([s for _, s in whole], add_special_tokens=False), strict=True):
                out[k] = array("H", e.ids).tobytes()
                self.ids.keep(units[k], out[k])
        return out

    def _batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = raw(column)
        items, at = _units(data, offsets)
        numbers, units = numbered(items)
        known = self._known(units)
        flat = np.frombuffer(b"".join(known), "<u2")
        size = np.fromiter(map(len, known), np.int64, len(known)) >> 1
        start = np.cumsum(size) - size
        each = size[numbers]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.repeat(start[numbers] - ends[:-1], each) + np.arange(ends[-1])] if len(numbers) else np.zeros(0, "<u2")
        return ids, ends[at]

    def encode(self, column: pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """The ids of each text of a column (null: none), the end id last."""
        if self.plain:
            ids, at = self._batch(column)
            parts = [ids[at[k] : at[k + 1]] for k in range(len(column))]
        else:
            texts = [(t or b"").decode("utf-8", "replace") for t in column.cast(pa.binary()).to_pylist()]
            parts = [np.array(e.ids, "<u2") for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return parts if end_id is None else [np.append(p, np.array([end_id], "<u2")) for p in parts]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
