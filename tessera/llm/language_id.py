"""Language identification by rank-order profiles (op7).

A profile is the list of a language's most frequent letter n-grams (1 to 3,
words bounded by a mark), in order of frequency. A document's own list is
compared to each profile by out-of-place distance: the sum over its n-grams of
how far they stand from their place in the profile, `size` where they are
missing. Counts for profiles cover every training row: tasks add them up and
one shuffle by (lang, n-gram) sums them; profiles are languages x size rows.

Defined results: `und` with score 0 where the text is null or has no letter,
or nothing was learned; ties between languages go to the smaller name, between
n-grams of equal count to the smaller code points; rows with null lang teach
nothing; other columns are ignored. The score is the likeness to the nearest
profile: 1 - distance / largest possible distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.words import slices
from tessera.session import ship

SIZE = 400
UNKNOWN = "und"
_CHUNK = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """n-gram keys, ascending, and their counts in a text. A key holds up to
    three numbers of 21 bits: code point + 1, or 1 for the bound of a word.
    Long texts are counted in pieces, each with the two characters before it,
    so that n-grams are the same wherever a piece ends."""
    text = text.lower()
    if len(text) <= _CHUNK:
        return _count(_bounded(text), 0)
    keys, counts, before = [], [], np.zeros(0, np.int64)
    for at in range(0, len(text), _CHUNK):
        piece = _bounded(text[at : at + _CHUNK], at == 0, at + _CHUNK >= len(text))
        points = np.concatenate([before, piece])
        points = points[_single(points)]
        k, n = _count(points, len(before))
        keys.append(k)
        counts.append(n)
        before = points[-2:]
    return _merge(keys, counts)


def _single(points: np.ndarray) -> np.ndarray:
    """All but repeated bounds."""
    return np.concatenate([[True], (points[1:] != 1) | (points[:-1] != 1)]) if len(points) else np.zeros(0, bool)


def _bounded(text: str, first: bool = True, last: bool = True) -> np.ndarray:
    """Letters' code points + 1 and one bound between words."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    points = np.where(_letters()[points], points + 1, 1)
    points = np.concatenate([[1] * first, points, [1] * last]).astype(np.int64)
    return points[_single(points)]


def _count(points: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams that end after the first `known` points."""
    if not (points != 1).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = points[known:]
    two = (points[:-1] << 21 | points[1:])[max(known - 1, 0) :]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[max(known - 2, 0) :]
    middle = points[1:-1][max(known - 2, 0) :]
    return np.unique(np.concatenate([one[one != 1], two, three[middle != 1]]), return_counts=True)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The `size` most frequent keys, most frequent first."""
    if len(keys) > size:
        least = -np.partition(-counts, size - 1)[size - 1]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


def learn(train: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Profiles by language from every row of train(text, lang)."""
    ship(train.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, n = _merge([p[0] for p in parts], [p[1] for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "n"])

        pending = 0
        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                k, n = ngrams(text)
                parts = held.setdefault(lang, [])
                parts.append((k, n))
                pending += len(k)
                if len(parts) >= 64:
                    held[lang] = [_merge([p[0] for p in parts], [p[1] for p in parts])]
            if pending > 4_000_000:
                yield from flush()
                held, pending = {}, 0
        yield from flush()

    rows = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


class Matcher:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = SIZE):
        self.langs, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([profiles[x] for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        self.place = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for row, lang in zip(self.place, self.langs, strict=True):
            row[np.searchsorted(self.known, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*ngrams(text or ""), self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at = np.where((at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == own), at, len(self.known))
        place = self.place[:, at]
        away = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))))
        total = away.sum(1)
        best = int(total.argmin())
        return self.langs[best], float(1 - total[best] / (self.size * len(own)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """lang_pred and score for every row of docs, beside the kept columns."""
    ship(docs.sparkSession)
    columns = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.llm.language_id import Matcher

        matcher = Matcher(profiles, size)
        for b in slices(batches):
            found = [matcher.predict(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*keep, "lang_pred", "lang_score"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*columns).mapInArrow(run, f"{schema}, lang_pred string, lang_score double")


def fold(c: Column | str, folds: int) -> Column:
    """crc32 of an id as text, modulo folds; null ids are in no fold (-1)."""
    return F.coalesce(F.pmod(F.crc32(F.col(c).cast("string").cast("binary")) if isinstance(c, str) else F.crc32(c.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from rows outside the
    held-out fold."""
    held = fold("doc_id", 4) == 2
    profiles = learn(docs.where(~held))
    return predict(docs, profiles).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
