"""Toxicity by a convolutional text classifier (op1).

A word's embedding is the sum of hashed rows: two independent hashes of the
word, so that a collision of one alone stays weak, and one of its first four
letters. Filters of widths 1, 2 and 3 slide over whole texts; each filter's
largest value (max pooling), rectified, goes into a logistic layer. Everything
is trained in numpy on the driver, on a bounded sample of labelled rows
(TOXIC_ROWS + CLEAN_ROWS and, of each label, TRAIN_CHARS characters, whole texts
in order of a hash of doc_id); embeddings start from
the log odds of their bucket. A fifth of the sample is kept from training, and
there the decision threshold is set for each language; the score is the
probability, stretched so that its language's threshold comes to 0.7. The
language is told from the words of the text by a model of the same sample:
no column but the text takes part in a score.

Defined results: null texts count as empty; a text without words scores 0, as
does every text where the sample lacks one of the two labels; repeated labels
of a doc_id: the larger counts; of several texts of a labelled doc_id one
teaches; null labels teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.language_id import fold
from tessera.llm.words import give_back, numbered, slices, split
from tessera.session import cut, discard, ship

TOXIC_ROWS, CLEAN_ROWS, TRAIN_CHARS = 3000, 6000, 1 << 25
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, CUT = 5, 64, 0.05, 0.7
#: ASCII bytes that aren't letters end a word.
_TO_SPACE = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
_SEGMENT = 1 << 16


def words_of(column: pa.Array) -> list[np.ndarray]:
    """For each text of a column, three bucket numbers for each of its words."""
    import xxhash

    texts = pa.array([(t or "").lower().encode("utf-8", "replace") for t in column.to_pylist()], pa.binary())
    numbers, ends, words = split(texts, _TO_SPACE)
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    starts = pc.utf8_slice_codeunits(pa.array(words, pa.binary()).cast(pa.string()), 0, 4)
    at, heads = numbered(starts)
    first = np.fromiter((xxhash.xxh3_64_intdigest(h, 7) % BUCKETS for h in heads), np.int32, len(heads))
    three = np.stack([whole % np.uint64(BUCKETS), (whole >> np.uint64(32)) % np.uint64(BUCKETS), first[at]], 1).astype(np.int32) if words else np.zeros((0, 3), np.int32)
    rows = three[numbers]
    return [rows[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def pack(words: np.ndarray) -> bytes:
    """Bucket numbers of one text, compressed."""
    return pa.compress(words.tobytes(), "zstd", asbytes=True)


class Packed(Sequence):
    """Texts' bucket numbers as words_of() gives them. They come to the driver
    and stay there as pack() made them; one text at a time is unpacked."""

    def __init__(self, texts: list[tuple[int, bytes]]):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, k):
        if isinstance(k, slice):
            return Packed(self.texts[k])
        n, data = self.texts[k]
        return np.frombuffer(pa.decompress(data, 12 * n, "zstd"), np.int32).reshape(-1, 3) if n else np.zeros((0, 3), np.int32)


class Net:
    """The classifier: parameters, pooled features, training and scores."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = np.concatenate([rng.normal(0, 0.05, (BUCKETS // 64, DIM)).astype(np.float32) for _ in range(64)])
        self.conv = [rng.normal(0, 0.15, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for c in self.conv:
            c[:, 0, :] = np.abs(c[:, 0, :])
            c[0, 0, : FILTERS // 2] = 1
        self.bias = np.full(len(WIDTHS) * FILTERS, -0.5, np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.3, np.float32)
        self.last = np.float32(-2.0)
        self.languages: list[str] = []
        self.words_by_language = np.zeros((BUCKETS, 0), np.float32)
        self.cuts = np.zeros(1)

    def _responses(self, x: np.ndarray) -> np.ndarray:
        """Filter values at every position of x, which ends in padding."""
        n = len(x) - max(WIDTHS) + 1
        z = np.empty((n, len(self.bias)), np.float32)
        for k, c in enumerate(self.conv):
            part = z[:, k * FILTERS : (k + 1) * FILTERS]
            np.matmul(x[:n], c[0], out=part)
            for j in range(1, len(c)):
                part += x[j : n + j] @ c[j]
        return z

    def features(self, word: np.ndarray) -> np.ndarray:
        """Max-pooled filter values of one whole text, in segments."""
        best = np.full(len(self.bias), -np.inf, np.float32)
        pad = max(WIDTHS) - 1
        for at in range(0, len(word), _SEGMENT):
            part = word[at : at + _SEGMENT + pad]
            x = self.embed[part].sum(1)
            x = np.concatenate([x, np.zeros((pad - max(0, len(part) - _SEGMENT), DIM), np.float32)]) if len(part) < _SEGMENT + pad else x
            best = np.maximum(best, self._responses(x).max(0))
        return best

    def probability(self, word: np.ndarray) -> float:
        if not len(word):
            return 0.0
        z = np.maximum(self.features(word) + self.bias, 0)
        return float(1 / (1 + np.exp(-np.clip(z @ self.out + self.last, -30, 30))))

    def language(self, word: np.ndarray) -> int:
        """Number of the language whose words fit best; 0 if none is known."""
        if len(self.languages) < 2 or not len(word):
            return 0
        return int(self.words_by_language[word[:, 0]].sum(0).argmax())

    def score(self, word: np.ndarray) -> float:
        p, cut = self.probability(word), self.cuts[self.language(word)]
        return min(1.0, CUT * p / cut if p < cut else CUT + (1 - CUT) * (p - cut) / max(1 - cut, 1e-9))

    def train(self, words: Sequence[np.ndarray], toxic: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        n1, n0 = toxic.sum(), (1 - toxic).sum()
        seen = np.zeros((2, BUCKETS), np.float32)
        for w, y in zip(words, toxic, strict=True):
            seen[y][np.unique(w)] += 1
        odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
        self.embed[:, 0] = np.where(seen[1] >= min(3, n1), np.clip(odds, -3, 3) / 3, np.minimum(0, np.clip(odds, -3, 3) / 3))
        weight = np.where(toxic == 1, 0.5 * len(toxic) / n1, 0.5 * len(toxic) / n0).astype(np.float32)
        grown = [np.full_like(p, 0.1) for p in (self.embed, *self.conv, self.bias, self.out)]
        last_grown, pad = 0.1, max(WIDTHS) - 1

        def step(p: np.ndarray, g: np.ndarray, s: np.ndarray) -> None:
            s += g * g
            p -= RATE * g / np.sqrt(s)

        for _ in range(EPOCHS):
            order = rng.permutation(len(words))
            for at in range(0, len(order), BATCH):
                rows = [r for r in order[at : at + BATCH] if len(words[r])]
                if not rows:
                    continue
                g_conv, g_bias, g_out, g_last = [np.zeros_like(c) for c in self.conv], np.zeros_like(self.bias), np.zeros_like(self.out), 0.0
                touched, g_touched = [], []
                for r in rows:
                    w = words[r]
                    x = np.concatenate([self.embed[w].sum(1), np.zeros((pad, DIM), np.float32)])
                    z = self._responses(x)
                    top = z.argmax(0)
                    pooled = z[top, np.arange(len(top))] + self.bias
                    a = np.maximum(pooled, 0)
                    p = 1 / (1 + np.exp(-np.clip(a @ self.out + self.last, -30, 30)))
                    d = np.float32((p - toxic[r]) * weight[r] / len(rows))
                    g_out += d * a
                    g_last += d
                    dz = d * self.out * (pooled > 0)
                    g_bias += dz
                    for k, c in enumerate(self.conv):
                        mine = slice(k * FILTERS, (k + 1) * FILTERS)
                        for j in range(len(c)):
                            i = top[mine] + j
                            g_conv[k][j] += (x[i] * dz[mine, None]).T
                            inside = (i < len(w)) & (dz[mine] != 0)
                            if inside.any():
                                touched.append(w[i[inside]])
                                g_touched.append((c[j].T * dz[mine, None])[inside])
                for p_, g, s in zip((*self.conv, self.bias, self.out), (*g_conv, g_bias, g_out), grown[1:], strict=True):
                    step(p_, g, s)
                last_grown += g_last**2
                self.last -= np.float32(RATE * g_last / np.sqrt(last_grown))
                if touched:
                    t, g = np.concatenate(touched), np.concatenate(g_touched)
                    u, back = np.unique(t, return_inverse=True)
                    total = np.zeros((len(u), DIM), np.float32)
                    np.add.at(total, back.reshape(t.shape), g[:, None, :].repeat(3, 1))
                    s = grown[0][u] + total * total
                    grown[0][u] = s
                    self.embed[u] -= RATE * total / np.sqrt(s)

    def learn_languages(self, words: Sequence[np.ndarray], langs: list[str | None]) -> None:
        self.languages = sorted({x for x in langs if x is not None}) or ["all"]
        counts = np.full((BUCKETS, len(self.languages)), 0.1, np.float32)
        for w, lang in zip(words, langs, strict=True):
            if lang is not None:
                np.add.at(counts[:, self.languages.index(lang)], w[:, 0], 1)
        self.words_by_language = np.log(counts / counts.sum(0))

    def calibrate(self, words: Sequence[np.ndarray], toxic: np.ndarray) -> None:
        """A threshold for each language: the one of best F1, in the middle of
        the gap it lies in. Languages with few rows share one over all rows; it
        is 0.5 where those are too few."""
        p = np.array([self.probability(w) for w in words])
        at = np.array([self.language(w) for w in words])
        common = _best_cut(p, toxic)
        self.cuts = np.array([_best_cut(p[at == k], toxic[at == k]) if toxic[at == k].sum() >= 10 and (1 - toxic[at == k]).sum() >= 10 else common for k in range(len(self.languages))])


def _best_cut(p: np.ndarray, y: np.ndarray, least: int = 10) -> float:
    if y.sum() < least or (1 - y).sum() < least:
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(f1.argmax())
    return float(np.clip((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2, 1e-6, 1 - 1e-6))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, chars: int = TRAIN_CHARS) -> Net | None:
    """Train on a bounded sample of labels(doc_id, toxic), joined to
    docs(doc_id, text, lang); None if one of the labels is missing."""
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*key).limit(toxic_rows).unionByName(known.where("toxic = 0").orderBy(*key).limit(clean_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = words_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("lang"), pa.array(map(len, words), pa.int64()), pa.array(map(pack, words), pa.binary())], names=["doc_id", "toxic", "lang", "n", "words"])

    # the sample's bound makes it safe to broadcast
    joined = docs.select("doc_id", "text", "lang").join(F.broadcast(sample.select("doc_id", F.col("toxic").cast("int"))), "doc_id")
    one = joined.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("d"))
    one = cut(one.select("doc_id", "toxic", "d.text", "d.lang"), "training")
    left, chosen = {0: chars, 1: chars}, []
    for r in one.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"), F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).orderBy("h", "doc_id").collect():
        if r["n"] <= left[r["toxic"]]:
            left[r["toxic"]] -= r["n"]
            chosen.append((r["doc_id"],))
    few = docs.sparkSession.createDataFrame(chosen, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    rows = one.join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "lang", "text").mapInArrow(run, "doc_id long, toxic int, lang string, n long, words binary").collect()
    discard(one)
    rows.sort(key=lambda r: r["doc_id"])  # each but once
    rng = np.random.default_rng(3)
    rng.shuffle(rows)
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if not len(toxic) or not toxic.any() or toxic.all():
        return None
    words = Packed([(r["n"], r["words"]) for r in rows])
    net, fifth = Net(), max(1, len(rows) // 5)
    late = range(fifth, len(rows)) if toxic[fifth:].any() and not toxic[fifth:].all() else range(len(rows))
    net.learn_languages(words, [r["lang"] for r in rows])
    net.train(words[late.start :], toxic[late.start :])
    first = words[:fifth] if 10 <= toxic[:fifth].sum() <= fifth - 10 else words  # too few labels: those trained on as well
    net.calibrate(first, toxic[: len(first)])
    del rows, words, first
    give_back()
    return net


def score(docs: DataFrame, net: Net | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """tox_score and tox_pred for every row of docs, beside the kept columns."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = [net.score(w) for w in words_of(b.column("text"))] if net else [0.0] * b.num_rows
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s, pa.float64()), pa.array([int(x >= CUT) for x in s], pa.int32())], names=[*keep, "tox_score", "tox_pred"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{schema}, tox_score double, tox_pred int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of the held-out fold teach
    nothing."""
    net = fit(docs, labels.where(fold("doc_id", 3) != 1))
    return score(docs, net).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_pred").alias("predicted"))
