"""Simulated corpora: topic models as distributed sources.

Every document is a function of (seed, document number), so that partitions
may be recomputed anywhere. Topics are k x types: small, made on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship


def dirichlet(rng: np.random.Generator, alpha: np.ndarray, n: int) -> np.ndarray:
    """n draws by normalised gammas."""
    g = rng.gamma(alpha, size=(n, len(alpha))) + 1e-300
    return g / g.sum(1, keepdims=True)


def zipf_weights(n: int, slope: float = 1.0) -> np.ndarray:
    w = 1 / np.arange(1, n + 1) ** slope
    return w / w.sum()


def topics(k: int, types: int, alpha: float, seed: int, common: int = 0) -> np.ndarray:
    """k distributions over types; the first `common` types are shared by all
    with Zipf weights and half the mass."""
    rng = np.random.default_rng(seed)
    out = dirichlet(rng, np.full(types, alpha), k)
    if common:
        out[:, :common] = zipf_weights(common)
        out[:, common:] *= 0.5 / np.maximum(out[:, common:].sum(1, keepdims=True), 1e-300)
        out[:, :common] *= 0.5
    return out


def disjoint_topics(k: int, types: int, seed: int, common: int = 0) -> np.ndarray:
    """Topics on separate sets of types, drawn without replacement."""
    rng = np.random.default_rng(seed)
    out = np.zeros((k, types))
    for t, own in enumerate(np.array_split(rng.permutation(np.arange(common, types)), k)):
        out[t, own] = dirichlet(rng, np.ones(len(own)), 1)[0]
    if common:
        out[:, :common] = zipf_weights(common)
        out /= out.sum(1, keepdims=True)
    return out


def corpus(spark: SparkSession, n_docs: int, theta_alpha: np.ndarray, words: np.ndarray, effects: np.ndarray, mean_length: float = 100, noise: float = 1.0, seed: int = 1, spread: str = "poisson") -> DataFrame:
    """(doc_id, y, m, z, text) of supervised topic documents: topic shares from
    a Dirichlet, a topic for each word, a word from the topic, and a response
    from the mean effect of the words' topics plus noise. Words are w<number>."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, ms, zs, texts = [], [], [], []
            for d in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, d])
                m = max(1, int(rng.poisson(mean_length))) if spread == "poisson" else int(mean_length)
                z = rng.multinomial(m, dirichlet(rng, theta_alpha, 1)[0])
                drawn = np.concatenate([rng.choice(words.shape[1], n, p=words[t]) for t, n in enumerate(z)])
                rng.shuffle(drawn)
                ys.append(float(z @ effects / m + noise * rng.standard_normal()))
                ms.append(m), zs.append(z.tolist()), texts.append(" ".join(f"w{w}" for w in drawn))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ys, pa.float64()), pa.array(ms, pa.int64()), pa.array(zs, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "y", "m", "z", "text"])

    return spark.range(n_docs).mapInArrow(run, "doc_id long, y double, m long, z array<long>, text string")


def priced_listings(spark: SparkSession, n_docs: int, attributes: np.ndarray, words: np.ndarray, target: float = 10.0, rate: float = 8.0, seed: int = 1) -> DataFrame:
    """(doc_id, y, attributes, text): attribute values are drawn until their
    running total reaches a target; each adds a Poisson number of its words;
    y is the log of the total."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, picks, texts = [], [], []
            for d in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, d])
                order = rng.permutation(len(attributes))
                upto = np.cumsum(attributes[order])
                n = min(int(np.searchsorted(upto, target * rng.uniform(0.5, 1.5))) + 1, len(order))
                mine = order[:n]
                drawn = [w for a in mine for w in rng.choice(words.shape[1], rng.poisson(rate), p=words[a])]
                ys.append(float(np.log(upto[n - 1]))), picks.append(mine.tolist()), texts.append(" ".join(f"w{w}" for w in drawn))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ys, pa.float64()), pa.array(picks, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["doc_id", "y", "attributes", "text"])

    return spark.range(n_docs).mapInArrow(run, "doc_id long, y double, attributes array<long>, text string")


def zipf_documents(spark: SparkSession, n_docs: int, length: int, types: int, slope: float = 1.0, seed: int = 1) -> DataFrame:
    """(doc_id, text): words drawn from Zipf weights, no topics."""
    return corpus(spark, n_docs, np.ones(1), zipf_weights(types, slope)[None, :], np.zeros(1), length, 1.0, seed, "fixed").select("doc_id", "text")


def with_outlier(docs: DataFrame, word: str, times: int, doc_id: int = -1) -> DataFrame:
    """docs(doc_id, text) and one document that repeats a word."""
    return docs.unionByName(docs.sparkSession.createDataFrame([(doc_id, " ".join([word] * times))], "doc_id long, text string"))


def dither(rows: DataFrame, column: str, sd: float, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """rows with normal noise on a column: a function of key and seed alone."""
    unit = lambda k: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.withColumn(column, F.col(column) + F.lit(sd) * F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * 3.141592653589793 * unit(1)))


def topics_used(docs: DataFrame) -> DataFrame:
    """docs(z) with n_topics, the topics that have words in a document."""
    return docs.withColumn("n_topics", F.size(F.filter("z", lambda n: n > 0)))


def toy_pairs(spark: SparkSession, n: int, types: int, seed: int = 1) -> DataFrame:
    """(doc_id, a, b): one-hot arrays of neighbouring tokens of a uniform
    corpus, on which canonical correlations and the scaled bigram SVD agree."""
    draw = lambda k: F.pmod(F.xxhash64(F.col("id") + k, F.lit(seed)), F.lit(types))
    hot = lambda t: F.transform(F.sequence(F.lit(0), F.lit(types - 1)), lambda j: F.when(j == t, 1.0).otherwise(0.0))
    return spark.range(n).select(F.col("id").alias("doc_id"), hot(draw(0)).alias("a"), hot(draw(1)).alias("b"))


def lines(docs: DataFrame) -> DataFrame:
    """(value): documents as lines, response first."""
    return docs.select(F.concat_ws(" ", F.round("y", 3).cast("string"), "text").alias("value"))


def experiment(spark: SparkSession, reps: int, one, columns: str) -> DataFrame:
    """Runs one(rep) -> dict of numbers for each repetition, as tasks."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame([{"rep": int(r), **one(int(r))} for r in pdf["id"]])

    return spark.range(reps).repartition(min(reps, 64), "id").groupBy("id").applyInPandas(run, f"rep long, {columns}")
