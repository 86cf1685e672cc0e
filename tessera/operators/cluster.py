"""k-means as Lloyd iterations over array rows, and a cluster classifier.

Starts from the first k rows by id. Centres (k x dimensions) are small and go
out with each iteration; the rows stay where they are, and each task returns
weighted sums of its rows by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.evaluate import accuracy_purity, confusion
from tessera.session import ship

STOP = 0.001


def unit(x: Column) -> Column:
    """A vector of length one; zeros stay."""
    n = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when((n > 0) & ~F.isnan(n), v / n).otherwise(v))


def scaled(x: Column, size: int, both_sides: bool) -> Column:
    """Unit rows; of two-sided rows each half is a unit, over sqrt 2."""
    if not both_sides:
        return unit(x)
    half = size // 2
    whole = F.concat(unit(F.slice(x, 1, half)), unit(F.slice(x, half + 1, half)))
    return F.transform(whole, lambda v: v / F.lit(2.0) ** 0.5)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (lowest of equals) and squared distance of each row."""
    best, low = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for k, c in enumerate(centres):
        d = ((x - c) ** 2).sum(1)
        closer = d < low
        best[closer], low[closer] = k, d[closer]
    return best, low


@dataclass
class KMeans:
    """Fitted centres with the options that made them."""

    centres: np.ndarray
    both_sides: bool = False
    scale_data: bool = False
    updates: int = 0

    def _prepared(self, rows: DataFrame) -> DataFrame:
        x = F.col("x").cast("array<double>")
        return rows.withColumn("x", scaled(x, self.centres.shape[1], self.both_sides) if self.scale_data else x)

    def assign(self, rows: DataFrame) -> DataFrame:
        """rows(id, x) with cluster and d2, the squared distance to its centre."""
        return assign(self._prepared(rows), self.centres)


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    ship(rows.sparkSession)
    at = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.operators.cluster import _nearest

        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            k, d = _nearest(x, centres)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k, pa.int32()), pa.array(d)], names=[*b.schema.names, "cluster", "d2"])

    from pyspark.sql import types as S

    out = S.StructType([*rows.schema.fields, S.StructField("cluster", S.IntegerType()), S.StructField("d2", S.DoubleType())])
    return rows.mapInArrow(run, out)


def centre_sums(rows: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums and weights of rows(x, w) by nearest centre."""
    ship(rows.sparkSession)
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tessera.operators.cluster import _nearest

        sums, weights = np.zeros((k, dims)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                x, w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column(1).to_numpy(zero_copy_only=False)
                at, _ = _nearest(x, centres)
                np.add.at(sums, at, x * w[:, None])
                weights += np.bincount(at, w, k)
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used]), pa.array(list(sums[used]), pa.list_(pa.float64()))], names=["cluster", "w", "x"])

    parts = rows.select("x", F.col("w").cast("double").alias("w")).mapInArrow(run, "cluster long, w double, x array<double>")
    got = parts.groupBy("cluster").agg(F.sum("w").alias("w"), *[F.sum(F.col("x")[d]).alias(f"x{d}") for d in range(dims)]).collect()
    sums, weights = np.zeros((k, dims)), np.zeros(k)
    for r in got:
        weights[r["cluster"]] = r["w"]
        sums[r["cluster"]] = [r[f"x{d}"] for d in range(dims)]
    return sums, weights


def fit(rows: DataFrame, k: int, both_sides: bool = False, scale_data: bool = False, scale_centre: bool = False, most: int = 10) -> KMeans:
    """k-means of rows(id, x[, w]): starts at the k rows of smallest id; at most
    `most` - 1 updates, or until the centres move by under a thousandth of
    their squares; a cluster without rows goes to zero."""
    if "w" not in rows.columns:
        rows = rows.withColumn("w", F.lit(1.0))
    dims = len(rows.select("x").first()[0])
    x = F.col("x").cast("array<double>")
    ready = rows.select("id", (scaled(x, dims, both_sides) if scale_data else x).alias("x"), "w").persist()
    try:
        centres = np.array([r["x"] for r in ready.orderBy("id").limit(k).collect()], float)
        updates = 0
        for _ in range(most - 1):
            sums, weights = centre_sums(ready, centres)
            new = np.where(weights[:, None] > 0, sums / np.where(weights > 0, weights, 1)[:, None], 0.0)
            if scale_centre:
                parts = np.split(new, 2, axis=1) if both_sides else [new]
                parts = [p / np.where((n := np.sqrt((p**2).sum(1, keepdims=True))) > 0, n, 1) for p in parts]
                new = np.concatenate(parts, axis=1)
            moved = ((new - centres) ** 2).sum() / max((centres**2).sum(), 1e-300)
            centres, updates = new, updates + 1
            if moved <= STOP:
                break
    finally:
        ready.unpersist()
    return KMeans(centres, both_sides, scale_data, updates)


def cluster_members(assigned: DataFrame, shown: int = 15) -> DataFrame:
    """(cluster, n, members): the first members of each cluster and its size.
    Only the members shown travel."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("cluster").orderBy("id"))
    first = assigned.withColumn("place", place).where(F.col("place") <= shown).groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("members"))
    return assigned.groupBy("cluster").agg(F.count("*").alias("n")).join(first, "cluster")


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """(cluster, n, rms, furthest): root mean squared (weighted) and largest
    distance to the centre."""
    w = F.col("w") if "w" in assigned.columns else F.lit(1.0)
    return assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.sqrt(F.sum(w * F.col("d2")) / F.sum(w)).alias("rms"), F.sqrt(F.max("d2")).alias("furthest"))


def within_variance(assigned: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the weighted mean squared distance."""
    w = F.col("w") if "w" in assigned.columns else F.lit(1.0)
    return assigned.groupBy("cluster").agg((F.sum(w * F.col("d2")) / F.sum(w)).alias("v")).agg(F.avg("v").alias("variance"))


def overall_summary(assigned: DataFrame, dims: int) -> DataFrame:
    """One row: mean distance to the grand mean and to the own centre, plain and
    weighted, and the largest."""
    w = F.col("w") if "w" in assigned.columns else F.lit(1.0)
    grand = assigned.agg(F.array(*[F.avg(F.col("x")[d]) for d in range(dims)]).alias("_g"))
    to = F.sqrt(F.aggregate(F.zip_with("x", "_g", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    d = F.sqrt("d2")
    return assigned.crossJoin(F.broadcast(grand)).agg(F.avg(to).alias("to_mean"), F.avg(d).alias("to_centre"), (F.sum(w * d) / F.sum(w)).alias("weighted"), F.max(d).alias("furthest"))


def sums_of_squares(assigned: DataFrame, dims: int) -> DataFrame:
    """One row: squares about the grand mean (totss), about the own cluster's
    mean (withinss) and the rest (betweenss) of rows (x, cluster)."""
    long = assigned.select("cluster", F.posexplode("x").alias("d", "v")).where(F.col("d") < dims)
    sums = long.groupBy("cluster", "d").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    by = sums.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"))
    out = by.agg(F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("totss"), F.sum("within").alias("withinss"))
    return out.withColumn("betweenss", F.col("totss") - F.col("withinss"))


def rare_cases(assigned: DataFrame) -> DataFrame:
    """(cluster, w, n): rows of weight 1 and 2, most first."""
    return assigned.where(F.col("w").isin(1, 2)).groupBy("cluster", "w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster", "w")


def cluster_labels(assigned: DataFrame) -> DataFrame:
    """(cluster, pos): each cluster's commonest label, one vote a row; of equals
    the smallest."""
    n = assigned.groupBy("cluster", "pos").agg(F.count("*").alias("n"))
    best = n.groupBy("cluster").agg(F.max("n").alias("n"))
    return n.join(best, ["cluster", "n"]).groupBy("cluster").agg(F.min("pos").alias("pos"))


@dataclass
class ClusterClassifier:
    """Types to labels by way of their cluster; unknown types are OTH."""

    types: DataFrame  # (type, cluster)
    labels: DataFrame  # (cluster, pos)

    @classmethod
    def of(cls, assigned: DataFrame) -> ClusterClassifier:
        """From rows (type, cluster, pos) with the types' majority tags."""
        return cls(assigned.select("type", "cluster"), cluster_labels(assigned))

    def transform(self, rows: DataFrame, out: str = "est") -> DataFrame:
        known = self.types.join(self.labels, "cluster").select("type", F.col("pos").alias(out))
        return rows.join(known, "type", "left").withColumn(out, F.coalesce(out, F.lit("OTH")))

    def judged(self, tagged: DataFrame) -> DataFrame:
        """(truth, est[, n]) of tokens (type, pos) or of their counts n."""
        return self.transform(tagged).select(F.col("pos").alias("truth"), "est", *[c for c in tagged.columns if c == "n"])

    def confusion(self, tagged: DataFrame) -> DataFrame:
        return confusion(self.judged(tagged))

    def score(self, tagged: DataFrame) -> DataFrame:
        return accuracy_purity(self.judged(tagged))
