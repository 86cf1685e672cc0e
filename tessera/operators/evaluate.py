"""Labels against estimates, and other measures of agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut


def _judged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "est").agg((F.sum("n") if "n" in rows.columns else F.count("*")).alias("n"))


def confusion(rows: DataFrame) -> DataFrame:
    """(truth, est, n) over all pairs of the labels of either side, of rows or of
    counts n of rows."""
    n = _judged(rows)
    labels = n.select(F.col("truth").alias("x")).unionByName(n.select(F.col("est").alias("x"))).distinct()
    grid = labels.select(F.col("x").alias("truth")).crossJoin(F.broadcast(labels.select(F.col("x").alias("est"))))  # labels x labels: the matrix itself
    return grid.join(n, ["truth", "est"], "left").select("truth", "est", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(rows: DataFrame) -> DataFrame:
    """The matrix with one column an estimate."""
    return confusion(rows).groupBy("truth").pivot("est").agg(F.sum("n"))


def margins(rows: DataFrame) -> DataFrame:
    """(truth, est, n) with totals: null stands for all labels of a side."""
    return rows.cube("truth", "est").agg(F.count("*").alias("n"))


def accuracy_purity(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy (share on the diagonal) and purity (share in the
    largest truth of each estimate), of rows or of counts n of rows."""
    n = _judged(rows)
    per = n.groupBy("est").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.sum(F.when(F.col("truth").eqNullSafe(F.col("est")), F.col("n")).otherwise(0)).alias("hit"))
    return per.agg(F.sum("n").alias("n"), (F.sum("hit") / F.sum("n")).alias("accuracy"), (F.sum("top") / F.sum("n")).alias("purity"))


def concordant_pairs(pairs: DataFrame) -> DataFrame:
    """One row: pairs and how many of (y1, y2, f1, f2) are ordered alike."""
    return pairs.agg(F.count("*").alias("pairs"), F.count_if(F.signum(F.col("y1") - F.col("y2")) * F.signum(F.col("f1") - F.col("f2")) > 0).alias("concordant"))


def random_pairs(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Pairs (y1, f1, y2, f2) of two seeded samples of rows(y, f), by place."""
    from pyspark.sql import Window

    def one(k: int) -> DataFrame:
        # a hash of the row under the seed orders the sample; its size is bounded by n
        s = rows.select("y", "f", F.xxhash64("y", "f", F.lit(seed), F.lit(k)).alias("h")).orderBy("h").limit(n)
        return s.select(F.row_number().over(Window.orderBy("h", "y", "f")).alias("at"), F.col("y").alias(f"y{k}"), F.col("f").alias(f"f{k}"))

    return one(1).join(one(2), "at").select("y1", "f1", "y2", "f2")


def symmetric_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """One row: KL(p|q), KL(q|p) and their mean over (key, p), on shared keys."""
    both = p.select("key", F.col("p").alias("a")).join(q.select("key", F.col("p").alias("b")), "key").where("a > 0 and b > 0")
    return both.agg(F.sum(F.col("a") * F.log(F.col("a") / F.col("b"))).alias("forward"), F.sum(F.col("b") * F.log(F.col("b") / F.col("a"))).alias("backward")).withColumn("mean", (F.col("forward") + F.col("backward")) / 2)


def mean_imputed(rows: DataFrame, column: str) -> DataFrame:
    """rows with `<column>_seen` (1 where positive) and the column's other
    values replaced by the mean of those."""
    seen = F.col(column) > 0
    mean = rows.agg(F.avg(F.when(seen, F.col(column))).alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn(f"{column}_seen", F.coalesce(seen.cast("int"), F.lit(0))).withColumn(column, F.when(seen, F.col(column)).otherwise(F.col("_mean"))).drop("_mean")


def moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, mean, sd, skewness, kurtosis): kurtosis is 3 for a normal."""
    one = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"), F.skewness(c).alias("skewness"), (F.kurtosis(c) + 3).alias("kurtosis")) for c in columns]
    return rows.agg(F.array(*one).alias("a")).select(F.inline("a"))


def running_totals(rows: DataFrame, key: str, n: str, parts: int = 256) -> DataFrame:
    """rows (one for each key) with `before`, the sum of n over smaller keys, and
    `total`. Keys are cut into about `parts` ranges at approximate quantiles:
    totals of ranges are summed in one small window, keys inside their range."""
    bounds = rows.approxQuantile(key, [k / parts for k in range(1, parts)], 0.5 / parts)
    if len(set(bounds)) < 2:  # no keys, or hardly any
        order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("before", F.sum(n).over(order) - F.col(n)).withColumn("total", F.sum(n).over(Window.partitionBy()))
    at = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(key)))
    placed = cut(rows.withColumn("_r", at), "ranged")
    ranges = placed.groupBy("_r").agg(F.sum(n).alias("_n"))  # at most `parts` rows
    order = Window.orderBy("_r")
    ranges = ranges.select("_r", (F.sum("_n").over(order) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("_r").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("_i", F.sum(n).over(inside) - F.col(n)).join(F.broadcast(ranges), "_r").withColumn("before", F.col("_b") + F.col("_i")).drop("_r", "_b", "_i")


def five_numbers(rows: DataFrame, column: str) -> DataFrame:
    """One row: minimum, quartiles and maximum, exact (linear between ranks), by
    running totals of the counts of distinct values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = running_totals(counts, "v", "n")
    wanted = (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))
    # rank r (from 0) is held by the value with before <= r < before + n
    held = lambda r: F.max(F.when((F.col("before") <= r) & (r < F.col("before") + F.col("n")), F.col("v")))
    at = lambda q: (F.col("total") - 1) * F.lit(q)
    sides = placed.agg(F.max("total").alias("total"), *[held(f(at(q))).alias(f"{m}_{side}") for m, q in wanted for side, f in (("a", F.floor), ("b", F.ceil))])
    return sides.select(*[(F.col(f"{m}_a") + (F.col(f"{m}_b") - F.col(f"{m}_a")) * (at(q) - F.floor(at(q)))).alias(m) for m, q in wanted])


def histogram(rows: DataFrame, column: str, low: float, width: float) -> DataFrame:
    """(bin, n): counts of bins of equal width from `low`."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, in one pass."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return rows.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x")).select(F.inline("x"))


def log_ratios(shares: DataFrame, other: str = "other", floor: float = 1e-4) -> DataFrame:
    """(grp, type, v): ln(max(p, floor) / p of `other`) within each group."""
    base = shares.where(F.col("type") == other).select("grp", F.greatest(F.col("p"), F.lit(floor)).alias("base"))
    return shares.where(F.col("type") != other).join(base, "grp").select("grp", "type", F.log(F.greatest(F.col("p"), F.lit(floor)) / F.col("base")).alias("v"))


def first_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of smallest key."""
    return rows.orderBy(key).limit(n)


def last_rows(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of largest key."""
    return rows.orderBy(F.desc(key)).limit(n)


def head_tail_split(rows: DataFrame, key: str, n: int) -> DataFrame:
    """rows with `train`: whether the (distinct) key is among the n smallest.
    Only the n-th key comes to the driver; the rows are not sorted whole."""
    last = rows.select(key).orderBy(key).limit(n).agg(F.max(key)).first()[0]
    return rows.withColumn("train", F.lit(False) if last is None else F.col(key) <= F.lit(last))


def match_counts(words: DataFrame, types: DataFrame) -> DataFrame:
    """(type, n): how many rows of words(word) equal each type, 0 included."""
    n = words.groupBy(F.col("word").alias("type")).agg(F.count("*").alias("n"))
    return types.select("type").distinct().join(n, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))
