"""Word-vector dictionaries: (type, vec) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.vocab import OOV

MISSING = "NA"


def restrict(rows: DataFrame, vocab: DataFrame, dims: int = 0) -> DataFrame:
    """(type, vec) of rows(line_no, type, vec): the first line is OOV, types
    outside the vocabulary go, later lines replace earlier ones, vectors keep
    their first `dims` components (0: all), and NA holds NaN. Empty where the
    vectors are shorter than dims."""
    vec = F.slice("vec", 1, dims) if dims else F.col("vec")
    rows = rows.select("line_no", "type", vec.alias("vec"), F.size("vec").alias("width"))
    if dims:
        rows = rows.where(F.col("width") >= dims)
    first = rows.agg(F.min_by(F.struct("vec"), "line_no").alias("s"), F.min("line_no").alias("line_no")).where("line_no is not null")
    known = rows.join(first.select(F.col("line_no").alias("l0")), F.col("line_no") == F.col("l0"), "left_anti").join(vocab.select("type").distinct(), "type", "left_semi")
    last = known.groupBy("type").agg(F.max_by("vec", "line_no").alias("vec"))
    ends = first.select(F.lit(OOV).alias("type"), F.col("s.vec").alias("vec")).unionByName(first.select(F.lit(MISSING).alias("type"), F.transform("s.vec", lambda _: F.lit(float("nan"))).alias("vec")))
    return last.where(~F.col("type").isin(OOV, MISSING)).unionByName(ends.select("type", F.col("vec").cast(dict(last.dtypes)["vec"]).alias("vec")))


def random_dictionary(vocab: DataFrame, dims: int, seed: int) -> DataFrame:
    """(type, vec) of normal deviates for every type, OOV among them; NA: NaN."""
    types = vocab.select("type").where(~F.col("type").isin(OOV, MISSING)).distinct()
    types = types.unionByName(vocab.sparkSession.createDataFrame([(OOV,)], "type string"))
    # deviates hang on the type alone: Box-Muller over hashes, the same on every plan
    unit = lambda k: (F.pmod(F.xxhash64("type", F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = [F.sqrt(-2 * F.log(unit(2 * k))) * F.cos(2 * 3.141592653589793 * unit(2 * k + 1)) for k in range(dims)]
    nan = vocab.sparkSession.createDataFrame([(MISSING, [float("nan")] * dims)], "type string, vec array<double>")
    return types.select("type", F.array(*normal).alias("vec")).unionByName(nan)


def lookup(types: DataFrame, dictionary: DataFrame, dims: int) -> DataFrame:
    """types with vec; a vector of zeros where the dictionary has none."""
    return types.join(dictionary.select("type", "vec"), "type", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)))


def missing(vocab: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Types of the vocabulary without a vector."""
    return vocab.select("type").distinct().join(dictionary, "type", "left_anti")


def missing_sample(vocab: DataFrame, dictionary: DataFrame, every: int = 128) -> DataFrame:
    """Every 128th missing type, in order. Places are running totals over first
    letters and a number inside each, so no task sorts all types."""
    gone = missing(vocab, dictionary).withColumn("_h", F.substring("type", 1, 2))
    sizes = gone.groupBy("_h").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_h", (F.sum("_n").over(Window.orderBy("_h")) - F.col("_n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_h").orderBy("type"))
    return gone.withColumn("_i", inside).join(sizes, "_h").where((F.col("_b") + F.col("_i") - 1) % every == 0).select("type")


def train_vectors(arrays: DataFrame, dims: int = 100, min_count: int = 5, window: int = 5, rounds: int = 1, seed: int = 1) -> DataFrame:
    """(type, vec): skip-gram word vectors of arrays(toks), by MLlib."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dims, minCount=min_count, windowSize=window, maxIter=rounds, seed=seed, inputCol="toks", outputCol="out").fit(arrays)
    return model.getVectors().select(F.col("word").alias("type"), vector_to_array("vector").alias("vec"))


def centroids(tokens: DataFrame, dictionary: DataFrame, dims: int) -> DataFrame:
    """(doc_id, found, vec): the mean vector of the tokens that have one; zeros
    where none has. Sums go by document and dimension, so tokens meet the
    dictionary once per distinct type of a document."""
    each = tokens.groupBy("doc_id", F.col("tok").alias("type")).agg(F.count("*").alias("n"))
    hit = each.join(dictionary.select("type", "vec"), "type")
    sums = hit.select("doc_id", "n", F.posexplode("vec").alias("d", "x")).groupBy("doc_id", "d").agg(F.sum(F.col("n") * F.col("x").cast("double")).alias("s"), F.sum("n").alias("found"))
    vec = sums.groupBy("doc_id").agg(F.max("found").alias("found"), F.transform(F.sort_array(F.collect_list(F.struct("d", (F.col("s") / F.col("found")).alias("x")))), lambda s: s["x"]).alias("vec"))
    return tokens.select("doc_id").distinct().join(vec, "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("vec", F.array_repeat(F.lit(0.0), dims)).alias("vec"))
