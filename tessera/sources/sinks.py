"""Writers. Tab-separated files with a header unless said otherwise; each call
writes a folder, as tasks do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").csv(path)


def frequencies(types: DataFrame, path: str) -> None:
    """Counts alone, in lexicographic order of types."""
    write_tsv(types.orderBy("type").select("freq"), path, header=False)


def first_oov(oov: DataFrame, n: int, path: str) -> None:
    write_tsv(oov.orderBy("type").limit(n), path)


def word_columns(dtm: DataFrame, vocab: DataFrame, k: int, path: str) -> None:
    """Documents by their counts of the first k types, one column a type."""
    names = vocab.where(F.col("idx") < k).orderBy("idx").select("idx", "type").collect()
    wide = dtm.where(F.col("idx") < k).groupBy("doc_id").pivot("idx", [r["idx"] for r in names]).agg(F.first("n")).na.fill(0)
    write_tsv(wide.select("doc_id", *[F.col(str(r["idx"])).alias(r["type"]) for r in names]), path)


def wide(rows: DataFrame, k: int, prefix: str, *keys: str, column: str = "x") -> DataFrame:
    """Arrays as columns prefix0, prefix1, ..."""
    return rows.select(*keys, *[F.col(column)[d].alias(f"{prefix}{d}") for d in range(k)])


def matrix(rows: DataFrame, k: int, prefix: str, path: str, *keys: str) -> None:
    write_tsv(wide(rows, k, prefix, *keys), path)


def named_vectors(rows: DataFrame, vocab: DataFrame, k: int, path: str) -> None:
    """Vectors (i, x) with the names of their types."""
    named = rows.join(vocab.select(F.col("idx").alias("i"), "type"), "i").orderBy("i")
    write_tsv(wide(named, k, "c", "type"), path)


def svd(left: DataFrame, d, right: DataFrame, k: int, path: str) -> None:
    """Three tables: path_u, path_d and path_v."""
    matrix(left, k, "U", f"{path}_u", "i")
    left.sparkSession.createDataFrame([(n, float(x)) for n, x in enumerate(d)], "k int, d double").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}_d")
    matrix(right, k, "V", f"{path}_v", "i")


def responses(rows: DataFrame, path: str) -> None:
    """Y and document length."""
    write_tsv(rows.select(F.col("y").alias("Y"), "m"), path)


def steps(spark, rows: list, path: str) -> None:
    """A table of model steps: dataclasses or dicts."""
    dicts = [r if isinstance(r, dict) else r.__dict__ for r in rows]
    dicts = [{k: v.item() if hasattr(v, "item") else v for k, v in d.items()} for d in dicts]
    if dicts:
        write_tsv(spark.createDataFrame(dicts).coalesce(1), path)


def tag_margins(counts: DataFrame, path: str) -> None:
    """Type and tag totals, as two folders."""
    write_tsv(counts.groupBy("type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "type"), f"{path}_types")
    write_tsv(counts.groupBy("pos").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pos"), f"{path}_tags")


def centres(spark, values, summary: DataFrame, path: str) -> None:
    """One row a cluster: its size, distances, norm and centre."""
    rows = [(k, float((c @ c) ** 0.5), *map(float, c)) for k, c in enumerate(values)]
    named = spark.createDataFrame(rows, ["cluster", "norm", *[f"D{d}" for d in range(values.shape[1])]])
    write_tsv(named.join(summary, "cluster", "left").select("cluster", "n", "rms", "furthest", "norm", *[f"D{d}" for d in range(values.shape[1])]).orderBy("cluster").coalesce(1), path)


def column_stream(df: DataFrame, roles: dict[str, str], path: str, order: str | None = None) -> None:
    """Three lines a column: its name, its role and its values in row order."""
    key = F.col(order) if order else F.monotonically_increasing_id()
    columns = [c for c in df.columns if c != order]
    long = df.select(key.alias("_at"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for k, c in enumerate(columns)])).alias("s"))
    lists = long.groupBy("s.k", "s.name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "s.v"))), lambda x: x["v"]), "\t").alias("values"))
    role = F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, roles.get(c, "x"))]), F.col("name"))
    lists.orderBy("k").select(F.concat_ws("\n", "name", role, "values").alias("value")).write.mode("overwrite").text(path)


def lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
