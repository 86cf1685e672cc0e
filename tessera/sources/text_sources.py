"""Readers of line, token, vector and matrix files. Each returns a frame with
explicit columns. Line numbers count from 0 in the order of file names and of
lines in them, however a scan deals files and their blocks to tasks: one pass
counts the rows of each block (the same scan gives the same blocks), so that
files which split differently still agree row by row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessera.functions import text as T

LONGEST_QUOTED = 47


def _placed(rows: DataFrame) -> DataFrame:
    """rows of a scan with their block (_file, _block) and a number _m that
    rises inside it."""
    try:
        placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    except AnalysisException:  # not a scan of files: partitions are the blocks
        placed = rows.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_block"))
    return placed.withColumn("_m", F.monotonically_increasing_id())


def _blocks(placed: DataFrame, size: Column, first: Column | None = None) -> list:
    """The blocks in order: _file, _block, low (the least _m), start (the sum of
    `size` over earlier blocks), and the first value of `first`. One row a
    block, as the scan's own list of splits on the driver."""
    head = F.min_by(first, "_m") if first is not None else F.lit(None)
    found = placed.groupBy("_file", "_block").agg(F.min("_m").alias("low"), F.sum(size).alias("n"), head.alias("first")).collect()
    out, at = [], 0
    for r in sorted(found, key=lambda r: (r["_file"], r["_block"])):
        out.append((r["_file"], r["_block"], r["low"], at, r["n"], r["first"]))
        at += r["n"]
    return out


def with_numbers(rows: DataFrame, out: str) -> DataFrame:
    """rows of a scan with their number, from 0, without gaps."""
    placed = _placed(rows)
    starts = [(f, b, low, start) for f, b, low, start, *_ in _blocks(placed, F.lit(1))]
    blocks = rows.sparkSession.createDataFrame(starts, "_file string, _block long, _low long, _start long")
    number = F.col("_start") + F.col("_m") - F.col("_low")
    return placed.join(F.broadcast(blocks), ["_file", "_block"], "left").select(number.alias(out), *[F.col(f"`{c}`") for c in rows.columns])


def numbered(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line_no, value)."""
    return with_numbers(lines.select(F.col(column).alias("value")), "line_no")


def corpus(spark: SparkSession, path: str, has_y: bool = False) -> DataFrame:
    """(doc_id, y, text) of one document a line; with has_y the first token is
    the response, null where it isn't a number (the text keeps its tokens)."""
    rows = numbered(spark.read.text(path)).withColumnRenamed("line_no", "doc_id")
    if not has_y:
        return rows.select("doc_id", F.lit(None).cast("double").alias("y"), F.col("value").alias("text"))
    first = F.regexp_extract("value", "^[ \\t\\n\\x0B\\f\\r]*([^ \\t\\n\\x0B\\f\\r]*)", 1)
    y = first.try_cast("double")
    rest = F.regexp_replace("value", "^[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]*[ \\t\\n\\x0B\\f\\r]?", "")
    return rows.select("doc_id", y.alias("y"), F.when(y.isNull(), F.col("value")).otherwise(rest).alias("text"))


def tagged_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(seq, type, pos) of white-space separated pairs, read as one stream:
    a pair may lie on two lines. A last type without a tag is left out."""
    rows = _placed(spark.read.text(path).select(T.tokens(F.col("value")).alias("t"))).where(F.size("t") > 0)
    blocks = _blocks(rows, F.size("t"), F.col("t")[0])
    starts = {(f, b): start for f, b, _, start, *_ in blocks}
    # what completes a pair that began in the block before
    following = {(x[0], x[1]): y[5] for x, y in zip(blocks, blocks[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(at: int, toks: list[str]) -> pa.RecordBatch:
            n = len(toks) // 2
            return pa.RecordBatch.from_arrays([pa.array(range(at // 2, at // 2 + n), pa.int64()), pa.array(toks[::2], pa.string()), pa.array(toks[1::2], pa.string())], names=["seq", "type", "pos"])

        now, at, held = None, 0, []
        for b in batches:
            for line, place in zip(b.column(0).to_pylist(), zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True), strict=True):
                if place != now:
                    if held and now in following:
                        held.append(following[now])
                    yield pairs(at, held[: len(held) // 2 * 2])
                    now, at, held = place, starts[place], []
                    if at % 2:  # the block before takes the first token
                        line, at = line[1:], at + 1
                held += line
            done = len(held) // 2 * 2
            yield pairs(at, held[:done])
            at, held = at + done, held[done:]
        if held and now in following:
            yield pairs(at, [held[0], following[now]])

    return rows.select("t", "_file", "_block").mapInArrow(run, "seq long, type string, pos string")


def tagged_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(seq, type, pos) of tab-separated tagger output."""
    schema = S.StructType([S.StructField("type", S.StringType()), S.StructField("pos", S.StringType())])
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)
    return with_numbers(rows, "seq").where("pos is not null")


def _vector(parts: Column) -> Column:
    return F.transform(parts, lambda v: v.try_cast("double"))


def quoted_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, type, vec) under a header; types stand in quotes, and those of
    over 47 characters are left out."""
    rows = numbered(spark.read.text(path))
    head = rows.orderBy("line_no").limit(1).select(F.col("line_no").alias("h"), (F.size(T.tokens(F.col("value"))) - 1).alias("dims"))
    body = rows.crossJoin(F.broadcast(head)).where("line_no <> h")
    name = F.regexp_extract("value", '^\\s*"([^"]*)"', 1)
    vec = _vector(T.tokens(F.regexp_replace("value", '^\\s*"[^"]*"', "")))
    out = body.select("line_no", name.alias("type"), vec.alias("vec"), "dims")
    return out.where((F.length("type") > 0) & (F.length("type") <= LONGEST_QUOTED) & (F.size("vec") == F.col("dims"))).drop("dims")


def plain_vectors(spark: SparkSession, path: str, downcase: bool = False) -> DataFrame:
    """(line_no, type, vec) of lines `type v1 v2 ...`, without a header."""
    t = T.tokens(F.col("value"))
    name = F.element_at(t, 1)
    rows = numbered(spark.read.text(path)).where(F.size(t) > 1)
    return rows.select("line_no", (T.ascii_lower(name) if downcase else name).alias("type"), _vector(F.slice(t, 2, F.size(t) - 1)).alias("vec"))


def vocabulary(spark: SparkSession, path: str, downcase: bool = False) -> DataFrame:
    from tessera.operators.vocab import lowercase_types

    return lowercase_types(spark.read.text(path).withColumnRenamed("value", "text"), downcase)


def matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(row_id, x) of a tab-separated numeric file with a header."""
    schema = S.StructType([S.StructField(n, S.DoubleType()) for n in names])
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)
    return with_numbers(rows.select(F.array(*[F.col(f"`{n}`") for n in names]).alias("x")), "row_id")


def aligned(first: DataFrame, *others: DataFrame) -> DataFrame:
    """The matrices side by side by row_id: (row_id, x0, x1, ...). Different
    numbers of rows raise an error."""
    counts = [m.count() for m in (first, *others)]
    if len(set(counts)) > 1:
        raise ValueError(f"matrices of different lengths: {counts}")
    out = first.withColumnRenamed("x", "x0")
    for k, m in enumerate(others, 1):
        out = out.join(m.withColumnRenamed("x", f"x{k}"), "row_id")
    return out


def header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """Field names of a file's first line."""
    first = spark.read.text(path).first()
    return first[0].split(sep) if first else []


def counts_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(type, n) of token and count."""
    return spark.read.schema("type string, n long").option("sep", "\t").option("quote", "").csv(path)


def replies(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, toks) of survey replies, lower-case, one a line."""
    rows = numbered(spark.read.text(path)).withColumnRenamed("line_no", "doc_id")
    return rows.select("doc_id", T.reply_tokens(F.col("value")).alias("toks"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def count_fields(spark: SparkSession, path: str) -> int:
    first = spark.read.text(path).select(F.size(T.tokens(F.col("value")))).first()
    return first[0] if first else 0


def coded_survey(spark: SparkSession, path: str, codes: int, transcript: str = "InterviewerTranscript", code: str = "Code") -> DataFrame:
    """(id, transcript, codes, n_codes) of a CSV with one column a code."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    listed = F.filter(F.array(*[F.col(f"`{code}{k}`").try_cast("int") for k in range(codes)]), lambda v: v.isNotNull())
    return with_numbers(rows, "_id").select(F.col("_id").alias("id"), F.col(f"`{transcript}`").alias("transcript"), listed.alias("codes"), F.size(F.array_distinct(listed)).alias("n_codes"))
