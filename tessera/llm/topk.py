"""Exact top-k inner-product search by tiles (op8).

Queries and candidates are hashed by vec_id into blocks of about BLOCK rows;
each pair of a query block and a candidate shard is one tile, multiplied as
one matrix product in float64, which is exact while sums stay under 2^53
(checked; larger components go through Python integers). In a tile, score and
position make one key, and a partial selection keeps k of them for each query.
Lists of tiles are merged in a tree: first inside groups of FAN shards, then
over the groups.

Exact search looks at every pair, so each candidate goes to every block of
queries: it is copied once for each BLOCK queries.

Copies of one vector need no care: keys are unique, so ties never grow a list.

Defined results: null vectors, and vectors that hold null or non-finite
components, take no part; vectors of different lengths meet as if the shorter
ended in zeros; empty vectors score 0; null vec_ids take no part; a vec_id
that repeats is one query (its first vector by its components), and its other
rows stay candidates of other queries. Scores outside 64 bits raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship

BLOCK, FAN, TILE = 8192, 16, 2048


def quantise(vectors: DataFrame, factor: float = 256.0) -> DataFrame:
    """vec_id and floor(factor * x) of each finite vector, as whole doubles."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    # components go as doubles: floor() to long would saturate huge ones unseen
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: v * F.lit(factor)).alias("scaled"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = a.offsets.to_numpy().astype(np.int64)
    flat = np.floor(a.values.to_numpy(zero_copy_only=False))
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    if sizes.sum():
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = flat[offsets[0] : offsets[-1]]
    return out


def _width(column: pa.ChunkedArray) -> int:
    return max((len(x) for x in column), default=0)


def tile_top(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The k best candidates of the shard for each query."""
    kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    out: list[pa.RecordBatch] = []
    if queries.num_rows and shard.num_rows:
        qid, ids = queries.column("query_id").to_numpy(), shard.column("vec_id").to_numpy()
        width = max(_width(queries.column("scaled")), _width(shard.column("scaled")), 1)
        q, c = _matrix(queries.column("scaled"), width), _matrix(shard.column("scaled"), width)
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], c[order]
        exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * width * TILE < 2**52
        for at in range(0, len(ids), TILE):
            part, own = c[at : at + TILE], ids[at : at + TILE]
            for row in range(0, len(qid), 512):
                some, who = q[row : row + 512], qid[row : row + 512]
                if exact:
                    key = (some @ part.T) * TILE + (TILE - 1 - np.arange(len(own)))
                    key[who[:, None] == own[None, :]] = -np.inf
                else:
                    whole = np.array([[int(v) for v in r] for r in some], object).dot(np.array([[int(v) for v in r] for r in part], object).T)
                    key = whole * TILE + (TILE - 1 - np.arange(len(own))).astype(object)
                    key[who[:, None] == own[None, :]] = -(1 << 4000)
                best = np.argpartition(-key, k - 1, axis=1)[:, :k] if exact and len(own) > k else np.argsort(-key, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(key, best, 1)
                keep = top > -np.inf if exact else top > -(1 << 4000)
                score = (top // TILE)[keep]
                out.append(pa.record_batch([pa.array(np.repeat(who, keep.sum(1).astype(int))), pa.array(own[best][keep.astype(bool)]), pa.array([int(x) for x in score], pa.int64())], schema=kinds))
    return pa.Table.from_batches(out, kinds)


def _best(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("query_id", *keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: the k candidates of highest inner
    product for each row of vectors(vec_id, embedding) that is_query (a Column
    condition) picks, against all other rows."""
    spark = vectors.sparkSession
    ship(spark)
    rows = quantise(vectors)
    chosen = rows.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("scaled").alias("scaled"))
    counts = vectors.select(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, shards = max(1, -(-counts["q"] // block)), max(1, -(-counts["n"] // block))
    cell = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    left = chosen.withColumn("qb", cell("query_id", blocks, 1)).withColumn("sh", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # repeated vec_ids spread by their components as well
    right = rows.withColumn("sh", F.pmod(F.xxhash64("vec_id", "scaled"), F.lit(shards)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        from tessera.llm.topk import tile_top

        found = tile_top(queries, shard, k)
        at = shard.column("sh")[0].as_py() if shard.num_rows else 0
        return found.append_column("fan", pa.array([at // FAN] * found.num_rows, pa.int32()))

    lists = left.groupBy("qb", "sh").cogroup(right.groupBy("qb", "sh")).applyInArrow(run, "query_id long, vec_id long, score long, fan int")
    merged = _best(lists, k, "fan").select("query_id", "vec_id", "score") if shards > FAN else lists
    return _best(merged, k).select("query_id", "rank", "vec_id", "score")
