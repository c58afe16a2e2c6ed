"""What the vector searches share: reading vectors from Arrow, blocks of queries against blocks of vectors, and the best k of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, stored

#: Queries of one block: 4 MB at 64 components.
QUERY_ROWS = 8192


def clean_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists: the rows that have a vector of finite components, and their vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows, vectors = [], []
    flat = column.values.cast(pa.float64())
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for k in np.flatnonzero(valid):
        lo, hi = offsets[k], offsets[k + 1]
        if hi > lo and not nulls[lo:hi].any() and np.isfinite(values[lo:hi]).all():
            rows.append(k)
            vectors.append(values[lo:hi])
    return np.array(rows, dtype=np.int64), vectors


def cleaned(vectors: DataFrame, usable: Callable[[np.ndarray], np.ndarray | None]) -> DataFrame:
    """(vec_id, vector): what `usable` makes of each vector, packed as bytes; rows without an id or for which it gives None are left out.
    All numbers have eight bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = clean_vectors(batch.column(1))
            kept = [(k, v.tobytes()) for k, v in zip(rows, map(usable, found), strict=True) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in kept], pa.int64())), pa.array([v for _, v in kept], pa.binary())], ["vec_id", "vector"])

    raw = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return raw.mapInArrow(run, "vec_id long, vector binary")


def told_apart(table: DataFrame) -> tuple[DataFrame, bool]:
    """table with a vec_id for each row and a column `of`, and whether these are new: the ids themselves (`of`), or where rows repeat
    one, the rows' places in the order of ids, so that ties go as before."""
    kept = stored(table)
    if kept.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return kept.withColumn("of", F.col("vec_id")), False
    placed = in_order(kept, [F.col("vec_id"), F.col("vector")], [])
    return stored(placed.withColumn("of", F.col("vec_id")).withColumn("vec_id", F.col("__number").cast("long")).drop("__number")), True


def named(found: DataFrame, table: DataFrame) -> DataFrame:
    """The rows found, under the ids that told_apart has replaced."""
    at = lambda c: table.select(F.col("vec_id").alias(c), F.col("of").alias(f"{c}_of"))
    out = found.join(at("query_id"), "query_id").join(at("vec_id"), "vec_id")
    return out.select(F.col("query_id_of").alias("query_id"), "rank", F.col("vec_id_of").alias("vec_id"), "score")


def filled_up(table: DataFrame, width: int) -> DataFrame:
    """Vectors shorter than `width` numbers filled up with zeros."""
    missing = F.lit(width * 8) - F.octet_length("vector")
    return table.withColumn("vector", F.concat("vector", F.unhex(F.repeat(F.lit("00"), missing))))


def unpacked(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """The matrix of a column of equally long binary vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def in_blocks(table: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    """table with a column that deals it to blocks of about `rows` rows, and the number of blocks."""
    blocks = max(1, -(-table.count() // rows))
    return table.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), blocks


def across(queries: DataFrame, query_blocks: int, vectors: DataFrame, vector_blocks: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(queries, vectors) over every pair of a block of queries (q_block) and a block of vectors (v_block): one job, a task a pair."""
    asked = queries.withColumn("v_block", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))))
    held = vectors.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    return asked.groupBy("q_block", "v_block").cogroup(held.groupBy("q_block", "v_block")).applyInArrow(search, schema)


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller vec_id, with their rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
