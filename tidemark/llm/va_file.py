"""Exact top-k search by a vector-approximation file.

Each component of a vector is quantised to one of at most 256 cells, whose bounds are quantiles of a sample, so that a few
vectors that are much longer than the rest don't widen the others' cells. The file of cells is an eighth of the vectors. A
search scans the cells only: for a query, a cell bounds each component's product from both sides, and the sums bound the
inner product. One scan finds the k highest lower bounds of each query, a second one the vectors whose upper bound reaches the
k-th of them. Those are read exactly in the order of their upper bounds, in rounds of doubling size, until the k-th score
found passes the next bound and so is certain. Only the cells' bounds are fitted to a sample; the results are exact.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .vectors import QUERY_ROWS, across, best, cleaned, filled_up, in_blocks, named, told_apart, unpacked

CELLS = 256
#: Vectors from which the cells' bounds are taken.
SAMPLE_ROWS = 20_000
#: Cells of one block: 1 MB at 64 components; of which a scan takes so many vectors at a time.
BLOCK_ROWS = 16_384
SCAN_ROWS = 512
#: Integer vectors with a sum of squares from here on are long: products with them may not fit a long and are taken in whole numbers of any size.
MOST_SQUARES = float(1 << 62)
#: Long vectors, and others that meet them, of one block.
LONG_ROWS = 1024
#: Stands for a product below all longs.
BELOW = -(1 << 63)


class Cells:
    """The cells of each component: cell c of a component holds the integers from low[component, c] to high[component, c]."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        marks = np.ceil(np.quantile(sample, np.linspace(0, 1, CELLS + 1)[1:-1], axis=0)).T
        self.bounds = []
        self.low, self.high = np.zeros((len(least), CELLS)), np.zeros((len(least), CELLS))
        for k, (lo, hi) in enumerate(zip(least, most, strict=True)):
            inner = np.unique(marks[k])
            # Where a component has few values, each has a cell of its own.
            values = np.unique(sample[:, k])
            inner = np.unique(np.concatenate([values, values + 1])) if 2 * len(values) < CELLS else inner
            inner = inner[(inner > lo) & (inner <= hi)]
            self.bounds.append(inner)
            self.low[k, : len(inner) + 1] = np.concatenate([[lo], inner])
            self.high[k, : len(inner) + 1] = np.concatenate([inner - 1, [hi]])
        self.largest = np.maximum(np.abs(least), np.abs(most))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(b, x, side="right") for b, x in zip(self.bounds, vectors.T, strict=True)], axis=1).astype(np.uint8)

    def limits(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest vectors of cells."""
        at = np.arange(cells.shape[1])
        return self.low[at, cells], self.high[at, cells]

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """What rounding can take from a bound: nothing where doubles hold all sums exactly."""
        size = np.abs(queries) @ self.largest
        return np.where(size < 1 << 52, 0.0, size * 2.0**-40)


def _whole(scale: int, long: bool):
    """The integer vectors of one kind: as longs, or long ones as doubles, which hold them exactly (a scale of a power of two)."""

    def run(vector: np.ndarray) -> np.ndarray | None:
        with np.errstate(over="ignore"):
            x = np.floor(scale * vector)
            if ((x * x).sum() >= MOST_SQUARES) != long:
                return None
            return vector if long else x.astype(np.int64)

    return run


def _exact(vector: np.ndarray, scale: int) -> list[int]:
    return [math.floor(scale * Fraction(x)) for x in vector.tolist()]


def _long_products(scale: int, k: int):
    """For each query of a block, its k highest products with a block of vectors, in whole numbers of any size; at least one of both is long."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        ints = lambda t: [_exact(np.frombuffer(v, dtype=np.float64), scale) if w else np.frombuffer(v, dtype=np.int64).tolist() for v, w in zip(t.column("vector").to_pylist(), t.column("long").to_pylist(), strict=True)]
        out = []
        if len(asked) and len(held):
            vectors = list(zip(held.column("vec_id").to_pylist(), ints(held), held.column("long").to_pylist(), strict=True))
            for q, x, wide in zip(asked.column("vec_id").to_pylist(), ints(asked), asked.column("long").to_pylist(), strict=True):
                scores = ((-sum(a * b for a, b in zip(x, y, strict=False)), v) for v, y, w in vectors if v != q and (wide or w))
                out += [(q, v, max(-minus, BELOW)) for minus, v in heapq.nsmallest(k, scores)]
        if any(score >= 1 << 63 for *_, score in out):
            raise ValueError("a score doesn't fit a long")
        return pa.table({c: pa.array([row[n] for row in out], pa.int64()) for n, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least and the greatest of each component, of each batch."""
    for batch in batches:
        if len(batch):
            x = unpacked(batch.column(0), np.int64)
            columns = [pa.array(range(x.shape[1]), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))]
            yield pa.RecordBatch.from_arrays(columns, ["component", "lo", "hi"])


def _approximate(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = shared.value.of(unpacked(batch.column(1), np.int64)) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary())], ["vec_id", "cells"])

    return run


def _scanned(cells: Cells, ids: np.ndarray, queries: np.ndarray, block: pa.Table, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vector ids, bounds of the products of each query with each) of the block in the order of ids; -inf for a query's own row."""
    vec = block.column("vec_id").to_numpy()
    order = np.argsort(vec)
    packed = unpacked(block.column("cells"), np.uint8)
    plus, minus, slack = np.maximum(queries, 0), np.minimum(queries, 0), cells.slack(queries)[:, None]
    for at in range(0, len(vec), SCAN_ROWS):
        rows = order[at : at + SCAN_ROWS]
        low, high = cells.limits(packed[rows])
        bound = plus @ high.T + minus @ low.T + slack if upper else plus @ low.T + minus @ high.T - slack
        own = np.searchsorted(ids, vec[rows])
        mine = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == vec[rows]))
        bound[own[mine], mine] = -np.inf
        yield vec[rows], bound


def _queries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, vectors, and the order of the rows."""
    ids = table.column("vec_id").to_numpy()
    order = np.argsort(ids)
    return ids[order], unpacked(table.column("vector"), np.int64)[order].astype(np.float64), order


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the left."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    kth = np.partition(scores, -k, axis=1)[:, -k][:, None]
    tie = scores == kth
    room = k - (scores > kth).sum(axis=1)[:, None]
    return np.nonzero((scores > kth) | (tie & (np.cumsum(tie, axis=1) <= room)))[1].reshape(len(scores), k)


def _lower(shared, k: int):
    """For each query of a block, the k highest lower bounds in a block of vectors, as one row."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(held):
            ids, queries, _ = _queries(asked)
            tops, their = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), dtype=np.int64)
            for vec, bound in _scanned(shared.value, ids, queries, held, upper=False):
                both, all_ids = np.concatenate([tops, bound], axis=1), np.concatenate([their, np.broadcast_to(vec, bound.shape)], axis=1)
                first = _first(both, k)
                tops, their = np.take_along_axis(both, first, axis=1), np.take_along_axis(all_ids, first, axis=1)
            out = [(int(q), [{"minus": -b, "vec_id": int(v)} for b, v in zip(bs, vs, strict=True) if b > -np.inf]) for q, bs, vs in zip(ids, tops.tolist(), their.tolist(), strict=True)]
        kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "bounds": pa.array([x[1] for x in out], kind)})

    return run


def _reaching(shared):
    """The vectors of a block whose upper bound reaches a query's k-th lower bound; of equal ones those with smaller ids."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if len(asked) and len(held):
            ids, queries, order = _queries(asked)
            kth = asked.column("kth").to_numpy()[order][:, None]
            last = asked.column("last").to_numpy()[order][:, None]
            for vec, bound in _scanned(shared.value, ids, queries, held, upper=True):
                q, v = np.nonzero(((bound > kth) | ((bound == kth) & (vec[None, :] <= last))) & (bound > -np.inf))
                found.append((ids[q], vec[v], bound[q, v]))
        q, v, upper = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": q, "vec_id": v, "upper": upper})

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            score = (unpacked(batch.column(2), np.int64) * unpacked(batch.column(3), np.int64)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """The k highest integer inner products of each query.

    vectors: vec_id long, embedding array of numbers (more columns are ignored). Components x count as floor(scale * x). Queries are the rows
    whose vec_id is divisible by `every`, candidates all rows but the query's own. Returns query_id, rank (from 1), vec_id,
    score; ties go to the smaller vec_id; fewer candidates than k give fewer rows. Vectors that are null or empty or hold a
    null or non-finite component take no part, nor do rows without an id. Shorter vectors count as filled up with zeros. Rows that
    repeat an id are vectors of their own, each a query and a candidate of the others. Integer vectors of a length of 2^31 or
    more are searched without bounds, block against block, in whole numbers of any size; a result that doesn't fit a long
    raises an error. Equal vectors are told apart by their ids. An empty table gives an empty result.
    """
    kind = lambda long: cleaned(vectors, _whole(scale, long)).withColumn("long", F.lit(long))
    every_row = stored(kind(False).unionByName(kind(True)))
    table, renamed = told_apart(every_row)
    asks = F.col("of") % every == 0
    found = _top_of_short(table.filter("not long").drop("long"), asks, k)
    wide = table.filter("long")
    if not wide.isEmpty():
        pairs = [(table.filter(asks), wide), (wide.filter(asks), table.filter("not long"))]
        parts = [found.select("query_id", "vec_id", "score")]
        for asked, held in pairs:
            (asked, q_blocks), (held, v_blocks) = in_blocks(asked, "q_block", LONG_ROWS), in_blocks(held, "v_block", LONG_ROWS)
            parts.append(across(asked, q_blocks, held, v_blocks, _long_products(scale, k), "query_id long, vec_id long, score long"))
        found = stored(best(reduce(DataFrame.unionByName, parts), k))
        if not found.filter(F.col("score") == BELOW).isEmpty():
            raise ValueError("a score doesn't fit a long")
    return named(found, table) if renamed else found


def _top_of_short(table: DataFrame, asks: Column, k: int) -> DataFrame:
    """exact_top_k of integer vectors whose products fit a long, with ids that tell rows apart."""
    spark = table.sparkSession
    longest, shortest, rows = table.agg(F.max(F.octet_length("vector")), F.min(F.octet_length("vector")), F.count(F.lit(1))).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if longest != shortest:
        table = stored(filled_up(table, longest // 8))
    limits = table.select("vector").mapInArrow(_ranges, "component int, lo long, hi long").groupBy("component").agg(F.min("lo"), F.max("hi"))
    least, most = np.array([r[1:] for r in sorted(limits.collect())], dtype=np.float64).T  # a row for each component
    part = table.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0).select("vector").limit(2 * SAMPLE_ROWS)
    sample = np.frombuffer(b"".join(bytes(r.vector) for r in part.collect()), dtype=np.int64).reshape(-1, longest // 8).astype(np.float64)
    cells = spark.sparkContext.broadcast(Cells(sample if len(sample) else np.stack([least, most]), least, most))
    held, v_blocks = in_blocks(stored(table.select("vec_id", "vector").mapInArrow(_approximate(cells), "vec_id long, cells binary")), "v_block", BLOCK_ROWS)
    asked, q_blocks = in_blocks(table.filter(asks).drop("of"), "q_block", QUERY_ROWS)

    lower = across(asked, q_blocks, held, v_blocks, _lower(cells, k), "query_id long, bounds array<struct<minus:double,vec_id:long>>")
    firsts = F.slice(F.sort_array(F.flatten(F.collect_list("bounds"))), 1, k)
    kth = stored(lower.groupBy("query_id").agg(firsts.alias("first")).select("query_id", F.get("first", F.lit(k - 1)).alias("kth")))
    known = asked.join(kth, asked["vec_id"] == kth["query_id"]).select("vec_id", "vector", "q_block", F.coalesce(-F.col("kth.minus"), F.lit(float("-inf"))).alias("kth"), F.coalesce("kth.vec_id", F.lit((1 << 63) - 1)).alias("last"))
    reached = across(known, q_blocks, held, v_blocks, _reaching(cells), "query_id long, vec_id long, upper double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id"))
    visits = stored(reached.withColumn("turn", turn))
    query_vectors = table.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))

    def read(visits: DataFrame) -> DataFrame:
        return visits.select("query_id", "vec_id").join(table.drop("of"), "vec_id").join(query_vectors, "query_id").select("query_id", "vec_id", "vector", "query").mapInArrow(_products, "query_id long, vec_id long, score long")

    upto = k
    scored = stored(read(visits.filter(F.col("turn") <= upto)))
    while True:
        sure = best(scored, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("sure"), F.col("vec_id").alias("last"))
        passes = (F.col("upper") > F.col("sure")) | ((F.col("upper") == F.col("sure")) & (F.col("vec_id") < F.col("last")))
        left = stored(visits.filter(F.col("turn") > upto).join(sure, "query_id").filter(passes).select("query_id", "vec_id", "upper", "turn"))
        if left.isEmpty():
            return best(scored, k)
        visits, begun, upto = left, upto, 2 * upto
        scored = stored(best(scored, k).select("query_id", "vec_id", "score").unionByName(read(visits.filter((F.col("turn") > begun) & (F.col("turn") <= upto)))))
