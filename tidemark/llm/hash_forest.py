"""Approximate nearest neighbours by a forest of hash prefixes.

The vectors are dealt at random to shards of a bounded size, every row to one. A shard is a forest, built once and stored:
in each tree, the vectors have a string of 9 symbols and are kept sorted by it. A symbol (7 bits) tells which of 64 random
directions a vector is nearest to, and on which side; near vectors share it far more often than they share 7 signs of
projections. A query descends in every tree to the longest prefix that it shares with another vector there, which differs from
tree to tree. From the deepest of these levels it ascends in all trees together, one symbol at a time; a tree joins in at its own
depth. The ascent ends when the ranges of the sorted arrays hold enough candidates. Those that most trees have met are scored
exactly. The best of the shards are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import QUERY_ROWS, across, best, cleaned, filled_up, in_blocks, named, told_apart, unpacked

SHARD_ROWS = 8192
TREES = 128
SYMBOLS, DIRECTIONS = 9, 64
SYMBOL_BITS = 7
#: Candidates that are scored at least (all rows, if fewer): this share of a shard's rows, and so many times k. The ascent ends
#: when as many are met; of more, those that as many trees have met as leave this number, ties included.
SCORED, SCORED_K = 0.06, 7
SEED = 20


def hash_strings(vectors: np.ndarray) -> np.ndarray:
    """The hash string, a number of 63 bits, of each vector (column) in each tree (row). A vector's length doesn't matter."""
    random = np.random.default_rng(SEED)
    out = np.zeros((TREES, len(vectors)), dtype=np.uint64)
    largest = np.abs(vectors).max(axis=1, initial=0, keepdims=True)
    unit = (vectors / np.where(largest > 0, largest, 1)).astype(np.float32)
    rows = np.arange(len(vectors))
    for tree in range(TREES):
        for _ in range(SYMBOLS):
            along = unit @ random.standard_normal((DIRECTIONS, vectors.shape[1]), dtype=np.float32).T
            nearest_to = np.abs(along).argmax(axis=1)
            symbol = 2 * nearest_to + (along[rows, nearest_to] > 0)
            out[tree] = out[tree] << np.uint64(SYMBOL_BITS) | symbol.astype(np.uint64)
    return out


def _bit_length(x: np.ndarray) -> np.ndarray:
    n = np.zeros(x.shape, dtype=np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        large = x >> np.uint64(step) > 0
        n += step * large
        x = np.where(large, x >> np.uint64(step), x)
    return n + (x > 0)


class Forest:
    """The sorted arrays of one shard's vectors."""

    def __init__(self, strings: np.ndarray, order: np.ndarray):
        self.strings, self.order = strings, order

    @classmethod
    def build(cls, vectors: np.ndarray) -> Forest:
        strings = hash_strings(vectors)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return cls(np.take_along_axis(strings, order, axis=1), order)

    def depths(self, strings: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """For each tree and query, the symbols of the longest prefix shared with a vector other than the query itself; inside: whether it is one of the vectors."""
        out = np.empty(strings.shape, dtype=np.int64)
        for tree, (own, wanted) in enumerate(zip(self.strings, strings, strict=True)):
            lo, hi = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
            near = [SYMBOLS - -(-_bit_length(own[np.clip(at, 0, len(own) - 1)] ^ wanted) // SYMBOL_BITS) for at in (lo - 1, hi)]
            before, behind = np.where(lo > 0, near[0], 0), np.where(hi < len(own), near[1], 0)
            out[tree] = np.where(hi - lo > inside, SYMBOLS, np.maximum(before, behind))
        return out

    def ranges(self, strings: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, the range of the sorted array that shares the first `level` symbols with each string."""
        rest = (np.uint64(1) << (SYMBOL_BITS * (SYMBOLS - level)).astype(np.uint64)) - np.uint64(1)
        lo = np.stack([np.searchsorted(own, s & ~rest, "left") for own, s in zip(self.strings, strings, strict=True)])
        hi = np.stack([np.searchsorted(own, s | rest, "right") for own, s in zip(self.strings, strings, strict=True)])
        return lo, hi

    def candidates(self, strings: np.ndarray, own: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows to score, at least `least` or all others; own: each query's row here, or -1."""
        level = self.depths(strings, own >= 0).max(axis=0)
        lo, hi = self.ranges(strings, level)
        while (up := ((hi - lo).sum(axis=0) < least) & (level > 0)).any():
            level = level - up
            lo[:, up], hi[:, up] = self.ranges(strings[:, up], level[up])
        for q, at in enumerate(level):
            begin, end = lo[:, q], hi[:, q]
            while True:
                meetings = np.bincount(np.concatenate([tree[a:b] for tree, a, b in zip(self.order, begin, end, strict=True)]), minlength=self.order.shape[1])
                if own[q] >= 0:
                    meetings[own[q]] = 0
                if at == 0 or np.count_nonzero(meetings) >= least:
                    break
                at -= 1
                begin, end = (x[:, 0] for x in self.ranges(strings[:, [q]], np.array([at])))
            met_so_often = np.cumsum(np.bincount(meetings)[::-1])[::-1]
            often = max(1, int(np.count_nonzero(met_so_often >= least)) - 1)
            yield np.flatnonzero(meetings >= often)


def _built(table: pa.Table) -> pa.Table:
    """One row with the ids, vectors and sorted arrays of a shard."""
    vectors = unpacked(table.column("vector"))
    forest = Forest.build(vectors)
    ids = table.column("vec_id").to_numpy()
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, forest.strings, forest.order)]
    return pa.table([table.column("v_block").slice(0, 1).cast(pa.int32()), *blobs], ["v_block", "ids", "vectors", "strings", "order"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        strings = hash_strings(unpacked(batch.column(1))).T if len(batch) else []
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.ascontiguousarray(s).tobytes() for s in strings], pa.binary())], [*batch.schema.names, "strings"])


def _highest(vectors: np.ndarray, largest: float, at: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k highest products. Equal vectors get equal scores: each is a sum in a fixed order, and the faster
    product only sorts out vectors that are clearly below. largest: of the vectors' components."""
    with np.errstate(over="ignore", invalid="ignore"):
        if len(at) > k:
            rough = np.nan_to_num(vectors[at] @ query, nan=-np.inf)
            slack = 1e-12 * np.sqrt((query * query).sum()) * largest * len(query)
            least = np.partition(rough, -k)[-k] - slack
            at = at[~(rough < least)]
        scores = (vectors[at] * query).sum(axis=1)
    order = np.lexsort((ids[at], -np.nan_to_num(scores, nan=-np.inf)))[:k]
    return at[order], scores[order]


def _searched(k: int):
    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]]
        if len(asked) and len(held):
            ids = np.frombuffer(held.column("ids")[0].as_py(), dtype=np.int64)
            vectors = np.frombuffer(held.column("vectors")[0].as_py()).reshape(len(ids), -1)
            strings = np.frombuffer(held.column("strings")[0].as_py(), dtype=np.uint64).reshape(TREES, -1)
            forest = Forest(strings, np.frombuffer(held.column("order")[0].as_py(), dtype=np.int32).reshape(TREES, -1))
            largest = float(np.abs(vectors).max())
            place = {v: row for row, v in enumerate(ids.tolist())}
            names = asked.column("vec_id").to_pylist()
            own = np.array([place.get(q, -1) for q in names])
            queries, wanted = unpacked(asked.column("vector")), np.ascontiguousarray(unpacked(asked.column("strings"), np.uint64).T)
            for q, at in enumerate(forest.candidates(wanted, own, int(SCORED * len(ids)) + SCORED_K * k)):
                rows, scores = _highest(vectors, largest, at, queries[q], ids, k)
                for to, x in zip(out, (np.full(len(rows), names[q]), ids[rows], scores), strict=True):
                    to.append(x)
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    return run


def _usable(vector: np.ndarray) -> np.ndarray | None:
    return vector if vector.any() else None


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k nearest found of each query, by inner product.

    vectors: vec_id long, embedding array of numbers (more columns are ignored). Queries are the rows whose vec_id is divisible by
    `every`, candidates all rows but the query's own. Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the
    smaller vec_id; fewer candidates than k give fewer rows. Vectors that are null, empty or zero or hold a null or non-finite
    component take no part, nor do rows without an id. Shorter vectors count as filled up with zeros. Rows that
    repeat an id are vectors of their own, each a query and a candidate of the others. Equal vectors have equal scores. An empty table gives an empty result.
    Directions are searched: where vectors differ much in length, long ones that point elsewhere are found less often.
    """
    table, renamed = told_apart(cleaned(vectors, _usable))
    longest, shortest, rows = table.agg(F.max(F.octet_length("vector")), F.min(F.octet_length("vector")), F.count(F.lit(1))).first()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if longest != shortest:
        table = stored(filled_up(table, longest // 8))
    dealt, shards = in_blocks(table.drop("of"), "v_block", SHARD_ROWS)
    forests = stored(dealt.groupBy("v_block").applyInArrow(_built, "v_block int, ids binary, vectors binary, strings binary, order binary"))
    asked, q_blocks = in_blocks(table.filter(F.col("of") % every == 0).drop("of"), "q_block", QUERY_ROWS)
    asked = asked.mapInArrow(_hashed, "vec_id long, vector binary, q_block int, strings binary")
    found = best(across(asked, q_blocks, forests, shards, _searched(k), "query_id long, vec_id long, score double"), k)
    return named(found, table) if renamed else found
