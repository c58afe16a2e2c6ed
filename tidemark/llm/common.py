"""Helpers shared by the corpus operators: durable tables, block-wise word hashing, gapless numbering."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that end a word: space and \x09 to \x0D.
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[0x20, 9, 10, 11, 12, 13]] = True
#: The same class as a Java regular expression for words.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are hashed in blocks of about this many bytes, whatever the size of an Arrow batch.
BLOCK_BYTES = 1 << 20

#: Makes Spark delete an execution's shuffle files when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_MASK = (1 << 64) - 1


#: What this process has written to the shared folder.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set, a local master gets a fresh one; a
    cluster raises ValueError, since each machine would write to its own disk."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored_so_far() -> int:
    """A mark for drop_stored: how many tables and archives this process has written by now."""
    return len(_written)


def drop_stored(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables and archives that this process has written to the shared folder (since a mark). Results that still read them are lost."""
    files = spark._jvm.org.apache.hadoop.fs
    while len(_written) > since:
        path = files.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again; cuts the lineage and survives lost executors.

    The shuffle files of the write go when it ends: nothing reads them again, and left to the garbage collector those of many
    tables add up.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # A DataFrame keeps the setting that it was made under, so the one that is written is made here.
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C55 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = splitmix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step & _MASK
    return out


_tables: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = _powers(base, max(n, BLOCK_BYTES + (1 << 18)))
    return _tables[name][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: differences of one running polynomial sum, brought to a common origin."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _table("up", _BASE, len(data)), out=total[1:])
    hashes = (total[end] - total[start]) * _table("down", _INVERSE, len(data))[start]
    return splitmix(hashes ^ ((end - start).astype(np.uint64) << np.uint64(48)))


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts.

    data: the bytes of all texts; bounds: where each text begins, and the end. Returns the hash, start and end of each
    word and, for each text, the index of its first word (with the total behind them).
    """
    n = len(data)
    if not n:
        nothing = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint64), nothing, nothing, np.zeros(len(bounds), dtype=np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~BREAKS[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return span_hashes(data, start, end), start, end, np.searchsorted(start, bounds)


def text_blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of texts of about `limit` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what is no longer used, of those before and of earlier tasks, goes back to the system, as Python workers outlive
    their tasks."""
    give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()


def give_back() -> None:
    """Memory that Arrow and the C library keep for later goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, rows_a_cell: int = 200_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps; no task takes a whole group.

    Rows fall into cells by the hash of the order columns, are numbered within (group, cell), and a table with one row
    per (group, cell) gives the number at which each cell begins. df must give the same rows when it is read again.
    """
    cells = max(8, -(-df.count() // rows_a_cell))
    cell, within = f"{name}__cell", f"{name}__within"
    dealt = df.withColumn(cell, F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    counts = dealt.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"__{g}") for g in group], F.col(cell).alias("__cell"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inner = Window.partitionBy(*group, cell).orderBy(*order)
    ranked = dealt.withColumn(within, F.row_number().over(inner) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] + [F.col(cell) == F.col("__cell")]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    out = ranked.join(starts, condition).withColumn(name, (F.col("__start") + F.col(within)).cast("long"))
    return out.drop(cell, within, "__cell", "__start", *[f"__{g}" for g in group])


def in_order(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """df with __number (from 0, in that order) and, for each column c of sums, __c: its sum over the rows before.

    The rows are sorted over many tasks; only the totals of each task's rows meet in one.
    """
    placed = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    names = {"__number": F.count(F.lit(1)), **{f"__{c}": F.sum(c) for c in sums}}
    up = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task of the sort
    totals = placed.groupBy("__part").agg(*(x.alias(n) for n, x in names.items()))
    starts = totals.select(F.col("__part").alias("__of"), *(F.coalesce(F.sum(n).over(up), F.lit(0)).alias(f"{n}__start") for n in names))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *(F.coalesce(x.over(within), F.lit(0)).alias(f"{n}__in") for n, x in names.items())).join(F.broadcast(starts), F.col("__part") == F.col("__of"))
    return out.select(*df.columns, *((F.col(f"{n}__start") + F.col(f"{n}__in")).alias(n) for n in names))


def connected(edges: DataFrame, tables: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """Connected components of the edges (a, b) by large-star and small-star rounds (Kiveris et al., 2014).

    Returns (node, root) for every node that isn't the smallest of its component. Each round is a grouped minimum with
    map-side combine and a join that adaptive execution can split, so a hub with many neighbours needs no single task.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    pairs, seen = tables(pairs), None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        # One row of each u has v = m and gives (u, m). Pairs that come out twice meet in the next round's distinct(); stars have none.
        small = large.join(lower, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        pairs = tables(small)


def reconnected(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The (node, root) of connected() after more edges (a, b): only the components that those edges touch are joined anew."""
    at = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    lifted = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    above = connected(lifted.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(above)
