"""Window frames that Spark's windows lack: GROUPS frames, and EXCLUDE.

Rows that are equal in the order are peers. A table with one row for each group of peers is aggregated first, so a frame over
groups is a plain frame over that table's rows, and far fewer rows are sorted where peers are many. The frame's values go
back to the rows by a join on the order. What EXCLUDE takes out is taken from the peers' own aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXCLUDED = ("current row", "group", "ties", "no others")


def _between(start: int | None, end: int | None) -> tuple[int, int]:
    return Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end


def grouped_frames(df: DataFrame, partition: list[str], order: list[str], value: str, start: int | None, end: int | None, exclude: str = "no others") -> DataFrame:
    """df with sum, count, least and greatest of `value` over GROUPS BETWEEN start AND end in columns frame_sum, frame_count, frame_min and frame_max.

    start and end count groups of peers from the row's own (negative: before; None: unbounded). order: ascending, nulls first, as
    Spark and SQLite have it; nulls of the order are peers, and so are those of the partition. exclude: the row itself, its peers,
    or its peers but not itself. As in SQL, nulls of `value` count for nothing, an empty frame has count 0 and null elsewhere. The
    value should be exact (whole or decimal), since sums less the excluded values are taken.
    """
    if exclude not in EXCLUDED:
        raise ValueError(f"exclude is one of {', '.join(EXCLUDED)}")
    if start is not None and end is not None and start > end:
        raise ValueError("the frame ends before it starts")
    keys = [*partition, *order]
    peers = df.groupBy(*keys).agg(F.sum(value).alias("p_sum"), F.count(value).alias("p_count"), F.min(value).alias("p_min"), F.max(value).alias("p_max"))
    line = Window.partitionBy(*partition).orderBy(*order)
    holds_own = (start is None or start <= 0) and (end is None or end >= 0)
    parts = [(start, end)]
    if holds_own and exclude != "no others":  # the groups before and behind, without the own one
        parts = [p for p in ((start, -1) if start is None or start <= -1 else None, (1, end) if end is None or end >= 1 else None) if p is not None]
    back = Window.partitionBy(*partition).orderBy(*(F.col(f"`{c}`").desc() for c in order))

    def over(f: Callable, name: str, p: tuple[int | None, int | None]) -> Column:
        # A frame that only has a start grows along the reversed order; as it stands, Spark would sum it anew for each row.
        grows = p[1] is None and p[0] is not None
        return f(name).over(back.rowsBetween(Window.unboundedPreceding, -p[0]) if grows else line.rowsBetween(*_between(*p)))

    summed = lambda columns, f: reduce(f, columns) if columns else F.lit(None)
    both = lambda a, b: F.coalesce(a + b, a, b)
    kind = dict(peers.dtypes)
    values = {
        "frame_sum": summed([over(F.sum, "p_sum", p) for p in parts], both).cast(kind["p_sum"]),
        "frame_count": summed([F.coalesce(over(F.sum, "p_count", p), F.lit(0)) for p in parts], lambda a, b: a + b).cast("long"),
        "frame_min": summed([over(F.min, "p_min", p) for p in parts], F.least).cast(kind["p_min"]),
        "frame_max": summed([over(F.max, "p_max", p) for p in parts], F.greatest).cast(kind["p_max"]),
    }
    framed = peers.select(*(F.col(f"`{k}`").alias(f"k_{n}") for n, k in enumerate(keys)), "p_sum", "p_count", *(c.alias(n) for n, c in values.items()))
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"k_{n}")) for n, k in enumerate(keys)))
    out = df.join(framed, same)
    own = F.col(f"`{value}`")
    if holds_own and exclude == "ties":  # the groups around, and the row itself
        out = out.withColumn("frame_sum", both(F.col("frame_sum"), own).cast(kind["p_sum"])).withColumn("frame_count", F.coalesce("frame_count", F.lit(0)) + own.isNotNull().cast("long"))
        out = out.withColumn("frame_min", F.least("frame_min", own)).withColumn("frame_max", F.greatest("frame_max", own))
    elif holds_own and exclude == "current row":  # the groups around, and the peers but the row itself
        rest = F.when(F.col("p_count") - own.isNotNull().cast("long") > 0, F.col("p_sum") - F.coalesce(own, F.lit(0)))
        out = out.withColumn("frame_sum", both(F.col("frame_sum"), rest).cast(kind["p_sum"])).withColumn("frame_count", F.coalesce("frame_count", F.lit(0)) + F.col("p_count") - own.isNotNull().cast("long"))
        out = _but_own(df, out, keys, value)
    out = out.withColumn("frame_count", F.coalesce("frame_count", F.lit(0)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *values)


def _but_own(df: DataFrame, out: DataFrame, keys: list[str], value: str) -> DataFrame:
    """out with its frame_min and frame_max over the peers as well, each row's own value left out once."""
    counted = df.filter(F.col(f"`{value}`").isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    two = lambda f: f(F.struct(F.col(f"`{value}`").alias("v"), F.col("n").alias("n")))
    ends = counted.groupBy(*keys).agg(two(F.min).alias("low"), two(F.max).alias("high"))
    names = [F.col(f"`{k}`").alias(f"e_{n}") for n, k in enumerate(keys)]
    at = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"e_{n}")) for n, k in enumerate(keys)))
    inner = counted.join(ends.select(*names, "low", "high"), at)
    next_low, next_high = F.min(F.when(F.col(f"`{value}`") > F.col("low.v"), F.col(f"`{value}`"))), F.max(F.when(F.col(f"`{value}`") < F.col("high.v"), F.col(f"`{value}`")))
    edges = inner.groupBy(*(f"e_{n}" for n in range(len(keys)))).agg(F.first("low").alias("low"), F.first("high").alias("high"), next_low.alias("low2"), next_high.alias("high2"))
    met = out.join(edges, at, "left")
    own = F.col(f"`{value}`")
    alone = lambda end: own.eqNullSafe(F.col(f"{end}.v")) & (F.col(f"{end}.n") == 1)
    low, high = F.when(alone("low"), F.col("low2")).otherwise(F.col("low.v")), F.when(alone("high"), F.col("high2")).otherwise(F.col("high.v"))
    return met.withColumn("frame_min", F.least("frame_min", low)).withColumn("frame_max", F.greatest("frame_max", high))
