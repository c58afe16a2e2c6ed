"""Joins of intervals that overlap, as equi-joins on cells; no nested loop, and no key holds more than a bounded share of the rows.
Totals over what overlaps need no pairs: `span_totals` and `met_others`.

An interval of length n lies on the level whose cells are the next power of two wide, so it meets at most two cells there,
and at most two on every level above. Each side goes into the cells of its own level and of the levels above that the other
side has. Two intervals that overlap meet on the higher of their levels, and are reported in the cell in which the later of
them starts. Cells with very many rows are split: one side is dealt to slots by its hash, the other copied into each slot.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of the dealt side in one slot of a cell, about.
SLOT_ROWS = 100_000
#: Cells of about as many instants each, in which running totals are taken.
CELLS = 2000


def _long(value: Column, kind: str) -> Column:
    """Instants as whole microseconds, dates as days, whole numbers as they are."""
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(value.cast("timestamp"))
    return F.unix_date(value) if kind == "date" else value.cast("long")


def _sided(df: DataFrame, bounds: tuple[Column, Column | None], side: str) -> DataFrame:
    """The rows of one side as a struct, with start and end; without those that no interval can meet."""
    start, end = bounds
    kinds = dict(df.select(start.alias("s"), (end if end is not None else start).alias("e")).dtypes)
    lo = _long(start, kinds["s"])
    hi = _long(end, kinds["e"]) if end is not None else lo + 1  # a point
    return df.select(F.struct("*").alias(side), lo.alias(f"{side}_start"), hi.alias(f"{side}_end")).filter(f"{side}_start < {side}_end")


def _level(side: str) -> Column:
    """The number of binary digits of an interval's length: its cells are at least as wide as it is long."""
    return F.length(F.bin(F.col(f"{side}_end") - F.col(f"{side}_start")))


def _cells(df: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """df once for each cell that it meets, on its own level and those of `levels` above."""
    wide = F.filter(F.array(*map(F.lit, levels)), lambda n: n >= F.col(f"{side}_level"))
    out = df.withColumn("level", F.explode(wide))
    first, last = F.call_function("shiftright", f"{side}_start", "level"), F.call_function("shiftright", F.col(f"{side}_end") - 1, "level")
    return out.withColumn("cell", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, left_bounds: tuple[Column, Column | None], right_bounds: tuple[Column, Column | None], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """All pairs of rows whose half-open intervals [start, end) overlap, each once, as structs `left` and `right`.

    Bounds are instants, dates or whole numbers, of the same kind on both sides; a missing end makes a point of the start. Rows
    whose start or end is null, or whose end isn't behind the start, meet nothing. Equal rows are rows of their own.
    """
    one, other = _sided(left, left_bounds, "left"), _sided(right, right_bounds, "right")
    one, other = one.withColumn("left_level", _level("left")), other.withColumn("right_level", _level("right"))
    levels = sorted({r[0] for r in one.select("left_level").union(other.select("right_level")).distinct().collect()})  # 64 at most
    if not levels:
        return one.select("left").join(other.select("right"), F.lit(False))
    own = {side: [r[0] for r in df.select(f"{side}_level").distinct().collect()] for side, df in (("left", one), ("right", other))}
    one, other = _cells(one, "left", levels), _cells(other, "right", levels)
    # On each level at least one of a pair is at home, so a side needs the other's levels and its own.
    one = one.filter(F.col("level").isin(own["right"]) | (F.col("level") == F.col("left_level")))
    other = other.filter(F.col("level").isin(own["left"]) | (F.col("level") == F.col("right_level")))

    crowds = one.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slot_rows)
    slots = crowds.select("level", "cell", F.ceil(F.col("n") / slot_rows).cast("int").alias("slots"))
    dealt = one.join(slots, ["level", "cell"], "left").withColumn("slot", F.pmod(F.xxhash64("left_start", "left_end", "left"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
    copied = other.join(slots, ["level", "cell"], "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    met = dealt.join(copied, ["level", "cell", "slot"])
    later = F.greatest("left_start", "right_start")
    once = (F.col("level") == F.greatest("left_level", "right_level")) & (F.call_function("shiftright", later, F.col("level")) == F.col("cell"))
    overlap = (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))
    return met.filter(once & overlap).select("left", "right")


def span_totals(points: DataFrame, at: Column, by: list[str], sums: dict[str, Column], spans: DataFrame, bounds: tuple[Column, Column], keys: list[str]) -> DataFrame:
    """For each value of the spans' `keys` and the points' `by`: how many points (n) lie within spans [start, end), and sums over them.

    Pairs without a point are left out; a sum of nulls is null. sums are of whole numbers or decimals, so differences are exact.
    No pair of a point and a span is made: totals up to the end less totals up to the start, from running totals within cells
    of as many instants each and the totals of the cells before. Rows: those of the points, and instants times values of `by`.
    """
    kinds = dict(spans.select(bounds[0].alias("s"), bounds[1].alias("e")).dtypes) | dict(points.select(at.alias("at")).dtypes)
    totals = {"n": F.count(F.lit(1))} | {f"sum{k}": F.sum(f"v{k}") for k in range(len(sums))} | {f"count{k}": F.count(f"v{k}") for k in range(len(sums))}
    valued = points.select(_long(at, kinds["at"]).alias("at"), F.struct(*by).alias("by"), *(x.alias(f"v{k}") for k, x in enumerate(sums.values()))).filter("at is not null")
    weights = valued.groupBy("at", "by").agg(*(x.alias(n) for n, x in totals.items()))
    ends = spans.select(F.struct(*keys).alias("key"), _long(bounds[0], kinds["s"]).alias("s"), _long(bounds[1], kinds["e"]).alias("e")).filter("s < e")
    marks = ends.select("key", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(False).alias("up")), F.struct(F.col("e").alias("at"), F.lit(True).alias("up")))).alias("x")).select("key", "x.*")
    instants, kinds_of = marks.select("at").distinct(), weights.select("by").distinct()

    # Any cuts give the same totals; these make the cells about equal.
    cuts = weights.select("at").union(instants).agg(F.percentile_approx("at", [k / CELLS for k in range(1, CELLS)], 10 * CELLS)).first()[0]
    splits = [-float("inf"), *sorted({float(x) for x in cuts or [0]}), float("inf")]
    in_cells = lambda df: Bucketizer(splits=splits, inputCol="place", outputCol="cell").transform(df.withColumn("place", F.col("at").cast("double"))).drop("place")
    weights = in_cells(weights)
    asked = in_cells(instants).crossJoin(F.broadcast(kinds_of))
    line = Window.partitionBy("cell", "by").orderBy("at", "weighs").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # an instant's own points are behind it
    both = weights.withColumn("weighs", F.lit(True)).unionByName(asked.withColumn("weighs", F.lit(False)), allowMissingColumns=True)
    within = both.select("cell", "by", "at", "weighs", *(F.sum(n).over(line).alias(n) for n in totals)).filter("not weighs").drop("weighs")
    before = Window.partitionBy("by").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    grid = points.sparkSession.range(len(splits) - 1).select(F.col("id").cast("double").alias("cell")).crossJoin(F.broadcast(kinds_of))
    in_cell = grid.join(weights.groupBy("cell", "by").agg(*(F.sum(n).alias(n) for n in totals)), ["cell", "by"], "left")
    starts = in_cell.select("cell", "by", *(F.sum(n).over(before).alias(f"{n}_before") for n in totals))
    zero = F.lit(0)
    upto = within.join(F.broadcast(starts), ["cell", "by"]).select("at", "by", *((F.coalesce(n, zero) + F.coalesce(f"{n}_before", zero)).alias(n) for n in totals))
    differences = marks.join(upto, "at").groupBy("key", "by").agg(*(F.sum(F.when(F.col("up"), F.col(n)).otherwise(-F.col(n))).alias(n) for n in totals)).filter("n > 0")
    return differences.select("key.*", "by.*", "n", *(F.when(F.col(f"count{k}") > 0, F.col(f"sum{k}")).alias(name) for k, name in enumerate(sums)))


def met_others(df: DataFrame, key: str, bounds: tuple[Column, Column]) -> DataFrame:
    """(key, others, first): for each key, how many rows of other keys its intervals [start, end) overlap, and the least of those keys.

    Keys that meet no other are left out. Only distinct intervals are joined, each with the number and the two least keys of its
    rows, so the pairs grow with the different intervals and not with the rows; a key's own intervals meet in one row.
    """
    kinds = dict(df.select(bounds[0].alias("s"), bounds[1].alias("e")).dtypes)
    own = df.select(F.col(key).alias("k"), _long(bounds[0], kinds["s"]).cast("long").alias("s"), _long(bounds[1], kinds["e"]).cast("long").alias("e")).filter("s < e and k is not null").groupBy("k", "s", "e").agg(F.count(F.lit(1)).alias("m"))
    least = own.withColumn("rank", F.row_number().over(Window.partitionBy("s", "e").orderBy("k"))).filter("rank <= 2").groupBy("s", "e").agg(F.collect_list("k").alias("least"))
    spans = own.groupBy("s", "e").agg(F.sum("m").alias("n")).join(least, ["s", "e"])
    ends = (F.col("s"), F.col("e"))
    met = overlap_join(spans, spans, ends, ends).groupBy("left.s", "left.e")
    around = met.agg(F.sum("right.n").alias("met"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("right.least")))), 1, 2).alias("least"))
    other = F.when(F.col("least")[0] != F.col("k"), F.col("least")[0]).otherwise(F.get("least", F.lit(1)))
    counted = own.join(around, ["s", "e"]).groupBy("k").agg(F.sum(F.col("m") * F.col("met")).alias("met"), F.min(other).alias("first"), F.collect_list(F.struct("s", "e", "m")).alias("mine"))
    both = lambda a, b: F.when((a["s"] < b["e"]) & (b["s"] < a["e"]), a["m"] * b["m"]).otherwise(F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    same = F.aggregate("mine", zero, lambda n, a: n + F.aggregate("mine", zero, lambda m, b: m + both(a, b)))
    return counted.select(F.col("k").alias(key), (F.col("met") - same).alias("others"), "first").filter("others > 0")
