"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's expected number of copies grows with the number of binary digits of its size, as longer documents bear more
repetition: it is those digits times its source's level, `most` at most, and levels are such that the expected words of a source
are its target. The whole part is certain; the fraction p is an inclusion probability, unequal within a source and between
sources. Each document draws u and is ranked by the odds of u over the odds of p; a source takes its documents in that
order until the words left of its target are used up, and then the one document outside whose size fits the gap best. No
source is sorted as a whole: histograms of the words by rank find where the target falls, and only the documents of that narrow
step are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order, numbered, stored, word_count

WEIGHTS = (5, 2, 1)
#: The mix has 3 / 2 of all words; no document is taken more than twice.
SHARE = (3, 2)
MOST_COPIES = 2
#: Ranks are integers of 48 bits; each of three histograms resolves 8 of them.
RANK_BITS, STEP_BITS, STEPS = 48, 8, 3


def uniform(*parts: Column) -> Column:
    """A number within (0, 1) that depends on the parts alone: 52 bits of their MD5."""
    digest = F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """Targets from (source, source_size): shares by weight, filled up to `most` times a source's size."""
    number = (F.col("__number") % len(weights) + 1).cast("int")
    named = in_order(sources, [F.col("source").asc_nulls_last()], []).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), number))
    weighted = named.select("source", "source_size", "weight")
    filled = in_order(weighted, [F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()], ["source_size", "weight"])
    num, den = share
    words, weight = (x or 0 for x in weighted.agg(F.sum("source_size"), F.sum("weight")).first())
    # What is left for this source and those after it, if all before it are full, times den.
    left = num * words - den * most * F.col("__source_size")
    rest = weight - F.col("__weight")
    fits = left * F.col("weight") <= den * most * F.col("source_size") * rest
    # Of those that fit, the first has the highest level.
    level = filled.agg(F.max(F.when(fits, left.cast("double") / (den * rest).cast("double")))).first()[0]
    target = F.least((most * F.col("source_size")).cast("double"), F.lit(level).cast("double") * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def digits(size: Column) -> Column:
    """The binary digits of a size and one: what a document's expected copies are in proportion to."""
    return F.length(F.bin(size + 1)).cast("long")


def expected_copies(most: int) -> Column:
    """Of a document with `digits`, in a source with source_size, target and level."""
    full = F.col("target") >= (most * F.col("source_size")).cast("double")
    risen = F.least(F.lit(float(most)), F.col("level") * F.col("digits"))
    return F.when(F.col("source_size") == 0, 0.0).when(full, float(most)).otherwise(risen)


def source_levels(classes: DataFrame, targets: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target, level, rest) from (source, digits, words) and targets; rest: words that certain copies leave."""
    table = classes.withColumnRenamed("source", "source_")
    joined = table.join(targets, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").filter("words > 0")
    # Classes with more digits are full first; of the levels that overfill no class, the highest is right.
    along = Window.partitionBy("source").orderBy(F.col("digits").desc())
    before = F.coalesce(F.sum("words").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum(F.col("words") * F.col("digits")).over(along.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("target") - (most * before).cast("double")) / weight.cast("double")
    risen = joined.withColumn("at", level)
    levels = risen.withColumn("level", F.max(F.when(F.col("at") * F.col("digits") <= most, F.col("at"))).over(Window.partitionBy("source")))
    certain = F.sum(F.floor(expected_copies(most)) * F.col("words"))
    return levels.groupBy("source", "source_size", "target", "level").agg((F.col("target") - certain.cast("double")).alias("rest"))


def _drawn(rows: DataFrame, seed: int) -> DataFrame:
    """rows with u and a number `again` that tells apart rows of one doc_id, source and text; rows that share a doc_id draw each on its own."""
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    alone = lambda df: df.withColumn("again", F.lit(0).cast("long")).withColumn("u", uniform(F.lit(seed), F.col("doc_id")))
    repeated = stored(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("doc_id_")))
    if repeated.isEmpty():
        return alone(rows).drop("row")
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_"))
    many = numbered(rows.join(repeated, same, "left_semi"), ["doc_id", "source", "text_hash"], ["row"], "again")
    many = many.withColumn("u", uniform(F.lit(seed), F.col("doc_id"), F.col("text_hash"), F.col("again")))
    return alone(rows.join(repeated, same, "left_anti")).unionByName(many).drop("row")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST_COPIES, seed: int = 0, more: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes each document.

    docs: doc_id, text, source (more columns are ignored, but for those named in `more`, which come out as they are). Sources in
    code-point order, null last, have `weights` in turn. Returns per row: doc_id, size (words), source, source_size, target (of
    its source), copies, taken (size times copies). A null source is a source. Null, empty and wordless texts have size 0 and come
    in whole copies as others do; a very long text is one document and the cut is as coarse as half of it. A source without
    words has target 0 and no copies. Rows that repeat a doc_id, or have none, are documents of their own and draw each on its
    own; the draws depend on the rows alone, not on their order. An empty table gives an empty result.
    """
    size = word_count(F.col("text").cast("string"))
    sized = stored(_drawn(docs.select("doc_id", "source", *more, size.alias("size"), F.xxhash64(F.col("text")).alias("text_hash")), seed))
    sized = sized.withColumn("digits", digits(F.col("size")))
    classes = stored(sized.groupBy("source", "digits").agg(F.sum("size").alias("words")))
    sources = stored(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    targets = stored(source_targets(sources, weights, share, most))

    def by_source(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
        table = table.withColumnRenamed("source", "source_")
        return rows.join(table, F.col("source").eqNullSafe(F.col("source_")), how).drop("source_")

    levels = source_levels(classes, targets, most).select("source", "level", "rest")
    # Sources without words have no level.
    targets = stored(by_source(targets, levels, "left"))
    copied = by_source(sized, targets).withColumn("whole", F.floor(expected_copies(most)))
    copied = copied.withColumn("p", expected_copies(most) - F.col("whole").cast("double"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.floor(odds / (1 + odds) * float(1 << RANK_BITS)).cast("long")
    ranked = stored(copied.withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), rank)))
    drawn = ranked.filter("rank is not null")

    def step(rows: DataFrame, shift: int) -> DataFrame:
        """Of each source: the step of ranks in which its words pass what is left, and what is left before that step."""
        digit = F.shiftright("rank", shift)
        words = rows.groupBy("source", "rest", digit.alias("step")).agg(F.sum("size").alias("words"))
        along = Window.partitionBy("source").orderBy("step")
        passed = words.withColumn("sum", F.sum("words").over(along)).filter("sum > rest")
        found = passed.groupBy("source").agg(F.min_by(F.struct("step", (F.col("rest") - F.col("sum") + F.col("words")).alias("rest")), "step").alias("at"))
        return stored(found.select("source", "at.step", "at.rest"))

    narrow = drawn
    for turn in range(1, STEPS + 1):
        shift = RANK_BITS - turn * STEP_BITS
        edge = step(narrow, shift)
        narrow = by_source(narrow.drop("rest"), edge).filter(F.shiftright("rank", shift) == F.col("step")).drop("step")
    line = ["rank", "doc_id", "text_hash", "again"]  # no two rows of a source are equal in it
    order = Window.partitionBy("source").orderBy(*line).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(*line)
    counted = narrow.withColumn("sum", F.sum("size").over(order))
    cuts = counted.groupBy("source").agg(
        F.min(F.when(F.col("sum") > F.col("rest"), place)).alias("cut"),
        (F.first("rest") - F.coalesce(F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum"))), F.lit(0))).alias("gap"),
    )
    cuts = stored(cuts)
    beyond = by_source(drawn, cuts).filter(place >= F.col("cut"))
    miss = F.abs(F.col("gap") - F.col("size"))
    closing = beyond.filter(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), *line)).alias("closing"))
    ends = stored(by_source(cuts, closing, "left"))
    # A source without a cut has room for all that it draws.
    before_cut = F.when(F.col("rank").isNull(), 0).when(F.col("cut").isNull() | (place < F.col("cut")), 1).otherwise(0)
    closes = F.coalesce((F.col("closing").isNotNull() & F.col("rank").isNotNull() & (place == F.struct(*(F.col(f"closing.{c}") for c in line)))).cast("long"), F.lit(0))
    copies = (F.col("whole") + before_cut + closes).cast("long")
    out = by_source(ranked, ends, "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *more)
