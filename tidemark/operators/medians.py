"""Exact medians of groups of any size: sketches bracket the middle, counts place it, and only what lies in the bracket is put in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A sketch's error in rank is a group's rows over ACCURACY; the bracket reaches twice that to both sides of the middle.
ACCURACY = 50_000


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median) as doubles; the mean of the two middle values where their number is even.

    The task that orders a group's bracket gets about one in ACCURACY / 6 of its rows, equal values as one; where a sketch has missed
    the middle, which the counts tell, it gets the group's distinct values. Nulls of the value count for nothing (a group of
    nulls has no row), a null group is a group, NaN is above all numbers. An empty table gives no rows.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    reach = 2.0 / ACCURACY
    around = F.percentile_approx("v", [0.5 - reach, 0.5 + reach], ACCURACY)
    sketched = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), around.alias("around"))
    sketched = sketched.select(F.col("g").alias("h"), "n", F.col("around")[0].alias("low"), F.col("around")[1].alias("high"))
    # Values by distinct value: counted in every task before they are exchanged.
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("times"))
    placed = counted.join(sketched, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    under, within = F.col("v") < F.col("low"), F.col("v").between(F.col("low"), F.col("high"))
    counts = placed.groupBy("g", "n").agg(F.sum(F.when(under, F.col("times")).otherwise(0)).alias("below"), F.sum(F.when(within, F.col("times")).otherwise(0)).alias("inside"))
    first, last = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    held = (F.col("below") < first) & (F.col("below") + F.col("inside") >= last)
    edges = counts.select(F.col("g").alias("h"), held.alias("held"), F.when(held, F.col("below")).otherwise(0).alias("before"))
    middle = placed.join(edges, F.col("g").eqNullSafe(F.col("h"))).filter(within | ~F.col("held"))
    upto = F.col("before") + F.sum("times").over(Window.partitionBy("g").orderBy("v"))
    holds = lambda at: (F.col("upto") >= at) & (F.col("upto") - F.col("times") < at)
    found = middle.withColumn("upto", upto).filter(holds(first) | holds(last))
    return found.groupBy(F.col("g").alias(group)).agg(((F.min("v") + F.max("v")) / 2).alias("median"))
