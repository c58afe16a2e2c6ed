"""Texts scored against a query by the frequencies of their words: term counts times inverse document frequency, as a cosine."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII characters but digits and lower-case letters separate words.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Scores are compared after rounding, so that texts of the same words tie whatever order their sums were made in.
DIGITS = 9


def word_list(text: Column) -> Column:
    """The words of a text in their order, without a plural s; words of one letter are left out. A null text has none."""
    words = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATOR)
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "s$", "")), lambda w: F.length(w) > 1)


def asked_words(spark: SparkSession, query: str) -> dict[str, int]:
    """How often each word is in a query; a query is as short as a question."""
    return dict(Counter(spark.range(1).select(word_list(F.lit(query)).alias("words")).first().words))


def frequencies(words: DataFrame) -> DataFrame:
    """(word, texts): in how many rows of (words) each word is. One row a word leaves each task."""
    return words.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("texts"))


def scores(counts: DataFrame, frequency: DataFrame, total: int, asked: dict[str, int]) -> DataFrame:
    """(id, score) of all ids in counts (id, word, n), given (word, texts) over `total` texts; 0 where no asked word is."""
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.col("texts"))) + 1
    query = counts.sparkSession.createDataFrame(list(asked.items()), "word string, times long")
    known = frequency.withColumn("idf", idf).join(F.broadcast(query), "word", "left").withColumn("asked", F.coalesce("times", F.lit(0)) * F.col("idf"))
    length = known.filter("times is not null").agg(F.coalesce(F.sqrt(F.sum(F.col("asked") * F.col("asked"))), F.lit(0.0)).alias("length"))
    weighted = counts.join(known, "word").withColumn("own", F.col("n") * F.col("idf"))
    summed = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("own") * F.col("own"))).alias("norm"), F.sum(F.col("own") * F.col("asked")).alias("product"))
    scored = summed.crossJoin(F.broadcast(length))  # one row
    return scored.select("id", F.when(F.col("product") > 0, F.round(F.col("product") / (F.col("norm") * F.col("length")), DIGITS)).otherwise(0.0).alias("score"))


def search_texts(texts: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """(id, score): the k texts most like a query among those that share a word with it; ties by id.

    Frequencies are over all texts, null and empty ones included; only texts with an asked word are counted word by word. Rows that
    share a key are one text in the scores; rows without one are left out of the result. No texts, or no known word: no rows.
    """
    rows = texts.select(F.col(key).alias("id"), word_list(F.col(text)).alias("words"))
    asked = asked_words(texts.sparkSession, query)
    if not asked:
        return rows.select("id", F.lit(0.0).alias("score")).limit(0)
    met = rows.filter(F.col("id").isNotNull() & F.arrays_overlap("words", F.array(*map(F.lit, asked))))
    counts = met.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    return scores(counts, frequencies(rows), texts.count(), asked).orderBy(F.col("score").desc(), "id").limit(k)
