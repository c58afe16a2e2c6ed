"""Retrieval of described tables: an index in versions that grows by what is new, searched by word frequencies or a model's vectors.

An index is a folder. `parts` holds described tables, each part written once and never changed; `manifest/version=n` lists which part
describes which table in version n. An update describes only tables whose fingerprint the newest version doesn't have and writes
one part and one manifest; whoever reads an older version goes on reading it until `vacuum` removes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.terms import asked_words, frequencies, scores, word_list

#: Texts as a column in, unit vectors as a column of array<double> out.
Embedder = Callable[[Column], Column]
MANIFEST = "table_name string, fingerprint string, part string"
_loaded: dict[str, Any] = {}


def model_embedder(name: str, load: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> Embedder:
    """An embedder by a model that maps a batch of texts to vectors; each worker process loads it once, under its name."""

    def embedded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tidemark.operators.retrieval import _loaded as models

        if name not in models:
            models[name] = load()
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in models[name](texts.fillna("").tolist())], dtype=object)

    return F.pandas_udf(embedded, "array<double>")


def inner_product(a: Column, b: Column) -> Column:
    """The inner product of two arrays, as a fold. (Written out as a sum of 64 products it takes three times as long over 400000 rows.)"""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(table: DataFrame, vector: str, query: Sequence[float], k: int, tie: str) -> DataFrame:
    """The k rows with the highest inner product with the query, as column score; ties by the column `tie`."""
    score = inner_product(F.col(vector), F.array(*(F.lit(float(x)) for x in query)))
    return table.withColumn("score", score).orderBy(F.col("score").desc(), tie).limit(k)


def _manifests(spark: SparkSession, folder: str) -> DataFrame | None:
    """(table_name, fingerprint, part, version) of all versions, or None if there are none."""
    try:
        return spark.read.schema(f"{MANIFEST}, version long").parquet(f"{folder}/manifest")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


class Index:
    """One version of an index: (table_name, document, words, and embedding if there is a model). It has a row for each table and is cached."""

    def __init__(self, spark: SparkSession, folder: str, version: int, rows: list[tuple[str, str, str]], embed: Embedder | None):
        self.version, self.embed = version, embed
        self.fingerprints = {name: fingerprint for name, fingerprint, _ in rows}
        listed = spark.createDataFrame([(name, part) for name, _, part in rows], "table_name string, part string")
        parts = spark.read.parquet(*sorted({f"{folder}/parts/{part}" for _, _, part in rows}))
        self.table = parts.join(F.broadcast(listed), ["table_name", "part"], "left_semi").drop("part").cache()

    @classmethod
    def newest(cls, spark: SparkSession, folder: str, embed: Embedder | None = None) -> Index | None:
        """The newest version kept in a folder, or None if there is none."""
        kept = _manifests(spark, folder)
        last = kept.agg(F.max("version")).first()[0] if kept is not None else None
        if last is None:
            return None
        rows = kept.filter(F.col("version") == last).select("table_name", "fingerprint", "part").collect()
        return cls(spark, folder, last, [tuple(r) for r in rows], embed)

    @classmethod
    def updated(cls, spark: SparkSession, folder: str, wanted: dict[str, str], describe: Callable[[list[str]], DataFrame], embed: Embedder | None = None) -> Index:
        """The version for the tables and fingerprints that are wanted: the newest, or one made of its parts and one new part.

        describe: (table_name, document) of the tables named; it is asked only for those that the newest version lacks. Of two that
        write the same version at once, one fails and leaves what the other wrote.
        """
        if not wanted:
            raise ValueError("there are no documents to index")
        last = cls.newest(spark, folder, embed)
        if last is not None and last.fingerprints == wanted:
            return last
        known = {} if last is None else {r.table_name: r for r in _manifests(spark, folder).filter(F.col("version") == last.version).collect()}
        same = {name for name in wanted if name in known and known[name].fingerprint == wanted[name]}
        new = sorted(set(wanted) - same)
        part = uuid.uuid4().hex
        if new:
            made = describe(new).select("table_name", "document", word_list(F.col("document")).alias("words"), F.lit(part).alias("part"))
            if embed is not None:
                made = made.withColumn("embedding", embed(F.col("document")))
            made.write.parquet(f"{folder}/parts/{part}")
        rows = [(name, wanted[name], known[name].part if name in same else part) for name in sorted(wanted)]
        version = 0 if last is None else last.version + 1
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest/version={version}")
        if last is not None:
            last.drop()
        return cls(spark, folder, version, rows, embed)

    @staticmethod
    def vacuum(spark: SparkSession, folder: str, keep: int = 2, seconds: int = 3600) -> None:
        """Delete all but the newest `keep` versions and the parts that only they use; parts younger than `seconds` may be of a version being written and stay."""
        kept = _manifests(spark, folder)
        if kept is None:
            return
        versions = sorted(r.version for r in kept.select("version").distinct().collect())
        used = {r.part for r in kept.filter(F.col("version").isin(versions[-keep:])).select("part").distinct().collect()}
        hadoop = spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(folder)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for version in versions[:-keep]:
            files.delete(hadoop.Path(f"{folder}/manifest/version={version}"), True)
        now = spark._jvm.java.lang.System.currentTimeMillis()
        for status in files.listStatus(hadoop.Path(f"{folder}/parts")):
            if status.getPath().getName() not in used and now - status.getModificationTime() >= 1000 * seconds:
                files.delete(status.getPath(), True)

    def drop(self) -> None:
        """Give the cached rows up; the version can still be read."""
        self.table.unpersist()

    def search(self, text: str, k: int = 5) -> DataFrame:
        """(table_name, document, score) of the k documents nearest to a text, best first; ties by name."""
        spark = self.table.sparkSession
        if self.embed is not None:
            asked = list(spark.range(1).select(self.embed(F.lit(text)).alias("v")).first().v)
            return top_k(self.table, "embedding", asked, k, "table_name").select("table_name", "document", "score")
        counts = self.table.select(F.col("table_name").alias("id"), F.explode("words").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
        found = scores(counts, frequencies(self.table), len(self.fingerprints), asked_words(spark, text)).withColumnRenamed("id", "table_name")
        scored = self.table.join(found, "table_name", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return scored.orderBy(F.col("score").desc(), "table_name").limit(k).select("table_name", "document", "score")


def retrieved(hits: Sequence) -> dict:
    """Tables (each once, best first), their scores and the joined documents of search results."""
    best: dict[str, tuple[float, str]] = {}
    for hit in hits:
        best.setdefault(hit.table_name, (hit.score, hit.document))
    return {
        "retrieved_tables": list(best),
        "schema_context": "\n---\n".join(document for _, document in best.values()),
        "num_results": len(best),
        "similarity_scores": {name: round(score, 4) for name, (score, _) in best.items()},
    }
