"""From raw documents to training sequences: drop toxic documents, keep one of each group of near copies, mix the sources
to target weights, pack what is left. Each stage is written as a Parquet table in the shared folder and read again.

Stages decide on rows, not on ids: rows without a doc_id and rows that share one are documents of their own. Null, empty and
very long texts pass through every stage as its operator defines; columns beside doc_id, text and source are carried along,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import drop_stored, in_order, stored, stored_so_far
from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack, sequences
from tidemark.llm.queries import fold, tokenizer_file
from tidemark.llm.toxicity import toxicity

#: Rows up to this many are broadcast (8 bytes each) to drop their documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells all rows apart, and its name: the doc_id, where every row has one of its own; else the rows'
    places in the order of ids, those without one last. The smallest id of a group stays the smallest."""
    key = "row__"
    while key in docs.columns:
        key += "_"
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    placed = in_order(docs, [F.col("doc_id").asc_nulls_last()], [])
    return stored(placed.withColumnRenamed("__number", key)), key


def _without(docs: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    rows = stored(rows.select(key))
    return docs.join(F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, key, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject, learning from the labels of the table's folder."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, key = _keyed(docs)
    found = toxicity(rows, labels, held_out=fold(4) == 2, more=(key,))
    return _without(rows, key, found.filter("predicted = 1")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of rows that share or lack one any row."""
    rows, key = _keyed(docs)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    return _without(rows, key, found.filter("not kept").withColumnRenamed("doc_id", key)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    rows, key = _keyed(docs)
    copies = mix(rows, more=(key,)).filter("copies > 0").select(key, F.col("copies").cast("int").alias("copies__"))
    taken = rows.select(key, F.struct(*docs.columns).alias("kept__")).join(copies, key)
    return taken.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__")))).select("kept__.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return pack(docs, tokenizer_file())


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Scores, signatures and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the stages before packing leave."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, kept(spark, sf_dir), sf_dir)


def write_sequences(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The token ids of every training sequence (sequence_id, ids) as a Parquet table. What the stages have stored on the way goes."""
    since = stored_so_far()
    sequences(pack(kept(spark, sf_dir), tokenizer_file(), with_ids=True)).write.parquet(path)
    drop_stored(spark, since)
