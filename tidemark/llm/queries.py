"""The registered query of each corpus operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hash_forest import nearest
from .importance import resampled
from .lm_scoring import lm_scores
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import pack
from .periodic_runs import periodic_runs
from .pii import personal_data
from .sharding import shard
from .toxicity import toxicity
from .url_filter import host_of, judge
from .va_file import exact_top_k
from .warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """The remainder of crc32(doc_id as text); null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _list_changes(pages: DataFrame) -> DataFrame:
    """A dated list made from the pages' own hosts by a fixed rule: a third of the hosts, and the domains above some
    others, are added at some day of the year, removed some weeks later, and added again."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host is not null").distinct()
    number = lambda at: F.conv(F.substring(F.md5(F.col("host").cast("binary")), at, 4), 16, 10).cast("int")
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\.[^.]+\..+)$", 1)
    pattern = F.when(number(1) % 3 == 0, F.col("host")).when((number(1) % 3 == 1) & (parent != ""), parent)
    first = number(5) % 180
    second = first + 30 + number(9) % 60
    days = F.array(F.struct(first.alias("day"), F.lit(True).alias("added")), F.struct(second.alias("day"), F.lit(False).alias("added")), F.struct((second + 60).alias("day"), F.lit(True).alias("added")))
    changes = hosts.select(pattern.alias("pattern"), F.explode(days).alias("change")).filter("pattern is not null")
    return changes.select("pattern", "change.added", (_new_year() + F.make_dt_interval(F.col("change.day"))).alias("at"))


def _new_year() -> Column:
    return F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    minute = (F.col("page_id") % 525600 * 7919 % 525600).cast("int")
    captures = pages.select("page_id", "url", (_new_year() + F.make_dt_interval(F.lit(0), F.lit(0), minute)).alias("fetched_at"))
    return judge(captures, _list_changes(pages))


def op4_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), held_out=fold(4) == 2)


def op7_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), held_out=fold(7) == 2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {name: sql for name, sql in vars(oracles).items() if name.startswith("op")}
