"""Each stage of the pipeline against a plain version over its own input, and the SQL of the queries against DuckDB."""

import glob
import os
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries as q
from tidemark.llm.common import stored

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """What goes into each stage, and what comes out of the last."""
    out = [spark.read.parquet(f"{DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], DIR)))
    return out


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[1:-1])


def test_toxic_documents_go(spark, tables):
    rejected = {r.doc_id for r in q.op6_toxicity(spark, DIR).collect() if r.predicted}
    assert sorted(r.doc_id for r in tables[1].collect()) == sorted(r.doc_id for r in tables[0].collect() if r.doc_id not in rejected)


def test_one_of_each_group_stays(tables):
    from test_documents import plain_components, shingles

    roots = plain_components([(r.doc_id, shingles(r.text)) for r in tables[1].orderBy("doc_id").collect()])
    assert sorted(r.doc_id for r in tables[2].collect()) == sorted(i for i, root in roots.items() if i == root)


def test_mix_takes_whole_copies(tables):
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in tables[2].collect()}
    taken = Counter(r.doc_id for r in tables[3].collect())
    assert max(taken.values()) <= 2 and set(taken) <= set(size)
    assert sum(size[i] * n for i, n in taken.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.05)


def test_all_copies_are_packed(tables):
    assert Counter(r.doc_id for r in tables[4].filter("piece = 0").collect()) == Counter(r.doc_id for r in tables[3].collect())


def test_repeated_rows(spark, tables):
    twice = tables[1].unionByName(tables[1].limit(5))
    assert corpus_pipeline.drop_near_copies(spark, twice, DIR).count() == tables[2].count()


@pytest.fixture(scope="module")
def odd(spark, tables, tmp_path_factory):
    """Rows without ids, rows that share one, null, empty and very long texts, and columns with names that stages use."""
    base = tables[0].drop("n_chars")
    toxic, folder = "they called it a wretchbag and left", str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"long{k % 5003}x{k % 7}" for k in range(120_000))
    near = " ".join(f"near{k}" for k in range(60))
    rows = [(None, toxic, "no id"), (None, "of its own kind of text, five words and more", "no id"), (None, near, "no id"), (None, near + " more", "no id")]
    rows += [(900_000, toxic, "one id"), (900_000, "harmless text beside it under the same id", "one id"), (900_000, "harmless text beside it under the same id", "one id")]
    rows += [(800_000 + k, f"wretchbag number {k} of them", "b") for k in range(60)]
    labels = base.select("doc_id", F.lit(0).alias("toxic")).unionByName(spark.range(800_000, 800_060).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic")))
    labels.write.parquet(f"{folder}/labels.parquet")
    rows += [(900_001, None, None), (900_002, "", "a"), (900_003, long, "a"), (900_004, long + " end", "a"), (None, None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).select(base.columns)
    names = {c: F.lit(c) for c in ("row__", "copies", "copies__", "kept", "predicted", "held_out", "size", "rank", "node", "component_id", "raw", "score", "shared__x")}
    docs = stored(base.unionByName(more).withColumns(names).withColumn("n_chars", F.length("text")))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], folder)))
    return out, toxic, near, long


def test_stages_decide_on_rows(odd):
    (docs, clean, single, mixed, packed), toxic, near, long = odd
    assert docs.columns == clean.columns == single.columns == mixed.columns
    texts = lambda df: Counter(r.text for r in df.select("text").collect())
    # Every row with the toxic text goes, and no row beside it under its id.
    assert texts(docs)[toxic] == 2 and toxic not in texts(clean)
    assert texts(clean)["harmless text beside it under the same id"] == 2 and texts(clean)[None] == 2
    # One row of each group stays, with an id or without; empty texts are no copies of each other.
    left = texts(single)
    assert left["harmless text beside it under the same id"] == 1 and left[near] + left[near + " more"] == 1
    assert left[long] == 1 and long + " end" not in left and left[None] == 2 and left[""] >= 1
    # The mix has whole rows, each twice at most, and its words come near 1.5 times all words.
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, taken = Counter(map(tuple, single.collect())), Counter(map(tuple, mixed.collect()))
    assert set(taken) <= set(rows) and all(taken[r] <= 2 * rows[r] for r in taken)
    at = single.columns.index("text")
    words, mixed_words = (sum(size(r[at]) * n for r, n in x.items()) for x in (rows, taken))
    assert words < mixed_words < 2 * words
    assert packed.filter("piece = 0").count() == mixed.count()


def test_rows_are_told_apart_beside_any_ids(spark):
    rows = [(2**63 - 1, "a"), (None, "b"), (None, "b"), (-(2**63), "c"), (5, "d"), (5, "e")]
    keyed, key = corpus_pipeline._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    found = sorted((r[key], r.doc_id, r.text) for r in keyed.collect())
    assert [k for k, *_ in found] == list(range(6)) and [i for _, i, _ in found] == [-(2**63), 5, 5, 2**63 - 1, None, None]


def test_sequences_hold_all_tokens(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "kept", lambda spark, sf_dir: tables[3])
    corpus_pipeline.write_sequences(spark, DIR, str(tmp_path / "out"))
    written = {r.sequence_id: len(r.ids) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert sum(written.values()) == sum(r.length for r in tables[4].collect()) and max(written.values()) <= 2048
    assert len(written) == tables[4].select("sequence_id").distinct().count()


def test_empty(spark, tables):
    docs = tables[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    rows = q.queries()[name](spark, DIR)
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in rows.collect()))) == sorted(map(repr, want.fetchall()))
