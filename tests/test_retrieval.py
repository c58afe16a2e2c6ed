"""The index in versions, the model's hook, and texts scored by word frequencies."""

import math
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators.retrieval import Index, model_embedder
from tidemark.operators.terms import search_texts, word_list
from tidemark.sources.catalog import Catalog


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            word = word[:-1] if word.endswith("s") else word
            out += [word] if len(word) > 1 else []
            word = ""
        else:
            word += c
    return out


def plain_scores(texts, query):
    """(id, cosine) of those that share a word with the query, best first."""
    bags = {i: Counter(plain_words(t)) for i, t in texts}
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in b for b in bags.values()))) + 1
    asked = {w: n * idf(w) for w, n in Counter(plain_words(query)).items() if any(w in b for b in bags.values())}
    found = []
    for i, bag in bags.items():
        own = {w: n * idf(w) for w, n in bag.items()}
        product = sum(own[w] * v for w, v in asked.items() if w in own)
        if product:
            found.append((i, round(product / math.dist(own.values(), [0] * len(own)) / math.dist(asked.values(), [0] * len(asked)), 9)))
    return sorted(found, key=lambda x: (-x[1], x[0]))


def test_word_list(spark):
    texts = ["Prices, of_the CAFÉ’s naïve élan; a 7 42", "", None, "ss s x\x00yz"]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", word_list(F.col("t")).alias("w")).collect()
    assert {r.k: r.w for r in got} == {k: plain_words(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("query", ["red apples in the garden", "zzz nothing", "", "the the THE", "x' OR 1=1 -- \\ $"])
def test_search_texts(spark, query):
    texts = [(1, "red apple, red pear"), (2, "the garden of apples"), (3, ""), (4, None), (5, "The THE the"), (6, "red apple, red pear"), (7, "or " + "pear " * 5000), (None, "red apple")]
    table = spark.createDataFrame([(*t, "extra", 1.0) for t in texts], "id long, body string, words string, score double")
    got = [tuple(r) for r in search_texts(table, "id", "body", query, 4).collect()]
    want = [x for x in plain_scores([(-1 if i is None else i, t) for i, t in texts], query) if x[0] > 0][:4]
    assert [(i, pytest.approx(s)) for i, s in want] == got
    assert search_texts(table.limit(0), "id", "body", query, 4).collect() == []


def test_an_update_describes_only_what_is_new(spark, tmp_path):
    folder, asked = str(tmp_path / "index"), []

    def describe(names):
        asked.append(names)
        return spark.createDataFrame([(n, f"{n} text {len(asked)}") for n in names], "table_name string, document string")

    held = lambda index: {r.table_name: r.document for r in index.table.collect()}
    assert Index.newest(spark, folder) is None
    first = Index.updated(spark, folder, {"a": "1", "b": "1"}, describe)
    second = Index.updated(spark, folder, {"a": "1", "b": "2", "c": "1"}, describe)
    again = Index.updated(spark, folder, {"a": "1", "b": "2", "c": "1"}, describe)
    assert asked == [["a", "b"], ["b", "c"]] and (first.version, second.version, again.version) == (0, 1, 1)
    # Readers keep their version, also after a new one is written.
    assert held(first) == {"a": "a text 1", "b": "b text 1"} and held(again) == {"a": "a text 1", "b": "b text 2", "c": "c text 2"}
    third = Index.updated(spark, folder, {"c": "1"}, describe)
    assert len(asked) == 2 and held(third) == {"c": "c text 2"} and third.version == 2
    Index.vacuum(spark, folder, keep=1)
    assert len(os.listdir(f"{folder}/parts")) == 2  # young parts stay
    Index.vacuum(spark, folder, keep=1, seconds=0)
    assert len([p for p in os.listdir(f"{folder}/parts") if not p.startswith(".")]) == 1 and held(Index.newest(spark, folder)) == {"c": "c text 2"}
    # What was dropped may come back, and is described anew.
    assert held(Index.updated(spark, folder, {"a": "1", "c": "1"}, describe)) == {"a": "a text 3", "c": "c text 2"}


def test_search_ranks_by_rare_words(spark, tmp_path):
    documents = [("a", "common common rare"), ("b", "common word"), ("c", "common thing"), ("d", "other")]
    describe = lambda names: spark.createDataFrame([d for d in documents if d[0] in names], "table_name string, document string")
    index = Index.updated(spark, str(tmp_path / "i"), {n: "1" for n, _ in documents}, describe)
    hits = index.search("common rare", 9).collect()
    assert [h.table_name for h in hits][:2] == ["a", "b"] and hits[-1].score == 0 and len(hits) == 4
    assert [(h.table_name, pytest.approx(h.score)) for h in hits if h.score] == plain_scores(documents, "common rare")


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as file:
            file.write(f"{os.getpid()}\n")
        return lambda texts: [[float("x" in t), float("y" in t), 0.5] for t in texts]

    documents = [(f"t{k}", "x" if k % 2 else "y") for k in range(40)]
    describe = lambda names: spark.createDataFrame(documents, "table_name string, document string").repartition(16)
    index = Index.updated(spark, str(tmp_path / "i"), {n: "1" for n, _ in documents}, describe, model_embedder("letters", load))
    hits = index.search("x", 3).collect()
    assert [(h.table_name, h.score) for h in hits] == [("t1", 1.25), ("t11", 1.25), ("t13", 1.25)]
    with open(loads) as file:
        workers = file.read().split()
    assert len(workers) == len(set(workers)) < 16


def test_fingerprints_tell_uploads_apart(spark):
    catalog = Catalog(spark)
    one = spark.createDataFrame([(1,)], "a long")
    catalog.register("t", one, version="1")
    catalog.register("u", one)
    before = catalog.fingerprints()
    catalog.register("t", one, version="2")
    assert catalog.fingerprints()["t"] != before["t"] and catalog.fingerprints()["u"] == before["u"]
