"""Periodic runs and importance resampling against plain versions, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import importance, periodic_runs
from tidemark.llm.importance import resampled
from tidemark.llm.queries import op12_periodic_runs, op13_importance

DIR = "/root/testdata/sf0.001"
#: Columns that the operators use inside beside those that they read.
SCHEMA = "doc_id long, text string, row long, n long, lo int, hi int, later string, rank int, score string, weight int, bucket int, __number int, __part string"


def with_extras(spark, rows):
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in rows], SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w):
    """Every maximal stretch of every lag, with its smallest period worked out."""
    out = set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i and smallest_period(w[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_answer(doc_id, text):
    w = plain_planted(doc_id, words(text))
    runs = plain_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


@pytest.fixture(scope="module")
def repetitive():
    """Random words over small vocabularies with planted repetitions, nested ones too."""
    r = random.Random(3)
    out = [None, "", " \n\t ", "one", "a " * 11, "a " * 12, "a " * 300, "a\x0bb\x0cc " * 9, "ab c d e f g " * 2, "é x y " * 7, "a b " * 40 + "c " + "a b " * 40]
    for k in range(120):
        vocabulary = [f"w{i}" for i in range(r.choice([2, 3, 50]))]
        some = lambda n: [r.choice(vocabulary) for _ in range(n)]  # noqa: B023, E731
        unit = some(r.randint(1, 9)) * r.randint(1, 3) + some(r.randint(0, 3))
        out.append(" ".join(some(r.randint(0, 30)) + unit * r.randint(1, 6) + unit[: r.randint(0, len(unit))] + some(r.randint(0, 30))))
    return list(enumerate(out))


def fields(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_periodic_runs(spark, repetitive):
    rows = [*repetitive, repetitive[40], (None, repetitive[6][1])]
    got = fields(periodic_runs.periodic_runs(with_extras(spark, rows)).collect())
    assert got == fields([plain_answer(i, t) for i, t in rows])
    assert sum(r[1] > 1 for r in got) > 20


def test_long_texts_are_searched_by_several_tasks(spark, repetitive):
    rows = [*repetitive, repetitive[40], (None, repetitive[6][1]), (1000, "x y z " * 300)]
    got = periodic_runs.periodic_runs(with_extras(spark, rows), long_bytes=60, work=400)
    assert fields(got.collect()) == fields([plain_answer(i, t) for i, t in rows])


def test_periodic_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(with_extras(spark, [])).collect() == []


def test_op12_on_documents(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    brute = [plain_answer(*r) for r in rows if len(words(r.text)) < 1500]
    got = {tuple(r) for r in op12_periodic_runs(spark, DIR).collect()}
    assert len(got) == len(rows) and len(brute) > 150 and set(brute) <= got


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampled(docs, targets):
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in targets for b in plain_features(x)[1])
    whole, wanted = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * wanted)))
    scored = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0], x[2]))
    place = {id(x): k + 1 for k, x in enumerate(able[: 5 * len(able) // 100])}
    return [(x[0], *x[2:], place.get(id(x))) for x in scored]


@pytest.fixture(scope="module")
def prose():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcDEé9") for _ in range(r.randint(1, 6))) for _ in range(60)] + ["x" * 70, "y" * 64, "z" * 63]
    texts = [None, "", " .,- ", "Word", "one-TWO_three", "a " * 2000, *(r.choice(", ;\n- ").join(r.choice(vocabulary) for _ in range(r.randint(1, 90))) for _ in range(300))]
    return list(enumerate(texts)), [" ".join(r.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)]


def test_importance(spark, prose):
    docs, targets = prose
    rows = [*docs, docs[30], docs[30], (None, docs[31][1])]
    want = fields(plain_resampled(rows, targets))
    target = spark.createDataFrame([(t, "x") for t in [*targets, None]], "text string, doc_id string")
    assert fields(resampled(with_extras(spark, rows), target).collect()) == want
    assert sum(x[4] is not None for x in want) >= 10


def test_pieces_count_as_the_whole(prose, monkeypatch):
    docs, _ = prose
    monkeypatch.setattr(importance, "BLOCK_WORDS", 50)
    tries = [importance.Trie(block) for _, block in importance._blocks([(t or "").encode() for _, t in docs])]
    totals = sum(trie.totals(10000) for trie in tries)
    assert len(tries) > 50 and {k: int(n) for k, n in enumerate(totals) if n} == Counter(b for _, t in docs for b in plain_features(t)[1])


def test_pieces_walk_as_the_whole(prose, monkeypatch):
    docs, _ = prose
    texts = [(t or "").encode() for _, t in docs]
    gains = (importance.np.arange(10000) * 7919) % 2001 - 1000

    def sums():
        out = importance.np.zeros((2, len(texts)), dtype="int64")
        for rows, block in importance._blocks(texts):
            of = importance.np.repeat(rows, [len(w) for _, w in block])
            for k, values in enumerate(importance.Trie(block).walked(gains)):
                importance.np.add.at(out[k], of, values)
        return out.tolist()

    whole = sums()
    monkeypatch.setattr(importance, "BLOCK_WORDS", 7)
    assert sums() == whole


def test_importance_of_nothing(spark):
    none, some = with_extras(spark, []), with_extras(spark, [(1, "a b " * 30)])
    assert resampled(none, none).collect() == []
    assert fields(resampled(some, none).collect()) == fields(plain_resampled([(1, "a b " * 30)], []))


def test_op13_on_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert fields(op13_importance(spark, DIR).collect()) == fields(plain_resampled(docs, targets))
