"""WARC, URL filters and the vector searches against plain versions, and their defined results for odd rows."""

import base64
import datetime as dt
import gzip
import hashlib
import math
import os
import tempfile
import time
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hash_forest, queries, va_file, warc
from tidemark.llm.common import stored
from tidemark.llm.hash_forest import nearest
from tidemark.llm.url_filter import judge
from tidemark.llm.va_file import exact_top_k
from tidemark.llm.warc import archived, payload, read_archive, read_archives, write_archives

PAGES = "page_id long, url string, html string, digest string, first long, value string"


@pytest.fixture(scope="module")
def pages(spark):
    long, other = "<p>ä\r\n\r\nWARC/1.1\r\n" + "x" * 200, "y" * 99
    rows = [(5, "http://a.example/ b", long), (3, None, long), (9, "u", long), (1, "u", other), (2, "u", other), (4, "u", None), (6, "u", ""), (None, "u", long), (3, None, long), (7, "u", "z" * 100_000)]
    return spark.createDataFrame([(*r, None, None, None) for r in rows], PAGES)


def test_archives(pages):
    rows = sorted(archived(pages).collect(), key=str)
    want = []
    for r in pages.collect():
        data = (r.html or "").encode()
        ids = [x.page_id for x in pages.collect() if x.html == r.html and x.page_id is not None]
        again = r.page_id is not None and len(data) >= 100 and r.page_id > min(ids)
        want.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_empty_archives(pages):
    assert archived(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def archive(pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "out")
    write_archives(pages.coalesce(1), path)
    return b"".join(bytes(row.content) for row in pages.sparkSession.read.format("binaryFile").load(path).orderBy("path").collect())


def test_round_trip_keeps_payloads(pages, archive):
    records = list(read_archive(archive))
    assert len(records) == pages.count() and not any(r.gap for r in records)
    assert {payload(r) for r in records if r.headers["warc-type"] == "response"} == {(r.html or "").encode() for r in pages.collect()}


@pytest.mark.parametrize("members", [False, True])
def test_salvage(archive, members):
    """Damage to one record costs that record alone, and every byte is in a record or in a gap."""
    whole = list(read_archive(archive))
    parts = [archive[r.offset : r.offset + r.length] for r in whole]
    if members:
        parts = [gzip.compress(p) for p in parts]
    for k in range(len(parts)):
        for spoil in (lambda p: p[: len(p) // 2], lambda p: p[: len(p) // 2] + b"\0\1\2" + p[len(p) // 2 + 3 :], lambda p: b"junk" + p, lambda p: p[5:]):
            data = b"".join(p if i != k else spoil(p) for i, p in enumerate(parts))
            found = list(read_archive(data))
            kept = [r.headers["warc-record-id"] + r.headers["warc-type"] for r in found if not r.gap]
            others = [r.headers["warc-record-id"] + r.headers["warc-type"] for i, r in enumerate(whole) if i != k]
            assert [x for x in kept if x in others] == others or sorted(kept) == sorted(others + [whole[k].headers["warc-record-id"] + whole[k].headers["warc-type"]])
            assert sum(r.length for r in found) == len(data)


def test_salvage_over_wrong_length(archive):
    """A length that runs into the records behind doesn't swallow them."""
    first = next(iter(read_archive(archive)))
    data = archive.replace(f"Content-Length: {first.headers['content-length']}\r\n\r\nHTTP".encode(), b"Content-Length: 5\r\n\r\nHTTP", 1)
    found = list(read_archive(data))
    assert found[0].gap and len([r for r in found if not r.gap]) >= len(list(read_archive(archive))) - 1


def test_reader_reports_gaps(spark, archive, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"lost bytes" + archive)
    rows = read_archives(spark, str(tmp_path)).collect()
    (gap,) = (r for r in rows if r.gap)
    assert (gap.offset, gap.length, gap.page_id) == (0, 10, None)


@pytest.mark.parametrize("kind", ["sha1", "sha256", "md5"])
def test_digests_of_other_writers(kind):
    """Payload and block digests in base32 or hex; damage of the same length is found by either."""
    block = b"HTTP/1.1 200 OK\r\n\r\nbody of the page"
    for part, name in ((block, "WARC-Block-Digest"), (block[19:], "WARC-Payload-Digest")):
        made = hashlib.new(kind, part)
        for value in (made.hexdigest(), base64.b32encode(made.digest()).decode()):
            record = f"WARC/1.0\r\nWARC-Type: response\r\n{name}: {kind}:{value}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
            assert [r.gap for r in read_archive(record)] == [None]
            assert [bool(r.gap) for r in read_archive(record.replace(b"body", b"b0dy"))] == [True]


def test_a_gap_ends_the_query(pages, archive, monkeypatch):
    """What a damaged archive lost is told, not left out."""

    def damaged(pages_, path):
        os.makedirs(path)
        with open(f"{path}/a.warc", "wb") as file:
            file.write(archive[: len(archive) // 2] + b"#" + archive[len(archive) // 2 + 1 :])

    monkeypatch.setattr(warc, "write_archives", damaged)
    monkeypatch.setattr(warc, "new_path", lambda spark, kind: tempfile.mkdtemp() + "/out")
    with pytest.raises(Exception, match="quarantined"):
        archived(pages).collect()


def test_large_pages_get_files_of_their_own(spark, tmp_path):
    table = spark.createDataFrame([(k, "u", "x" * n) for k, n in enumerate([10, 70_000, 2_000_000, 3_000_000])], "page_id long, url string, html string")
    write_archives(table, str(tmp_path / "out"))
    back = read_archives(spark, str(tmp_path / "out"), with_payload=True)
    assert sorted((r.page_id, len(r.payload)) for r in back.collect()) == [(0, 10), (1, 70_000), (2, 2_000_000), (3, 3_000_000)]
    assert back.groupBy("file").count().count() >= 3


def test_url_filter_edges(spark):
    """Entries of one label, very long URLs, large ids, a history of many changes, and empty tables."""
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    changes = [("test", True, at(0)), *(("busy.example", k % 2 == 0, at(k)) for k in range(1001)), ("http://x.example/path", True, at(0))]
    captures = [(1 << 60, "http://a.b.test/" + "y" * 100_000, at(1)), *((k, "http://w.busy.example/", at(k) if k % 2 else at(k) + dt.timedelta(minutes=59)) for k in range(1001)), (-5, "http://x.example/path", at(3))]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame(changes, "pattern string, added boolean, at timestamp_ntz")
    got = {r.page_id: (r.listed, r.valid_from) for r in judge(frame, entries).collect()}
    assert got[1 << 60] == (True, at(0)) and not got[-5][0]
    assert all(got[k] == ((True, at(k)) if k % 2 == 0 else (False, None)) for k in range(1001))
    assert judge(frame.limit(0), entries).count() == 0 and judge(frame, entries.limit(0)).filter("listed").count() == 0


def test_large_page_ids(spark, tmp_path):
    spark.createDataFrame([(1 << 60, "http://a.example/", "x"), (-(1 << 62), "http://b.example/", "x")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op3_url_filter(spark, str(tmp_path)).count() == 2


def test_url_filter(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    changes = [("bad.example", True, day(2)), ("bad.example", False, day(5)), ("BAD.example", True, day(8)), ("x.bad.example", True, day(0)), ("tie.example", False, day(1)), ("tie.example", True, day(1)), (None, True, day(0)), ("late.example", None, day(0))]
    captures = [(k, u, day(t) if t is not None else None) for k, (u, t) in enumerate([
        ("http://bad.example/", 1), ("http://bad.example/", 2), ("https://u:p@WWW.Bad.Example:80/x", 4), ("http://bad.example", 5), ("http://bad.example", 9), ("http://x.bad.example/a", 3),
        ("http://notbad.example/", 3), ("http://tie.example./", 1), (None, 3), ("nonsense", 3), ("http://bad.example/", None), ("http://late.example/", 3), ("http://bad.example/", 2)])]
    table = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz").withColumn("pattern", F.lit("?")).withColumn("hit", F.lit(1))
    got = {r.page_id: (r.listed, r.pattern) for r in judge(table, spark.createDataFrame(changes, "pattern string, added boolean, at timestamp_ntz")).collect()}
    no, bad = (False, None), (True, "bad.example")
    assert got == {0: no, 1: bad, 2: bad, 3: no, 4: bad, 5: (True, "x.bad.example"), 6: no, 7: (True, "tie.example"), 8: no, 9: no, 10: no, 11: no, 12: bad}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[50:90] = x[40] + 1e-3 * rng.standard_normal((40, 16))  # a dense group
    x[100:130] = x[20]  # equal vectors
    rows = [(int(k) - 40, v.tolist()) for k, v in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [None, *[1.0] * 15]), (5060, [math.nan] * 16), (5080, [math.inf] * 16), (None, [1.0] * 16), (5100, [0.5])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0)).withColumn("rank", F.lit(0))


def usable(vectors):
    rows = {r.vec_id: r.embedding for r in vectors.collect() if r.vec_id is not None and r.embedding and all(e is not None and math.isfinite(e) for e in r.embedding)}
    return {i: np.array(e + [0.0] * (16 - len(e))) for i, e in rows.items()}


def plain_top(table, k, scale=None):
    out = {}
    table = {i: np.floor(scale * v) for i, v in table.items()} if scale else table
    for q in (i for i in table if i % 20 == 0):
        scores = sorted(((-float(table[q] @ v), i) for i, v in table.items() if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("k", [1, 20, 2000])
def test_exact_top_k(vectors, k):
    assert by_query(exact_top_k(vectors, k).collect()) == plain_top(usable(vectors), k, 64)


@pytest.mark.parametrize("factor", [30.0, 1000.0, 1e12, 1e307])
def test_exact_top_k_beside_long_vectors(vectors, factor):
    """One vector far longer than the rest, and one with a single component that large."""
    spark = vectors.sparkSession
    first = next(r.embedding for r in vectors.collect() if r.vec_id == 1)
    more = spark.createDataFrame([(7001, [factor * x for x in first]), (7020, [factor, *first[1:]])], "vec_id long, embedding array<double>")
    table = vectors.select("vec_id", "embedding").unionByName(more)
    want = exact_plain_top(usable(table), 20)
    if any(not -(1 << 63) <= score < 1 << 63 for found in want.values() for _, score in found):
        with pytest.raises(Exception, match="doesn't fit a long"):
            exact_top_k(table).collect()
        table = table.filter("vec_id <> 7020")  # alone, the other vector's products fit
        want = exact_plain_top(usable(table), 20)
        if factor > 1e15:
            return
    assert by_query(exact_top_k(table).collect()) == want


def repeated(spark):
    """Rows that share their id: (id, vector)."""
    rng = np.random.default_rng(9)
    rows = [(k % 60, v.tolist()) for k, v in enumerate(rng.standard_normal((150, 8)))] + [(1, [50.0] + [0.0] * 7), (20, [1.0] * 8), (20, [1.0] * 8), (100, [1e9] + [0.0] * 7)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_rows_that_repeat_an_id_are_vectors_of_their_own(spark):
    rows, table = repeated(spark)
    ints = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want, plain = [], []
    for n, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[n][1], y, strict=True)), v) for m, (v, y) in enumerate(ints) if m != n)[:5]
            want += [(q, rank + 1, v, -s) for rank, (s, v) in enumerate(scores)]
            plain += [(q, rank + 1) for rank in range(5)]
    assert sorted(map(tuple, exact_top_k(table, 5).collect())) == sorted(want)
    near = nearest(table, 5).collect()
    assert sorted((r.query_id, r.rank) for r in near) == sorted(plain)
    assert [r.score for r in near if r.query_id == 20 and r.rank == 1].count(8.0) <= 2 and (100, 1, 1) in {(r.query_id, r.rank, r.vec_id) for r in near}


def exact_plain_top(table, k):
    ints = {i: [math.floor(64 * Fraction(float(x))) for x in v] for i, v in table.items()}
    out = {}
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_exact_top_k_reads_few_vectors(vectors, monkeypatch):
    """Beside a vector 1000 times as long, bounds still leave few candidates a query."""
    seen = []
    monkeypatch.setattr(va_file, "stored", lambda df: seen.append(kept := stored(df)) or kept)
    table = vectors.select("vec_id", "embedding").unionByName(vectors.filter("vec_id = 1").limit(1).select(F.lit(7001).alias("vec_id"), F.transform("embedding", lambda x: x * 1000).alias("embedding")))
    queries = exact_top_k(table).select("query_id").distinct().count()
    (visits,) = (t for t in seen if t.columns == ["query_id", "vec_id", "upper", "turn"] and t.filter("turn = 1").count() == queries)
    assert visits.count() <= 25 * queries


def recall(want, got):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_hash_forest(vectors):
    """All queries count, those among equal vectors and in the dense group too."""
    want, got = plain_top(usable(vectors), 20), by_query(nearest(vectors).collect())
    assert set(got) == set(want) and all(len(got[q]) == 20 for q in got)
    table = usable(vectors)
    assert all(s == pytest.approx(float(table[q] @ table[i])) for q in got for i, s in got[q])
    assert recall(want, got) >= 0.9
    for q in got:  # equal scores in the order of ids
        assert all((a[1], -a[0]) > (b[1], -b[0]) for a, b in zip(got[q], got[q][1:], strict=False))


def test_hash_forest_over_many_shards(vectors, monkeypatch):
    monkeypatch.setattr(hash_forest, "SHARD_ROWS", 250)
    assert recall(plain_top(usable(vectors), 20), by_query(nearest(vectors).collect())) >= 0.9


def test_forest_descends_and_ascends():
    """Depths are the longest shared prefixes, and ranges hold just the rows that share them."""
    x = np.random.default_rng(1).standard_normal((400, 8))
    x[7] = x[3]
    forest, strings = hash_forest.Forest.build(x), hash_forest.hash_strings(x)
    symbols = lambda a: [int(a) >> 7 * k & 127 for k in reversed(range(9))]
    shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(symbols(a), symbols(b), strict=True)) if x != y), 9)
    depths = forest.depths(strings, np.ones(400, dtype=bool))
    for q in (0, 3, 7, 399):
        assert all(depths[t, q] == max(shared(strings[t, q], strings[t, i]) for i in range(400) if i != q) for t in range(4))
        for level in (0, 1, 2, 9):
            lo, hi = forest.ranges(strings[:, [q]], np.array([level]))
            for t in range(4):
                assert set(forest.order[t, lo[t, 0] : hi[t, 0]]) == {i for i in range(400) if shared(strings[t, q], strings[t, i]) >= level}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_hash_forest_recall_on_the_table(spark, sf):
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = plain_top({r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table.collect()}, 20)
    assert recall(want, by_query(nearest(table).collect())) >= 0.9


def test_forest_scores_few(spark):
    """Of the given table, where vectors have little structure, less than a fifth is scored; recall is tested above."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, own = np.array([r.embedding for r in rows], dtype=np.float64), np.array([n for n, r in enumerate(rows) if r.vec_id % 20 == 0])
    forest, strings = hash_forest.Forest.build(x), hash_forest.hash_strings(x[own])
    least = int(hash_forest.SCORED * len(x)) + hash_forest.SCORED_K * 20
    met = list(forest.candidates(strings, own, least))
    assert all(len(m) >= least and n not in m for m, n in zip(met, own, strict=True))
    assert np.mean([len(m) for m in met]) < 0.2 * len(x)


def test_forest_ascends_from_a_small_group(spark):
    """Five near-equal vectors meet in all trees, yet each query gets k rows, the group's first."""
    random = np.random.default_rng(4)
    x = random.standard_normal((400, 16))
    x[:100:20] = 9 * x[0] + 1e-6 * random.standard_normal((5, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(nearest(table).collect())
    assert set(got) == set(range(0, 400, 20)) and all(len(found) == 20 for found in got.values())
    assert all({i for i, _ in got[q][:4]} == set(range(0, 100, 20)) - {q} for q in range(0, 100, 20))


@pytest.mark.parametrize("run", [exact_top_k, nearest])
def test_few_vectors(vectors, run):
    assert run(vectors.limit(0)).count() == 0
    two = vectors.sparkSession.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in run(two).collect()] == [(0, 1)]


def test_long_histories_are_bisected(spark):
    """The starts of an entry's intervals are made once an entry, not once a step of a capture's bisection."""
    captures = spark.range(300).selectExpr("id AS page_id", "'http://a.b/' AS url", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(id * 97 AS INT)) AS fetched_at")

    def seconds(changes):
        history = spark.range(changes).selectExpr("'a.b' AS pattern", "id % 2 = 0 AS added", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, CAST(id AS INT)) AS at")
        began = time.perf_counter()
        rows = judge(captures, history).collect()
        assert all(r.listed == (min(r.page_id * 97, changes - 1) % 2 == 0) for r in rows)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16000) < 4 * seconds(1000) + 3
