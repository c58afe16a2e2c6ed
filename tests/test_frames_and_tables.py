"""Frames over groups of peers, joins of intervals and JSON tables against plain versions."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators.frames import EXCLUDED, grouped_frames
from tidemark.operators.intervals import met_others, overlap_join, span_totals
from tidemark.operators.json_tables import json_each, json_tree
from tidemark.queryset import QUERIES


@pytest.fixture(scope="module")
def valued(spark):
    """Few distinct places and values, nulls in each column, repeated rows."""
    r = random.Random(1)
    some = lambda n: r.choice([None, *range(n)])
    rows = [(k // 2, some(3), some(5), None if r.random() < 0.2 else Decimal(r.randint(-3, 6))) for k in range(160)]
    return rows, spark.createDataFrame(rows, "id int, `p q` int, at int, v decimal(10,2)").repartition(3)


def plain_frame(rows, start, end, exclude):
    low = lambda x: (x is not None, x or 0)
    out = []
    for k, (i, p, at, v) in enumerate(rows):
        places = sorted({r[2] for r in rows if r[1] == p}, key=low)
        mine = places.index(at)
        held = []
        for n, r in enumerate(rows):
            step = places.index(r[2]) - mine if r[1] == p else None
            inside = step is not None and (start is None or step >= start) and (end is None or step <= end)
            gone = {"no others": False, "current row": n == k, "group": step == 0, "ties": step == 0 and n != k}[exclude]
            if inside and not gone and r[3] is not None:
                held.append(r[3])
        out.append((i, p, at, v, sum(held) if held else None, len(held), min(held, default=None), max(held, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("exclude", EXCLUDED)
@pytest.mark.parametrize(("start", "end"), [(-1, 1), (None, 0), (0, None), (-2, -1), (1, 2), (None, None), (0, 0)])
def test_grouped_frames(valued, start, end, exclude):
    rows, df = valued
    got = [(*r[:4], None if r[4] is None else Decimal(r[4]).quantize(Decimal("0.01")), *r[5:]) for r in map(tuple, grouped_frames(df, ["p q"], ["at"], "v", start, end, exclude).collect())]
    assert sorted(got, key=lambda r: repr(tuple(map(lambda x: x if x is None else float(x), r)))) == sorted(plain_frame(rows, start, end, exclude), key=lambda r: repr(tuple(map(lambda x: x if x is None else float(x), r))))


def test_frames_refuse_what_they_cannot_do(valued):
    for bad in ({"exclude": "rows"}, {"start": 2, "end": 1}):
        with pytest.raises(ValueError):
            grouped_frames(valued[1], ["p q"], ["at"], "v", **({"start": 0, "end": 1} | bad))


def test_overlap_join(spark):
    r = random.Random(2)

    def spans(n):
        out = []
        for k in range(n):
            s = r.randint(-2000, 2000)
            out.append((k // 2, None if k % 19 == 0 else s, None if k % 23 == 0 else s + r.choice([-1, 0, 1, 2, 7, 8, 64, 1000, 5000])))
        return out

    one, other = spans(150), [*spans(120), *[(900 + k, 100, 101) for k in range(60)]]
    want = sorted((a[0], b[0]) for a in one for b in other if None not in (*a, *b) and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    frames = [spark.createDataFrame(x, "id int, s int, e int").repartition(3) for x in (one, other)]
    bounds = (F.col("s"), F.col("e"))
    for slot_rows in (100_000, 10):
        met = overlap_join(*frames, bounds, bounds, slot_rows)
        assert sorted(map(tuple, met.select("left.id", F.col("right.id").alias("of")).collect())) == want
    plan = met._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    points = sorted((a[0], b[0]) for a in one for b in other if a[1] is not None and None not in b and b[1] <= a[1] < b[2])
    assert sorted(map(tuple, overlap_join(*frames, (F.col("s"), None), bounds).select("left.id", F.col("right.id").alias("of")).collect())) == points
    assert overlap_join(frames[0].limit(0), frames[1], bounds, bounds).count() == 0


def plain_tree(value, path="$"):
    yield path, value
    for key, x in value.items() if isinstance(value, dict) else ((f"[{k}]", x) for k, x in enumerate(value)) if isinstance(value, list) else ():
        yield from plain_tree(x, path + key if isinstance(value, list) else f"{path}.{key}")


def test_json_tables(spark):
    docs = [{}, [], 5, "x", None, {"a": {"b": [1, "x", None, True, 2.5, {"c": []}]}, "d": -3}, [[[[1]]]]]
    rows = [(k, json.dumps(d)) for k, d in enumerate(docs)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    dense = lambda x: json.loads(x)
    tree = json_tree(df, "text").collect()
    assert sorted((r.id, r.path, repr(dense(r.value))) for r in tree) == sorted((k, p, repr(dict(sorted(v.items())) if isinstance(v, dict) else v)) for k, d in enumerate(docs) for p, v in plain_tree(d))
    assert {(r.path, r.type) for r in tree if r.id == 5 and r.depth >= 2} == {("$.a.b", "array"), *((f"$.a.b[{k}]", t) for k, t in enumerate(["integer", "text", "null", "true", "real", "object"])), ("$.a.b[5].c", "array")}
    each = sorted((r.id, r.key, r.pos, r.type) for r in json_each(df.filter("id >= 5"), "text").collect())
    assert each == [(5, "a", 0, "object"), (5, "d", 1, "integer"), (6, None, 0, "array")]


def test_totals_over_spans_make_no_pairs(spark, tmp_path):
    """Odd rows against a plain count, and rows so dense that their pairs (10^9 and more) wouldn't end."""
    r = random.Random(5)
    points = [(None if k % 31 == 0 else r.randint(-50, 50), r.choice(["a", "b", None]), None if k % 3 else r.randint(-9, 9)) for k in range(300)]
    spans = [(k // 2 if k % 17 else None, s, None if k % 23 == 0 else s + r.choice([-3, 0, 1, 4, 40, 200])) for k, s in ((k, r.randint(-60, 60)) for k in range(150))]
    want = {}
    for key, s, e in spans:
        for at, by, v in points:
            if None not in (at, s, e) and s <= at < e:
                n, values = want.get((key, by), (0, ()))
                want[key, by] = (n + 1, values if v is None else (*values, v))
    frames = spark.createDataFrame(points, "at int, by string, v int").repartition(3), spark.createDataFrame(spans, "key int, s int, e int").repartition(2)
    totals = lambda points, spans: span_totals(points, F.col("at"), ["by"], {"v": F.col("v")}, spans, (F.col("s"), F.col("e")), ["key"])
    got = {(x.key, x.by): (x.n, x.v) for x in totals(*frames).collect()}
    assert got == {k: (n, sum(v) if v else None) for k, (n, v) in want.items()}
    assert totals(frames[0].limit(0), frames[1]).count() == totals(frames[0], frames[1].limit(0)).count() == 0

    others = {}
    for a in spans:
        for b in spans:
            if None not in (*a, *b) and max(a[1], b[1]) < min(a[2], b[2]) and a[0] != b[0]:
                others.setdefault(a[0], []).append(b[0])
    found = met_others(frames[1], "key", (F.col("s"), F.col("e")))
    assert {x.key: (x.others, x.first) for x in found.collect()} == {k: (len(v), min(v)) for k, v in others.items()}

    spark.range(60_000).select(F.col("id").alias("o_orderkey"), F.lit(1).alias("o_custkey"), F.lit("1998-02-06").cast("timestamp").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["open_together"](spark, str(tmp_path)).groupBy("others", "first").count().orderBy("first").collect() == [(47_999, 1, 47_999), (47_999, 2, 1)]
    spark.range(60_000).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id")).alias("ts"), F.when(F.col("id") % 2 == 0, "signup").otherwise("view").alias("event_type"), F.lit(0.5).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    dense = QUERIES["events_within"](spark, str(tmp_path)).agg(F.count("*"), F.sum("n"), F.sum("value")).first()
    assert tuple(dense) == (60_000, sum(60_000 - k for k in range(0, 60_000, 2)), sum(60_000 - k for k in range(0, 60_000, 2)) / 2)
