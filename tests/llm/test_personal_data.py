"""Personal data against plain patterns, and what the trees add to them."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.pii import KINDS, personal_data
from tidemark.llm.queries import op11_personal_data

DIR = "/root/testdata/sf0.001"
#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Columns that the operator uses inside beside those that it reads.
SCHEMA = "doc_id long, text string, row long, kind string, start int, end int, base string, hits int, found0 string, label double, features string, p double"


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0


def fits(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if fits(k, m[0])] for k, p in PATTERNS.items()}


def check(row, text):
    """The base of one answer; returns the spans added."""
    want = plain(text)
    listed = [f"{k}:{s}:{e}" for k in KINDS for s, e in want[k]]
    assert [row[f"n_{k}"] for k in KINDS] == [len(want[k]) for k in KINDS], text
    assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), text
    spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in row.spans.split(",") if x)]
    assert spans == sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])) and set(listed) <= set(row.spans.split(","))
    return {x for x in spans if f"{x[0]}:{x[1]}:{x[2]}" not in listed}


def card(r, sign=""):
    digits = "4" + "".join(r.choice("0123456789") for _ in range(14))
    digits = next(digits + c for c in "0123456789" if luhn(digits + c))
    return sign.join(digits[k : k + 4] for k in range(0, 16, 4))


ODD = [
    None, "", " ", "no data at all", "a@b", "a@b.c", "x..y@a-b.co.uk.", "é@ä.de a.b@c.de_f@g.hi", "@a.b", "a@b..c", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255", "1.2.3", "99999999999999999999999999999999999999999.1.1.1",
    "𝒳𝒳 a@b.cd 𝒳 10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "5 4111 1111 1111 1111", "41111111111111111111", "+1 (234) 567-8901", "+1 (234) 567-8901 4111 1111", "+12345678", "+1234567", "+(1) 2", "+1+23456789012", "++49 30 123456.", "x" * 30000 + "@" + "y" * 30000,
]


def test_base_spans(spark):
    rows = [*enumerate(ODD), (16, ODD[16]), (None, ODD[21]), (900, " ".join(str(k) for k in range(8000))), (901, "1 2 " * 8000), (902, "a.b@c.de " * 3000)]
    r = random.Random(4)
    rows += [(1000 + k, "".join(r.choice("0123456789.+-@ ()ab") for _ in range(r.randint(1, 60)))) for k in range(1500)]
    docs = spark.createDataFrame([(i, t, *[None] * 10) for i, t in rows], SCHEMA).repartition(3)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    got = personal_data(docs, trees=2, depth=2).collect()
    assert sorted(str(x.doc_id) for x in got) == sorted(str(i) for i, _ in rows)
    for row in got:
        check(row, texts[row.doc_id][0])


@pytest.fixture(scope="module")
def found(spark):
    """What is added in texts with plain data, look-alikes, and data in forms that the base patterns miss: {name: [(wanted, added)]}."""
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdefghilmnorst") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    number = lambda n: "".join(r.choice("123456789") for _ in range(n))
    name, host = lambda: f"{r.choice(vocabulary)}.{r.randint(10, 99)}", lambda: f"{r.choice(vocabulary)}.example.com"
    phone, ip = lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: ".".join(str(r.randint(11, 250)) for _ in range(4))
    forms = {
        "email": lambda: f"{name()}@{host()}", "ip": ip, "card": lambda: card(r, r.choice(["", " ", "-"])), "phone": phone,
        "other": lambda: r.choice([number(9), number(16), f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", f"19{r.randint(10, 99)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"meet at noon.{r.choice(vocabulary)}", f"{r.randint(300, 900)}.1.2.3", " ".join(number(2) for _ in range(7)), f"+{number(3)}"]),
        "~email": lambda: f"{name()} (at) {host().replace('.', ' (dot) ')}", "~phone": lambda: f"{phone()} {number(10)}", "~card": lambda: f"7 {card(r)}", "~ip": lambda: ip().replace(".", "[.]"),
    }
    rows, wanted = [], {}
    for form, make in forms.items():
        for _ in range(150 if form in KINDS else 250 if form == "other" else 25):
            text = make()
            before = prose(r.randint(3, 30))
            wanted[len(rows)] = (form, before, text)
            rows.append((len(rows), f"{before} {text} {prose(8)}"))
    got = personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), trees=10)
    out = {form: [] for form in forms}
    for row in got.collect():
        form, before, text = wanted[row.doc_id]
        added = {(k, rows[row.doc_id][1][s:e]) for k, s, e in check(row, rows[row.doc_id][1])}
        out[form].append((text, added))
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_data_in_other_forms_is_added(found, kind):
    """Written-out emails, bracketed addresses, and numbers that a longer cluster hides; learnt from plain forms alone."""
    part = {"phone": lambda text: text[:17], "card": lambda text: text[2:]}.get(kind, lambda text: text)
    hit = sum((kind, part(text)) in added for text, added in found[f"~{kind}"])
    assert hit >= 0.9 * len(found[f"~{kind}"]), found[f"~{kind}"][:5]


def test_look_alikes_are_left_alone(found):
    wrong = [(text, added) for form in (*KINDS, "other") for text, added in found[form] if added]
    assert len(wrong) <= 5, wrong


def test_reruns_agree(spark):
    runs = [sorted(map(tuple, op11_personal_data(spark, DIR).repartition(n).collect())) for n in (1, 3)]
    assert runs[0] == runs[1]


def test_op11_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    rows = op11_personal_data(spark, DIR).collect()
    assert len(rows) == len(texts)
    for row in rows:
        check(row, texts[row.doc_id])


def test_nothing(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_spans_are_learnt_from(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(pii, "stored", lambda df: tables.append(df.localCheckpoint()) or tables[-1])
    rows = spark.range(5000).withColumn("text", F.concat(F.lit("10.1.2."), F.col("id") % 250))
    spans = lambda rows: rows.selectExpr("id AS row", "'ip' AS kind", "3L AS start", "3L + length(text) AS end", "text", "'at ' AS before", "'' AS behind", "'at ' AS context")
    pii.learnt(spans(rows), spans(rows.withColumn("text", F.concat(F.lit("300."), "text"))), trees=1, depth=1)
    fitted = {r.label: r.n for r in tables[0].groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    assert fitted == {1.0: 25_000, 0.0: 5000}  # base spans as they are and in four forms
