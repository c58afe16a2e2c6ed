"""Personal data by boosted trees over proposed spans, in DataFrame operations only.

Strict patterns with checks give the base spans of emails, IP addresses, card numbers and phone numbers. Wider generators propose
more, which may overlap: written-out and bracketed signs, other separators, numbers without their prefix, and stretches of
digit groups within longer clusters. Boosted trees judge a proposal by its form and its surroundings. They learn from all
rows: base spans, and these rewritten in the generators' forms, against proposals that no check confirms; most of these are
no personal data. A threshold for each kind is set on rows that the trees haven't seen. Proposals above it that meet no base span
are added, the likeliest first where they overlap.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH = 20, 4
#: Least share of confirmed spans above a threshold (data in forms that no check confirms count against it), and the least threshold.
PRECISION, LEAST_THRESHOLD = 0.8, 0.5
#: Fewer confirmed spans of a kind teach nothing about it: none is added.
LEAST_CONFIRMED = 20
#: Code points of context before and behind a span.
BEFORE, BEHIND = 48, 24
#: Digits of a card and of a phone number at least and most; clusters of fewer digits than a card has propose nothing.
CARD, PROPOSED_CARD, PHONE = (16, 19), (13, 19), (8, 15)

#: Matches of the contract's patterns, written so that no text is read more than a few times: what can't be shorter is matched
#: whole, and begins where its first class of characters begins (or where the last match ended).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?=(?:[0-9][ -]?){{{PROPOSED_CARD[0]}}})[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r"(?: ?[\[({](?:at|AT|@| at | AT | @ )[\])}] ?| at | AT |@)", r"(?: ?[\[({] ?(?:dot|DOT|\.) ?[\])}] ?| dot | DOT |\.)"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({]?\.[\])}]? ?| (?i:dot) )[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[^0-9A-Za-z\n]{1,3}[0-9]{4}){2}[^0-9A-Za-z\n]{1,3}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]{1,2}(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9A-Za-z])",
}
#: Texts that hold none of these needn't be searched by the pattern.
NEEDED = {BASE["email"]: ("@",), BASE["phone"]: ("+",), WIDE["email"]: ("@", " at ", " AT ", "at)", "AT)", "at]", "AT]", "at}", "AT}")}
#: Base spans are rewritten in these forms to learn the generators' other forms from: (pattern, replacement) in turn.
REWRITTEN = {
    "email": tuple(((r"\.(?=[^@]*$)", dot), ("@", at)) for at, dot in ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."))),
    "ip": (((r"\.", "[.]"),), ((r"\.", " . "),), ((r"\.", " dot "),), ((r"\.", "(.)"),)),
    "card": tuple((("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", f"$1{sign}")) for sign in ("", " ", "-", ".")),
    "phone": (((r"^\+", ""),), ((r"^\+", "00"),), ((r"[^0-9+]+", "."), (r"^\+", "")), ((r"[^0-9+]+", " "), (r"^\+", ""))),
}
#: Words that speak of a kind.
HINTS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|correo)",
    "ip": r"(?i)\b(ip|host|server|address|login|ping)\b",
    "card": r"(?i)\b(card|visa|credit|payment|tarjeta|karte|carte)",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|cell|whatsapp|telefon|tel[eé]fono)",
}
SPAN = ["row", "kind", "start", "end"]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def confirmed(kind: Column, text: Column) -> Column:
    """Whether a match of a base pattern is one of its kind."""
    parts = F.forall(F.split(text, r"\."), lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False)))
    n = F.length(_digits(text))
    card = n.between(*CARD) & F.call_function("luhn_check", _digits(text))
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", parts).when(kind == "card", card).otherwise(n.between(*PHONE))


def scanned(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hits): the matches of all patterns in each text, with the length of what lies before each and their contexts."""
    patterns = [(kind, wide, p) for wide, table in ((False, BASE), (True, WIDE)) for kind, p in table.items()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))

    def found(p: str) -> Column:
        every = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        return F.when(reduce(or_, (F.contains(F.col("text"), F.lit(sign)) for sign in NEEDED[p])), every) if p in NEEDED else every

    searched = texts.select("*", *(found(p).alias(f"found{k}") for k, (*_, p) in enumerate(patterns)))
    # Most texts have no match, and only the others are parted.
    parted = searched.select("doc_id", *(c for k, (*_, p) in enumerate(patterns) for c in (F.col(f"found{k}"), F.when(F.size(f"found{k}") > 0, F.split("text", p, -1)).alias(f"pieces{k}"))))

    def hits(k: int, kind: str, wide: bool) -> Column:
        piece = lambda i: F.get(F.col(f"pieces{k}"), i)
        hit = lambda text, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("k"), F.length(piece(i)).cast("long").alias("gap"), text.alias("text"), F.right(piece(i), F.lit(BEFORE)).alias("before"), F.left(piece(i + 1), F.lit(BEHIND)).alias("behind")
        )
        return F.coalesce(F.transform(f"found{k}", hit), F.array())

    return parted.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*(hits(k, kind, wide) for k, (kind, wide, _) in enumerate(patterns))).alias("hits"))


def _placed(hits: DataFrame) -> DataFrame:
    """Hits with the code points at which they start and end."""
    size = F.length("text").cast("long")
    upto = Window.partitionBy("row", "kind", "wide").orderBy("k")
    end = F.sum(F.col("gap") + size).over(upto)
    return hits.withColumn("end", end).withColumn("start", F.col("end") - size).drop("gap")


def _stretches(clusters: DataFrame) -> DataFrame:
    """Proposals within clusters of digit groups: groups in a row that have as many digits as a card, or as a phone behind its sign.

    Each group meets the groups that follow as far as a card number can reach, so the work is linear in the groups.
    """
    most = PROPOSED_CARD[1]
    groups = F.arrays_zip(F.split("text", "[0-9]+", -1).alias("sign"), F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("digits"))
    parts = clusters.select("row", "kind", "k", "before", "behind", F.col("start").alias("from"), F.posexplode(groups).alias("g", "group"))
    parts = parts.select("row", "kind", "k", "before", "behind", "from", "g", "group.sign", "group.digits").filter("digits is not null")
    upto = Window.partitionBy("row", "kind", "k").orderBy("g")
    parts = parts.withColumn("end", F.col("from") + F.sum(F.length("sign") + F.length("digits")).over(upto)).withColumn("start", F.col("end") - F.length("digits"))
    piece = F.struct("sign", "digits", "start", "end")
    ahead = parts.withColumn("ahead", F.collect_list(piece).over(upto.rowsBetween(0, most))).withColumn("last", F.lag(F.concat("sign", "digits")).over(upto))
    # A phone number begins with its cluster's sign; a card number with any group.
    ahead = ahead.filter("kind = 'card' or g = 0").withColumn("first", F.when(F.col("kind") == "phone", F.col("sign")).otherwise(F.lit("")))
    runs = F.transform(F.sequence(F.lit(1), F.least(F.size("ahead"), F.lit(most))), lambda n: F.slice("ahead", 1, n))
    run = ahead.select("*", F.explode(runs).alias("run"))
    text = F.concat(F.col("first"), F.element_at("run", 1)["digits"], F.array_join(F.transform(F.slice("run", 2, most), lambda x: F.concat(x["sign"], x["digits"])), ""))
    following = F.get("ahead", F.size("run"))
    out = run.select(
        "row", "kind", "g", following.alias("following"), text.alias("text"), (F.col("start") - F.length("first")).alias("start"), F.element_at("run", -1)["end"].alias("end"), F.col("before").alias("context"),
        F.when(F.col("g") == 0, F.col("before")).otherwise(F.concat("last", "sign")).alias("before"), F.coalesce(F.concat(following["sign"], following["digits"]), F.col("behind")).alias("behind"),
    )
    n = F.length(_digits(F.col("text")))
    # A cluster as a whole may fail the check of a card's digits, to learn from; parts of it must pass.
    as_card = n.between(*PROPOSED_CARD) & (F.call_function("luhn_check", _digits(F.col("text"))) | ((F.col("g") == 0) & F.col("following").isNull()))
    return out.filter(F.when(F.col("kind") == "card", as_card).otherwise(n.between(*PHONE)))


def proposed(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans, proposals that meet none), both with text, before, behind and context."""
    placed = _placed(hits).withColumn("context", F.col("before"))
    fields = [*SPAN, "text", "before", "behind", "context"]
    narrow = placed.filter("not wide")
    base = narrow.filter(confirmed(F.col("kind"), F.col("text"))).select(*fields)
    refused = narrow.filter(~confirmed(F.col("kind"), F.col("text")))
    stretches = _stretches(narrow.filter(F.col("kind").isin("card", "phone") & ~confirmed(F.col("kind"), F.col("text"))))
    more = placed.filter("wide").select(*fields).unionByName(stretches.select(*fields)).unionByName(refused.filter("kind = 'ip'").select(*fields))
    every = base.withColumn("base", F.lit(True)).unionByName(more.withColumn("base", F.lit(False)).dropDuplicates(SPAN))
    # Of the base spans, the last end among those that start before, and the first start among those behind: both grow along an order.
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(Window.partitionBy("row").orderBy("start", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), "base").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    meets = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    kept = every.withColumn("meets", meets).filter("base or not meets").drop("meets")
    return kept.filter("base").drop("base"), kept.filter("not base").drop("base")


def described(spans: DataFrame) -> tuple[DataFrame, list[str]]:
    """spans with the numbers that the trees see, and the names of these. What tells base spans from all others (the sign
    that their pattern asks for, no digits beside them) isn't among them, or the trees would learn just that."""
    text, digits = F.col("text"), _digits(F.col("text"))
    sizes = F.transform(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), F.length)
    has = lambda sign: F.contains(text, F.lit(sign))
    parts = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    numbers = {
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
        "length": F.length(text), "digits": F.length(digits), "groups": F.size(sizes), "longest": F.array_max(sizes), "shortest": F.array_min(sizes), "last_group": F.get(sizes, F.size(sizes) - 1), "first_group": F.get(sizes, F.lit(0)),
        "luhn": F.call_function("luhn_check", digits), "bytes": F.forall(parts, lambda x: F.coalesce(x.try_cast("decimal(38,0)") <= 255, F.lit(False))),
        "brackets": text.rlike(r"[(\[{]"), "hyphens": has("-"), "dots": has("."), "spaces": has(" "), "gaps": text.rlike(r"[ .-]{2}"),
        "date": text.rlike(r"^(19|20)[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{2}|^[0-9]{2}[ .-][0-9]{2}[ .-](19|20)[0-9]{2}"), "last_label": F.length(F.regexp_extract("text", "([A-Za-z]*)$", 1)),
        "after_letter": F.col("before").rlike(r"\p{L}$"), "before_letter": F.col("behind").rlike(r"^\p{L}"),
        **{f"hint_{k}": F.coalesce(F.col("context").rlike(p), F.lit(False)) for k, p in HINTS.items()},
    }
    return spans.select("*", *(F.coalesce(x.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, x in numbers.items())), [f"f_{n}" for n in numbers]


def _rewritten(spans: DataFrame) -> DataFrame:
    """Base spans as they are and in the forms of REWRITTEN."""

    def form(n: int) -> Column:
        out = F.col("text")
        for kind, forms in REWRITTEN.items():
            changed = reduce(lambda text, x: F.regexp_replace(text, x[0], x[1]), forms[n], F.col("text"))
            out = F.when(F.col("kind") == kind, changed).otherwise(out)
        return out

    return spans.withColumn("text", F.explode(F.array(F.col("text"), *(form(n) for n in range(4)))))


def learnt(base: DataFrame, others: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """(model, features, {kind: threshold}) from all spans; None where there is nothing to learn.

    Spans that look alike (all numbers that the trees see) are one row with their count as its weight. A third of the spans, by
    a hash of kind, text and place, isn't seen by the trees and sets the thresholds. The looks are read by one task, as sums of
    doubles depend on their order.
    """
    labelled = base.withColumn("label", F.lit(1.0)).unionByName(others.withColumn("label", F.lit(0.0)))
    counts = {(r.kind, r.label): r.n for r in labelled.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    taught = [k for k in KINDS if counts.get((k, 1.0), 0) >= LEAST_CONFIRMED and counts.get((k, 0.0), 0)]
    if not taught:
        return None
    drawn = labelled.withColumn("unseen", F.pmod(F.xxhash64("kind", "text", "start", "end"), F.lit(3)) == 0)
    both = _rewritten(drawn.filter("label = 1")).unionByName(drawn.filter("label = 0"))
    numbers, names = described(both)
    looks = ["kind", "label", "unseen", *names]
    small = stored(numbers.groupBy(*looks).agg(F.count(F.lit(1)).cast("double").alias("weight")).coalesce(1).sortWithinPartitions(*looks))
    seen = VectorAssembler(inputCols=names, outputCol="features").transform(small)
    if seen.filter("not unseen").select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.2, seed=1, cacheNodeIds=False, weightCol="weight").fit(seen.filter("not unseen").select("features", "label", "weight"))
    judged = model.transform(seen.filter(F.col("unseen") & F.col("kind").isin(taught))).select("kind", vector_to_array("probability")[1].alias("p"), "label", "weight")
    levels = judged.groupBy("kind", "p").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("right"))
    above = Window.partitionBy("kind").orderBy(F.col("p").desc())  # one row for each probability that the trees give
    precise = levels.select("kind", "p", F.sum("n").over(above).alias("n"), F.sum("right").over(above).alias("right")).filter(F.col("right") >= PRECISION * F.col("n"))
    thresholds = {r.kind: max(r.p, LEAST_THRESHOLD) for r in precise.groupBy("kind").agg(F.min("p").alias("p")).collect()}
    return (model, names, thresholds) if thresholds else None


def _chosen(spans: DataFrame) -> DataFrame:
    """Of spans (row, kind, start, end, p) that overlap, the likeliest first, then the longest; each chain of overlaps is settled on its own."""
    line = Window.partitionBy("row").orderBy("start", "end", "kind")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    chains = spans.withColumn("new", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1))).withColumn("chain", F.sum("new").over(line))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("p"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "kind")))
    listed = chains.groupBy("row", "chain").agg(ordered.alias("spans"))
    none = F.slice("spans", 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    kept = F.aggregate("spans", none, lambda kept, x: F.when(free(kept, x), F.array_append(kept, x)).otherwise(kept))
    return listed.select("row", F.explode(kept).alias("span")).select("row", "span.kind", "span.start", "span.end")


def personal_data(docs: DataFrame, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """The personal data of each whole text.

    docs: doc_id, text (more columns are ignored, whatever their names). Returns per row: doc_id, n_email, n_ip, n_card and n_phone
    (base spans), base_sha256 (of the base spans as `spans` has them), spans: kind:start:end of all spans, base and added, by kind
    as in KINDS, then start, joined by commas; in code points, end exclusive. Null and empty texts have no spans; a null doc_id
    stays null; repeated rows are answered each; an empty table gives an empty result. Very long texts, and clusters of very many
    numbers, take time linear in their length. The trees are fitted to all spans (and the base spans'
    rewritten forms); base spans are found in all rows and don't depend on them.
    """
    kept = stored(scanned(docs))
    hits = kept.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    base, others = (stored(spans) for spans in proposed(hits))
    number = reduce(lambda out, k: F.when(F.col("kind") == KINDS[k], k).otherwise(out), range(len(KINDS)), F.lit(None).cast("int"))
    spans = base.select(*SPAN, F.lit(True).alias("base"))
    if (found := learnt(base, others, trees, depth)) is not None:
        model, names, thresholds = found
        numbers, _ = described(others.filter(F.col("kind").isin(*thresholds)))
        judged = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(numbers)).select(*SPAN, vector_to_array("probability")[1].alias("p"))
        above = judged.filter(reduce(or_, ((F.col("kind") == k) & (F.col("p") >= t) for k, t in thresholds.items())))
        spans = spans.unionByName(_chosen(above).withColumn("base", F.lit(False)))
    written = lambda list_: F.array_join(F.transform(list_, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(number.alias("number"), "start", "end", "kind", "base"))).alias("list"), *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS))
    text = listed.select("row", *(f"n_{k}" for k in KINDS), written(F.filter("list", lambda x: x["base"])).alias("base_spans"), written(F.col("list")).alias("spans"))
    out = kept.select("row", "doc_id").join(text, "row", "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(F.coalesce("base_spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
