"""From a question to a typed plan, by rules or by a text model."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

from tidemark.operators.values import Match, normal, phrases
from tidemark.plans.semantics import Semantics

INTENTS = ("aggregation", "comparison", "trend", "detail", "count")
FILTERS = ("time_range", "location", "category", "other")


@dataclass(frozen=True)
class QueryPlan:
    original_query: str
    intent: str = "aggregation"
    metrics: tuple[str, ...] = ()
    filters: dict[str, str | None] = field(default_factory=lambda: dict.fromkeys(FILTERS))
    grouping: str | None = None
    requires_aggregation: bool = True
    requires_comparison: bool = False
    steps: tuple[str, ...] = ()
    parse_error: str | None = None
    #: Our own additions: the table of a list or count, and how many rows of a ranking are wanted.
    entity: str | None = None
    limit: int | None = None
    #: sum, avg, max or min of the metric; whether a ranking begins with the least.
    aggregate: str = "sum"
    ascending: bool = False
    #: Values that were looked up, as (table, column, values): one of the values must hold. Filters only tell of them.
    where: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    #: Two sides to compare, as (name, column's table, column, value) or, of time, (name, "", "", time range).
    sides: tuple[tuple[str, str, str, str], ...] = ()

    def used_filters(self) -> dict[str, str]:
        return {k: v for k, v in self.filters.items() if v and v != "null"}

    def as_dict(self) -> dict[str, Any]:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "parse_error" or v}

    def known(self) -> dict[str, str]:
        """What the plan says, by label."""
        said = {"Intent": self.intent, "Metrics": ", ".join(self.metrics), **{f"Filter ({k})": v for k, v in self.used_filters().items()}, "Grouping": self.grouping, "Steps": "; ".join(self.steps)}
        return {label: value for label, value in said.items() if value}

    def as_text(self) -> str:
        """The plan in lines, for a model that writes SQL."""
        return "\n".join(map(": ".join, self.known().items()))

    def search_text(self) -> str:
        """The text that tables are searched by: the question and what the plan knows of its terms."""
        terms = {label: value for label, value in self.known().items() if label not in ("Intent", "Steps")}
        return " | ".join([self.original_query, *map(": ".join, terms.items())])


class TextModel(Protocol):
    """A language model; an adapter of any provider fits in here."""

    def complete(self, prompt: str, as_json: bool = False) -> str: ...


def fallback(question: str, error: str | None = None) -> QueryPlan:
    """The plan of a question of which nothing is known."""
    return QueryPlan(question, parse_error=error)


def first_json(answer: str) -> Any:
    """The JSON in a model's answer: without fences, the first object that parses, else the first list; raises ValueError."""
    text = re.sub(r"(?i)```\s*(json)?", "", answer).strip()
    decoder = json.JSONDecoder()
    for opening in "{[":
        for at in (m.start() for m in re.finditer(re.escape(opening), text)):
            try:
                return decoder.raw_decode(text, at)[0]
            except json.JSONDecodeError:
                continue
    raise ValueError("the answer holds no JSON")


def parsed(question: str, answer: str) -> QueryPlan:
    """A plan from a model's answer; the fallback plan if it can't be read."""
    try:
        found = first_json(answer)
        if not isinstance(found, dict):
            raise ValueError("the answer isn't an object")
    except ValueError as error:
        return fallback(question, str(error))
    filters = found.get("filters") if isinstance(found.get("filters"), dict) else {}
    intent = found.get("intent")
    text = lambda v: str(v) if v not in (None, "", "null") else None
    return QueryPlan(
        question,
        intent if intent in INTENTS else "aggregation",
        tuple(map(str, found.get("metrics") or ())),
        {k: text(filters.get(k)) for k in FILTERS},
        text(found.get("grouping")),
        bool(found.get("requires_aggregation", True)),
        bool(found.get("requires_comparison", False)),
        tuple(map(str, found.get("steps") or ())),
    )


#: Names of months, as questions have them.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = rf"(?:{'|'.join(MONTHS)})(?: (?:19|20)\d\d)?"
_TIMES = (r"last month", r"this month", r"last year", r"this year", r"(?:last|past) \d+ (?:days|months|years)", rf"(?<=in ){_MONTH}", rf"(?<=for ){_MONTH}")
_AGGREGATES = {"average": "avg", "mean": "avg", "highest": "max", "maximum": "max", "lowest": "min", "minimum": "min"}
#: Words that say nothing of their own in a question.
_PLAIN = frozenset(
    "a all an are by category compare did do does each every find for from get give have how in is list many me much my number of our per please product show total the their there to us was we were what which who with".split()
)


class Values(Protocol):
    """What tells of which columns words are values."""

    def lookup(self, terms: Iterable[str]) -> list[Match]: ...

    def near(self, term: str) -> list[str]: ...


#: Words of a value at most.
LONGEST_VALUE = 5


class _Words:
    """A question of which the parts that are understood are taken out one by one."""

    def __init__(self, question: str):
        self.text = f" {re.sub(r'[^\w\s-]', ' ', question.lower())} "

    def take(self, *patterns: str) -> str | None:
        """The first match of the first pattern that has one; all its matches go."""
        for pattern in patterns:
            if found := re.search(rf"(?<![\w-])(?:{pattern})(?![\w-])", self.text):
                self.text = re.sub(rf"(?<![\w-]){re.escape(found.group())}(?![\w-])", " ", self.text)
                return found.group()
        return None

    def take_any(self, words: Iterable[str]) -> bool:
        return any([self.take(re.escape(w)) for w in sorted(words, key=len, reverse=True)])

    def left(self) -> list[str]:
        return [w for w in self.text.split() if w not in _PLAIN]


def _looked_up(words: _Words, semantics: Semantics, values: Values) -> dict[str, list[Match]]:
    """{phrase: matches} of the question's words that are values, longest first; they are taken out of the words."""
    known = {w for m in semantics.metrics for t in m.words for w in t.split()} | {w for d in semantics.dimensions for t in d.words for w in t.split()} | {w for e in semantics.entities for w in e.split()}
    asked = phrases(normal(words.text).split(), LONGEST_VALUE, lambda w: w in _PLAIN or w in known or w in MONTHS)
    asked = [p for p in asked if not p.replace(" ", "").isdigit()]
    found: dict[str, list[Match]] = {}
    for match in values.lookup(asked):
        found.setdefault(match.term, []).append(match)
    out = {}
    for phrase in asked:
        if phrase in found and words.take(r"[\W_]+".join(map(re.escape, phrase.split()))):
            out[phrase] = found[phrase]
    if len(out) > 1:
        words.take_any(("and", "or"))
    return out


def _meant(phrase: str, matches: list[Match], table: str, semantics: Semantics) -> tuple[str, str]:
    """The (table, column) whose value a phrase is: the place of what is asked for, the category, else the only one."""
    columns = list(dict.fromkeys((m.table, m.column) for m in matches))
    preferred = [c for c in (semantics.places.get(table), semantics.categories) if c in columns]
    # Places of other tables aren't meant by a question about this one.
    left = preferred[:1] or [c for c in columns if c not in semantics.places.values()] or columns
    if len(left) > 1:
        raise ValueError(f"not understood: {phrase} is a value of {' and of '.join('.'.join(c) for c in left)}")
    return left[0]


_PERIOD = "|".join(_TIMES[:4])


def planned(question: str, semantics: Semantics, values: Values | None = None) -> QueryPlan:
    """A plan by rules; the same question always gives the same plan. Raises ValueError with what isn't understood.

    values: looks up which column a place, a category or any other value in the question belongs to. Without it, a capitalised
    word behind `from` or `in` is taken for a place, and one behind `category` for a category.
    """
    words = _Words(question)
    place = category = None
    if values is None:
        month = rf"(?i:{'|'.join(MONTHS)})\b"
        place = re.search(rf"\b(?:from|in)\s+(?!{month})([A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)*)", question)
        category = re.search(r"\b(?:category|in the)\s+([A-Z][\w'-]*)", question)
        for found in (place, category):
            if found:
                words.take(re.escape(re.sub(r"[^\w\s-]", " ", found.group(1).lower())))

    periods = re.search(rf"(?<![\w-])({_PERIOD}) (?:against|versus|vs|with|and|to) ({_PERIOD})(?![\w-])", words.text)
    if periods:
        words.take(re.escape(periods.group()))
    time = words.take(*_TIMES) or (year[-4:] if (year := words.take(r"(?:for|in|during|of) (?:19|20)\d\d")) else None)
    looked_up = _looked_up(words, semantics, values) if values is not None else {}
    top = words.take(r"top \d+", r"bottom \d+")
    trend = words.take_any(("over time", "by month", "per month", "trend", "monthly"))
    aggregate = next((how for word, how in _AGGREGATES.items() if words.take(word)), "sum")
    ranked = bool(top) or bool(re.search(r"\b(best selling|most sold)\b", words.text))
    metric = next((m.name for m in semantics.metrics if words.take_any(m.words)), None)
    grouped = next((d.name for d in semantics.dimensions if words.take(*(rf"(?:by|per) {re.escape(w)}" for w in d.words))), None)
    if ranked and grouped is None:
        grouped = next((d.name for d in semantics.dimensions if words.take_any(d.words)), None)
    compared = words.take_any(("versus", "vs", "against", "compare", "compared")) or bool(periods)
    counted = bool(words.take("how many", "number of"))
    entity = None
    if counted or metric is None:
        entity = next((table for word, table in semantics.entities.items() if words.take(re.escape(word))), None)
    if left := words.left():
        hints = [f"{w} (like {', '.join(near)}?)" if values is not None and (near := values.near(w)) else w for w in left]
        raise ValueError(f"not understood: {', '.join(hints)}")
    if counted and metric == "units" and entity is None:
        counted = False  # how many units: their sum
    if counted and metric is not None:
        raise ValueError(f"not understood: a count of rows together with {metric}")
    if counted and entity is None:
        raise ValueError("not understood: of what to count")
    if metric is None and (entity is None or ranked or trend or (grouped and not counted)):
        raise ValueError(f"not understood: no measure; known: {', '.join(m.name for m in semantics.metrics)}")

    table = semantics.metric(metric).table if metric else entity
    by_column: dict[tuple[str, str], list[str]] = {}
    for phrase, matches in looked_up.items():
        column = _meant(phrase, matches, table, semantics)
        by_column.setdefault(column, []).append(next(m.value for m in matches if (m.table, m.column) == column))
    order = {v.lower(): k for k, v in enumerate(sorted((v for vs in by_column.values() for v in vs), key=lambda v: normal(question).find(normal(v))))}
    by_column = {c: sorted(vs, key=lambda v: order[v.lower()]) for c, vs in by_column.items()}
    sides: tuple[tuple[str, str, str, str], ...] = ()
    if compared:
        several = [c for c, vs in by_column.items() if len(vs) == 2]
        if periods and not several:
            sides = tuple((p, "", "", p) for p in periods.groups())
        elif len(several) == 1 and not periods:
            sides = tuple((v, *several[0], v) for v in by_column.pop(several[0]))
        if not sides or metric is None or trend or ranked or grouped:
            raise ValueError("not understood: what to compare; two values of one column or two periods, and a measure")
    where = tuple((*c, tuple(vs)) for c, vs in by_column.items())

    if trend:
        intent, grouped = "trend", "month"
    elif counted:
        intent = "count"
    elif metric is None:
        intent = "detail"
    else:
        intent = "comparison" if ranked or compared else "aggregation"
    metrics = () if intent in ("detail", "count") else (metric,)
    filters = dict.fromkeys(FILTERS) | {"time_range": time, "location": place.group(1) if place else None, "category": category.group(1) if category else None}
    for t, c, vs in where:
        slot = "location" if (t, c) in semantics.places.values() else "category" if (t, c) == semantics.categories else "other"
        text = " or ".join(vs) if slot != "other" else f"{t}.{c} = {' or '.join(vs)}"
        filters[slot] = text if filters[slot] is None else f"{filters[slot]}, {text}"
    steps = [f"filter by {k}: {v}" for k, v in filters.items() if v]
    steps += [f"{aggregate} of {m}" for m in metrics] + ([f"group by {grouped}"] if grouped else []) + (["rank"] if ranked else []) + ([f"compare {' and '.join(s[0] for s in sides)}"] if sides else [])
    return QueryPlan(
        question, intent, metrics, filters, grouped if intent != "detail" else None, intent != "detail", ranked or intent == "comparison", tuple(steps),
        entity=entity if intent in ("detail", "count") else None, limit=int(top.split()[1]) if top else None, aggregate=aggregate, ascending=bool(top) and top.startswith("bottom"), where=where, sides=sides,
    )


def time_range(text: str, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """The half-open range of days [start, end) that a time range means on a day."""
    month = as_of.replace(day=1)
    if text == "last month":
        return _months_before(month, 1), month
    if text == "this month":
        return month, _months_before(month, -1)
    if text == "this year":
        return dt.date(as_of.year, 1, 1), dt.date(as_of.year + 1, 1, 1)
    if text == "last year":
        return dt.date(as_of.year - 1, 1, 1), dt.date(as_of.year, 1, 1)
    if re.fullmatch(r"\d{4}", text):
        return dt.date(int(text), 1, 1), dt.date(int(text) + 1, 1, 1)
    if (words := text.split())[0] in MONTHS:
        number = MONTHS.index(words[0]) + 1
        year = int(words[1]) if len(words) > 1 else as_of.year - (number > as_of.month)  # the last one that has begun
        start = dt.date(year, number, 1)
        return start, _months_before(start, -1)
    if found := re.fullmatch(r"(?:last|past) (\d+) (days|months|years)", text):
        n, unit = int(found[1]), found[2]
        if unit == "days":
            return as_of - dt.timedelta(days=n), as_of
        return _months_before(month, n * (12 if unit == "years" else 1)), month
    raise ValueError(f"unknown time range: {text}")


def _months_before(month: dt.date, n: int) -> dt.date:
    year, zero = divmod(month.year * 12 + month.month - 1 - n, 12)
    return dt.date(year, zero + 1, 1)
