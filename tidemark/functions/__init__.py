"""Column functions for presentation: cells, axis numbers, labels; and text helpers for SQL and insights."""

from __future__ import annotations

import math
import re
from fractions import Fraction
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names as they begin a label.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_TIME_LABEL = rf"^(\d{{4}}[-/]|({'|'.join(f'{m[:3]}|{m}' for m in MONTHS)}|Sept)\b)"
#: Clauses that begin a line of printed SQL.
CLAUSES = ("FROM", "WHERE", "GROUP BY", "ORDER BY", "HAVING", "LIMIT", "LEFT JOIN")


def cell(value: Column, kind: str) -> Column:
    """A table cell as text: null as -, numbers with separators, all else as it is."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        text = F.format_number(value, 0)
    elif kind in ("float", "double") or kind.startswith("decimal"):
        text = F.regexp_replace(F.regexp_replace(F.format_number(value.cast("double"), 3), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("-"))


def _tenth(k: int) -> float:
    """The least double that is nearer to (k + 1) / 10 than to k / 10, or as near."""
    middle = Fraction(2 * k + 1, 20)
    return float(middle) if Fraction(float(middle)) >= middle else math.nextafter(float(middle), math.inf)


def one_digit(value: Column) -> Column:
    """A number from 0 on with one digit behind the point: the digit nearest to the double itself, the larger of two equally near."""
    whole = F.floor(value)
    tenths = whole * 10 + reduce(add, ((value - whole >= _tenth(k)).cast("long") for k in range(10)))
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def axis_number(value: Column) -> Column:
    """Millions and thousands of an axis with one digit and a letter."""
    v = value.cast("double")
    short = lambda by, unit: F.concat(one_digit(v / by), F.lit(unit))
    plain = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "K")).otherwise(plain)


def is_time_label(label: Column) -> Column:
    """Labels that begin with a year and a separator, or with the name of a month (a word like Market is none)."""
    return label.cast("string").rlike(_TIME_LABEL)


def chart_value(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def highlights(text: Column) -> Column:
    """The amounts of money and the percentages in a text."""
    return F.regexp_extract_all(text, F.lit(r"([$€£₹]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?%)"), 1)


def pretty_sql(sql: str) -> str:
    """SQL with each clause on a line of its own."""
    pattern = "|".join(c.replace(" ", r"\s+") for c in sorted(CLAUSES, key=len, reverse=True))
    return re.sub(rf"\s+({pattern})\b", r"\n\1", sql, flags=re.IGNORECASE)
