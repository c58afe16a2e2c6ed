"""Running a query with a bounded result."""

from __future__ import annotations

import datetime as dt
import math
import time
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tidemark.sources.csv import column_names

MAX_ROWS = 500


@dataclass
class Result:
    success: bool
    columns: list[str] = field(default_factory=list)
    rows: list[dict[str, Any]] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    execution_time_ms: float = 0.0
    error: str | None = None


def capped(df: DataFrame, cap: int = MAX_ROWS) -> DataFrame:
    """The first rows of a query in its order, under distinct names."""
    return df.toDF(*column_names(df.columns)).limit(cap)


def execute(df: DataFrame, cap: int = MAX_ROWS) -> Result:
    """At most `cap` rows as dictionaries, and whether there were more; errors are part of the result."""
    began = time.perf_counter()
    elapsed = lambda: round((time.perf_counter() - began) * 1000, 2)
    try:
        found = capped(df, cap + 1)
        rows = [r.asDict() for r in found.collect()]
    except PySparkException as error:
        return Result(False, execution_time_ms=elapsed(), error=str(error))
    return Result(True, found.columns, rows[:cap], len(rows[:cap]), len(rows) > cap, elapsed())


def json_value(value: Any) -> Any:
    """A value as JSON has it: whole decimals as integers, others as floats, dates and times as ISO texts, bytes as hex."""
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, (dt.date, dt.time)):
        return value.isoformat()
    if isinstance(value, dt.timedelta):
        return value.total_seconds()
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    return [json_value(v) for v in value] if isinstance(value, (list, tuple)) else value


def as_text(result: Result, rows: int = 20) -> str:
    """Rows as lines of text, with a note of those left out."""
    lines = [f"Row {k}: " + " | ".join(f"{c}: {v}" for c, v in row.items()) for k, row in enumerate(result.rows[:rows], 1)]
    if result.row_count > rows:
        lines.append(f"... and {result.row_count - rows} more rows (truncated)")
    return "\n".join(lines)
