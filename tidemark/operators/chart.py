"""What chart suits a result, from its schema and labels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import chart_value, is_time_label

SLICES = 6


def chart_spec(df: DataFrame, intent: str | None = None) -> dict[str, Any] | None:
    """Label and value columns and the kind of chart; None if nothing can be drawn. df: a result, of bounded size."""
    if not df.columns:
        return None
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    label = next((f.name for f in df.schema if f.name not in numeric), df.columns[0])
    values = [c for c in numeric if c != label]
    if not values:
        return None
    timed = isinstance(df.schema[label].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    rows, times = df.agg(F.count(F.lit(1)), F.coalesce(F.bool_or(is_time_label(F.col(f"`{label}`"))), F.lit(False))).first()
    if not rows:
        return None
    kind = "line" if timed or times or intent == "trend" else "doughnut" if rows <= SLICES and len(values) == 1 else "bar"
    return {"type": kind, "label": label, "values": values}


def chart_series(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Labels as text and values as numbers, 0 where there is none."""
    return df.select(F.col(f"`{spec['label']}`").cast("string").alias(spec["label"]), *(chart_value(F.col(f"`{c}`")).alias(c) for c in spec["values"]))
