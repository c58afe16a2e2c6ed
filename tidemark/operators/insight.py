"""Facts about a result, as a DataFrame, and the sentences made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ROWS = "The query returned no rows, so there is nothing to report."


def facts(df: DataFrame, label: str, value: str, order: str | None = None) -> DataFrame:
    """One row: row count, sum, mean, least and greatest value with their labels, the greatest's share, and the change
    from the first to the last value in `order`."""
    v, name = F.col(value).cast("double"), F.col(label).cast("string")
    total = F.sum(v)
    along = F.col(order or label)
    first, last = F.min_by(v, along), F.max_by(v, along)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        total.alias("total"),
        F.avg(v).alias("mean"),
        F.min(v).alias("least"),
        F.min_by(name, F.struct(v, name)).alias("least_label"),
        F.max(v).alias("greatest"),
        F.max_by(name, F.struct(v, name)).alias("greatest_label"),
        F.try_divide(F.max(v) * 100, total).alias("greatest_share"),
        F.try_divide((last - first) * 100, first).alias("change_percent"),
    )


def insight(df: DataFrame, label: str | None, value: str | None, trend: bool = False) -> str:
    """Two to four sentences on a result."""
    if df.isEmpty():
        return NO_ROWS
    if value is None:
        return f"The query returned {df.count():,} rows."
    if label is None:
        only = df.select(F.sum(F.col(value).cast("double"))).first()[0]
        return f"The value of {value} is {only:,.2f}." if only is not None else f"The value of {value} is empty."
    f = facts(df, label, value).first()
    if f.total is None:
        return f"The query returned {f.row_count:,} rows without values of {value}."
    out = [f"There are {f.row_count:,} rows with a total {value} of {f.total:,.2f}.", f"The highest is {f.greatest_label} with {f.greatest:,.2f}" + (f" ({f.greatest_share:.1f}% of the total)." if f.greatest_share is not None else ".")]
    if f.row_count > 1:
        out.append(f"The lowest is {f.least_label} with {f.least:,.2f}.")
    if trend and f.change_percent is not None:
        out.append(f"From first to last the change is {f.change_percent:+.1f}%.")
    return " ".join(out)
