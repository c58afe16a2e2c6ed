"""CSV files become typed tables: header and types are worked out here, reading and casting are Spark's."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens that stand for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
_EXTRA = "__more__"


def table_name(file: str) -> str:
    """A table's name from its file's: the stem in lower case, all but letters, digits and _ as _."""
    stem = re.split(r"[/\\]", file)[-1].rsplit(".", 1)[0].lower()
    name = re.sub(r"[^a-z0-9_]", "_", stem) or "t"
    return f"t_{name}" if name[0].isdigit() else name


def column_names(header: list[str | None]) -> list[str]:
    """Distinct names in any case: missing ones by place, repeated ones with a number."""
    out: list[str] = []
    seen: set[str] = set()
    for k, name in enumerate(header):
        base = name = (name or "").strip().lstrip("﻿") or f"unnamed_{k}"
        n = 1
        while name.lower() in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def layout_of(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether a quoted value has a line break), from one pass over the lines.

    UTF-8, unless some line isn't valid UTF-8; ISO-8859-1 then, which reads any byte. A quoted line break leaves a line with an
    odd number of quotes.
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    bad, broken = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8("value")), F.bool_or(odd)).first()
    return "ISO-8859-1" if bad else "UTF-8", bool(broken)


def _reader(spark: SparkSession, encoding: str, lines: bool):
    """lines: rows may go over several lines, for which a file is read by one task; else a large file is read by many."""
    return spark.read.options(multiLine=lines, escape='"', ignoreLeadingWhiteSpace=True, encoding=encoding, mode="PERMISSIVE")


#: Types in the order they are tried; each with a test of a non-null text.
_KINDS: list[tuple[str, str]] = [
    ("boolean", r"^(?i)(true|false)$"),
    ("bigint", r"^[+-]?\d{1,18}$"),
    ("decimal(38,0)", r"^[+-]?\d{1,38}$"),
    ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i)inf(inity)?$"),
    ("date", r"^\d{4}-\d{2}-\d{2}$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"),
]


def _fits(column: Column, kind: str, pattern: str) -> Column:
    return column.rlike(pattern) & column.try_cast(kind).isNotNull()


def inferred(df: DataFrame, *tests: Column) -> tuple[DataFrame, tuple]:
    """df with text columns cast to the first type that fits all their values, and the values of more aggregates; one pass over df."""
    found_by = []
    for k, c in enumerate(df.columns):
        column = F.col(f"`{c}`")
        found_by.append(F.count(column).alias(f"n{k}"))
        found_by += [F.count_if(_fits(column, kind, pattern)).alias(f"n{k}_{j}") for j, (kind, pattern) in enumerate(_KINDS)]
    found = df.agg(*found_by, *tests).first()
    out = []
    for k, c in enumerate(df.columns):
        kind = next((kind for j, (kind, _) in enumerate(_KINDS) if found[f"n{k}"] and found[f"n{k}_{j}"] == found[f"n{k}"]), "string")
        out.append(F.col(f"`{c}`").try_cast(kind).alias(c))
    return df.select(*out), tuple(found)[len(found_by) :]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header as a typed table.

    Short rows are filled up with nulls; a row longer than the header, and a file without a header, raise ValueError, as does a path that doesn't end in .csv.
    """
    if not path.endswith(".csv"):
        raise ValueError("only .csv files can be uploaded")
    reader = _reader(spark, *layout_of(spark, path))
    first = reader.csv(path).head(1)
    if not first:
        raise ValueError("the file is empty")
    names = column_names(list(first[0]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _EXTRA]])
    raw = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    texts = [F.when(~F.col(f"`{n}`").isin(*MISSING), F.col(f"`{n}`")).alias(n) for n in names]
    table, (longer,) = inferred(raw.select(*texts, _EXTRA), F.count(_EXTRA))
    if longer:
        raise ValueError("a row has more fields than the header")
    return table.drop(_EXTRA)


def replace_table(df: DataFrame, name: str, base_dir: str) -> DataFrame:
    """Write df as Parquet under base_dir and put the view `name` on it; what reads the old version isn't disturbed."""
    path = f"{base_dir}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.createOrReplaceTempView(name)
    return table
