"""Primary and foreign keys that the tables' own rows show, for tables that come without any, such as uploads.

One pass over a table sketches its columns: counts, least and greatest value, and a HyperLogLog sketch of the distinct values. The
sketches merge, so the union of two columns tells whether one can lie within the other. Few pairs pass, and only these are
confirmed on the rows: a key has no value twice, and a foreign key's column has no value that the key lacks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.catalog import Keys

#: What the union's estimate may exceed the key's by: several times the sketches' error of about 1.6 percent.
TOLERANCE = 1.1
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Sketch:
    table: str
    column: str
    ordinal: int
    whole: bool
    rows: int
    filled: int
    distinct: int
    least: str | None
    greatest: str | None
    sketch: bytes | None


def sketched(name: str, df: DataFrame) -> list[Sketch]:
    """Of each column of whole numbers or text, what its values are like; one pass."""
    columns = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema) if f.dataType.simpleString() in (*_WHOLE, "string")]
    if not columns:
        return []
    parts = []
    for k, c, kind in columns:
        value = F.col(f"`{c}`").cast("bigint") if kind in _WHOLE else F.col(f"`{c}`")
        sketch = F.hll_sketch_agg(value)
        parts += [F.count(value).alias(f"n{k}"), F.hll_sketch_estimate(sketch).alias(f"d{k}"), F.min(value).alias(f"lo{k}"), F.max(value).alias(f"hi{k}"), sketch.alias(f"s{k}")]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *parts).first()
    return [Sketch(name, c, k, kind in _WHOLE, found["rows"], found[f"n{k}"], found[f"d{k}"], found[f"lo{k}"], found[f"hi{k}"], found[f"s{k}"]) for k, c, kind in columns]


def base_name(column: str) -> str:
    """A column's name without its table's prefix of one or two letters, in lower case."""
    return re.sub(r"^[a-z]{1,2}_", "", column.lower())


def _unique(df: DataFrame, column: str) -> bool:
    return df.groupBy(F.col(f"`{column}`")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def _within(one: Sketch, key: Sketch, spark) -> bool:
    """Whether a column's values can all be the key's, by what the sketches say."""
    if one.whole != key.whole or not one.filled or one.least < key.least or one.greatest > key.greatest:
        return False
    merged = F.hll_sketch_estimate(F.hll_union(F.lit(one.sketch), F.lit(key.sketch)))
    return spark.range(1).select(merged.alias("n")).first().n <= TOLERANCE * key.distinct


def discovered(frames: dict[str, DataFrame], known: dict[str, list[Sketch]] | None = None) -> dict[str, Keys]:
    """{table: keys}: a table's primary key is its first column of distinct values without nulls; a foreign key has the name of
    another table's primary key, but for a prefix, and no value that this lacks (nulls aside). Empty tables have no keys. known: sketches of tables that needn't be
    sketched again; those made now are added to it."""
    sketches = {} if known is None else known
    for name in frames.keys() - sketches.keys():
        sketches[name] = sketched(name, frames[name])
    sketches = {name: sketches[name] for name in frames}
    primary: dict[str, Sketch] = {}
    for name, columns in sketches.items():
        likely = (s for s in columns if s.rows and s.filled == s.rows and s.distinct * TOLERANCE >= s.rows)
        if (key := next((s for s in likely if _unique(frames[name], s.column)), None)) is not None:
            primary[name] = key
    foreign: dict[str, dict[str, tuple[str, str]]] = {name: {} for name in frames}
    for name, columns in sketches.items():
        for s in columns:
            for key in primary.values():
                named = base_name(s.column) == base_name(key.column) and key.table != name
                if named and s.column not in foreign[name] and _within(s, key, frames[name].sparkSession):
                    lacking = frames[name].filter(F.col(f"`{s.column}`").isNotNull()).select(F.col(f"`{s.column}`").alias("of")).join(frames[key.table].select(F.col(f"`{key.column}`").alias("key")), F.col("of") == F.col("key"), "left_anti")
                    if lacking.isEmpty():
                        foreign[name][s.column] = (key.table, key.column)
    return {name: Keys((primary[name].column,) if name in primary else (), foreign[name]) for name in frames}
