"""The members of JSON texts as rows: one level, or all levels with their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: JSON nested deeper than this is refused, as Spark's recursion is.
DEEPEST = 100


def _kind(value: Column) -> Column:
    """object, array, integer, real, text, true, false or null, as SQLite names them."""
    schema = F.schema_of_variant(value)
    scalar = F.when(schema == "BOOLEAN", value.cast("boolean").cast("string")).when(schema == "STRING", "text").when(schema == "VOID", "null").when(schema == "BIGINT", "integer")
    return F.when(schema.startswith("OBJECT"), "object").when(schema.startswith("ARRAY"), "array").otherwise(scalar.otherwise("real"))


def _members(df: DataFrame, value: str) -> DataFrame:
    """df with pos, key and value of each member of a column of variants."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode(F.col(value).outer()))


def _described(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in columns), *more, F.to_json("value").alias("value"), _kind(F.col("value")).alias("type"))


def json_each(df: DataFrame, column: str) -> DataFrame:
    """df once for each member of the outermost object or array of a JSON text, with key (an array's: null), pos, value and type.

    Values are JSON texts. Null texts and scalars have no member; a text that isn't JSON raises an error.
    """
    parsed = df.withColumn("json__", F.parse_json(F.col(f"`{column}`")))
    members = _members(parsed, "json__").withColumn("key", F.when(~_kind(F.col("json__")).eqNullSafe("array"), F.col("key")))
    return _described(members, df.columns, "key", "pos")


def json_tree(df: DataFrame, column: str) -> DataFrame:
    """df once for the JSON text itself and for each value within it, with path ($.a.b[0]), depth, value and type.

    Level follows level while there are objects or arrays; each is a projection of the one before, without a shuffle. Null texts
    have no row; JSON deeper than DEEPEST raises ValueError.
    """
    level = df.withColumn("value", F.parse_json(F.col(f"`{column}`"))).filter("value is not null").withColumn("path", F.lit("$")).withColumn("depth", F.lit(0))
    keep = [*df.columns, "path", "depth", "value"]
    out = level.select(*(F.col(f"`{c}`") for c in keep))
    for depth in range(1, DEEPEST + 2):
        inner = level.filter(_kind(F.col("value")).isin("object", "array")).withColumnRenamed("value", "outer__")
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), F.col("key")))
        level = _members(inner, "outer__").withColumn("path", F.concat("path", step)).withColumn("depth", F.lit(depth)).select(*(F.col(f"`{c}`") for c in keep))
        if level.isEmpty():
            return _described(out, df.columns, "path", "depth")
        if depth > DEEPEST:
            break
        out = out.unionByName(level)
    raise ValueError(f"the JSON is nested deeper than {DEEPEST} levels")
