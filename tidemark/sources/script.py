"""Tables from a script of CREATE TABLE and INSERT statements: Spark's parser reads them, Spark runs what they insert.

A script runs once in a folder: a marker under the script's hash, written last, lists the tables it has made. Where the marker is,
the tables are read as they were stored; a run that ended before its marker is done again, into paths of its own.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.catalog import Keys

MARKER = "table_name string, path string, primary array<string>, foreign map<string, array<string>>, defaults map<string, string>"
_PIECES = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;|[^;'"`/-]+|.""", re.S)


def statements(script: str) -> list[str]:
    """The statements of a script, cut at the semicolons outside of quotes and comments; comments go."""
    parts = [""]
    for piece in _PIECES.findall(script):
        if piece == ";":
            parts.append("")
        else:
            parts[-1] += " " if piece.startswith(("--", "/*")) else piece
    return [p.strip() for p in parts if p.strip()]


def _each(sequence) -> list:
    return [sequence.apply(k) for k in range(sequence.size())]


class _Declared:
    """What a CREATE TABLE says: columns as (name, type, nullable), and keys."""

    def __init__(self, plan):
        self.columns = [(c.name(), c.dataType().sql(), c.nullable()) for c in _each(plan.columns())]
        defaults = {c.name(): c.defaultValue().get().originalSQL() for c in _each(plan.columns()) if c.defaultValue().isDefined()}
        primary, foreign = (), {}
        for constraint in _each(plan.tableSpec().constraints()):
            kind = constraint.getClass().getSimpleName()
            if kind == "PrimaryKeyConstraint":
                primary = tuple(_each(constraint.columns()))
            elif kind == "ForeignKeyConstraint":
                parents = _each(constraint.parentColumns())
                foreign |= {c: (constraint.parentTableId().mkString("."), p) for c, p in zip(_each(constraint.childColumns()), parents, strict=True)}
            else:
                raise ValueError(f"{kind} isn't supported")
        self.keys = Keys(primary, foreign, defaults)

    def rows(self, name: str, inserted: DataFrame, into: list[str]) -> DataFrame:
        """Inserted rows with the declared columns and types; left-out columns take their default or null, and a null where none may be ends the run."""
        into = into or [c for c, _, _ in self.columns]
        if len(into) != len(inserted.columns) or not set(into) <= {c for c, _, _ in self.columns}:
            raise ValueError(f"an insert into {name} doesn't fit its columns")
        given = inserted.toDF(*into)
        out = []
        for column, kind, nullable in self.columns:
            value = F.col(f"`{column}`") if column in into else F.expr(self.keys.defaults.get(column, "null"))
            value = value.cast(kind)
            if not nullable or column in self.keys.primary:
                value = F.coalesce(value, F.raise_error(F.lit(f"{name}.{column} has no value")).cast(kind))
            out.append(value.alias(column))
        return given.select(*out)


def _run(spark: SparkSession, script: str, base_dir: str) -> list[tuple]:
    parser = spark._jsparkSession.sessionState().sqlParser()
    declared: dict[str, _Declared] = {}
    inserted: dict[str, list[DataFrame]] = defaultdict(list)
    for text in statements(script):
        plan = parser.parsePlan(text)
        kind = plan.getClass().getSimpleName()
        if kind == "CreateTable":
            declared[plan.name().nameParts().mkString(".")] = _Declared(plan)
        elif kind == "InsertIntoStatement" and not plan.overwrite():
            name = plan.table().multipartIdentifier().mkString(".")
            if name not in declared:
                raise ValueError(f"the script inserts into {name} before it creates it")
            jdf = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.query())
            inserted[name].append(declared[name].rows(name, DataFrame(jdf, spark), _each(plan.userSpecifiedCols())))
        else:
            raise ValueError(f"a script creates tables and inserts rows; this does neither: {text[:80]}")
    made = []
    for name, table in declared.items():
        schema = ", ".join(f"`{c}` {kind}" for c, kind, _ in table.columns)
        rows = reduce(DataFrame.unionAll, inserted[name]) if inserted[name] else spark.createDataFrame([], schema)
        path = f"{base_dir}/tables/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        keys = table.keys
        if keys.primary and not spark.read.parquet(path).groupBy(*keys.primary).count().filter("count > 1").isEmpty():
            raise ValueError(f"rows of {name} share a primary key")
        made.append((name, path, list(keys.primary), {c: list(to) for c, to in keys.foreign.items()}, keys.defaults))
    return made


def run_script(spark: SparkSession, script: str, base_dir: str) -> dict[str, tuple[DataFrame, Keys]]:
    """The tables of a script by name, with their keys; the second run of the same script in a folder only reads them.

    Statements are in Spark's SQL. Inserted rows are VALUES or any query over the session's views. Rows are checked for nulls where
    none may be and for primary keys that repeat; foreign keys are declared, not checked. A script without statements has no tables.
    """
    marker = f"{base_dir}/scripts/{hashlib.sha256(script.encode()).hexdigest()}"
    try:
        made = [tuple(r) for r in spark.read.schema(MARKER).parquet(marker).collect()]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        made = []
    if not made and statements(script):  # a marker without rows is one whose writer was lost
        made = _run(spark, script, base_dir)
        spark.createDataFrame(made, MARKER).coalesce(1).write.mode("overwrite").parquet(marker)
    return {name: (spark.read.parquet(path), Keys(tuple(primary), {c: tuple(to) for c, to in foreign.items()}, dict(defaults))) for name, path, primary, foreign, defaults in made}
