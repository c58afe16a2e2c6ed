"""What the engine knows of its tables: columns, keys and samples, as DataFrames."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "table string, ordinal int, column string, type string, pk boolean, nullable boolean, default string, fk_table string, fk_column string"


@dataclass(frozen=True)
class Keys:
    """Keys and defaults of one table, which Spark's schemas don't hold."""

    primary: tuple[str, ...] = ()
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)


class Catalog:
    """The views of a session that belong to the engine."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.keys: dict[str, Keys] = {}
        self.versions: dict[str, str] = {}

    def register(self, name: str, df: DataFrame, keys: Keys | None = None, version: str = "") -> None:
        df.createOrReplaceTempView(name)
        self.versions[name] = version
        self.keys[name] = keys or Keys()

    def tables(self) -> list[str]:
        return sorted(self.keys)

    def foreign_keys(self, name: str) -> list[tuple[str, str, str]]:
        """(column, table, column) of each foreign key."""
        return [(c, *target) for c, target in sorted(self.keys[name].foreign.items())]

    def _rows(self, name: str) -> list[tuple]:
        keys = self.keys[name]
        out = []
        for k, f in enumerate(self.spark.table(name).schema):
            to = keys.foreign.get(f.name, (None, None))
            out.append((name, k, f.name, f.dataType.simpleString(), f.name in keys.primary, f.nullable and f.name not in keys.primary, keys.defaults.get(f.name), *to))
        return out

    def describe(self, name: str) -> DataFrame:
        """The columns of a table in their order."""
        return self.spark.createDataFrame(self._rows(name), COLUMNS)

    def columns(self, names: list[str] | None = None) -> DataFrame:
        """The columns of the tables named, or of all."""
        return self.spark.createDataFrame([r for name in names or self.tables() for r in self._rows(name)], COLUMNS)

    def sample(self, name: str, rows: int = 3) -> DataFrame:
        """(text): the rows of a table with the least hashes, as text; the same rows however the table is stored or read."""
        table = self.spark.table(name)
        pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL"))) for c in table.columns]
        return table.select(F.concat_ws(", ", *pairs).alias("text")).orderBy(F.md5(F.col("text").cast("binary")), "text").limit(rows)

    def fingerprints(self) -> dict[str, str]:
        """For each table a text that changes whenever its version, a column, a type or a key of it does."""
        return {name: hashlib.sha256(repr((self.versions.get(name, ""), self._rows(name))).encode()).hexdigest() for name in self.tables()}

    def samples(self, rows: int = 3, names: list[str] | None = None) -> DataFrame:
        """(table, text) of a sample of each table named, or of all."""
        parts = []
        for name in names or self.tables():
            parts.append(self.sample(name, rows).select(F.lit(name).alias("table"), "text"))
        if not parts:
            return self.spark.createDataFrame([], "table string, text string")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
