"""Text documents that describe each table, for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.catalog import Catalog

SAMPLE_ROWS = 3


def schema_documents(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """(table_name, document): title, columns with their types and marks, foreign keys and sample rows of each table named, or of all."""
    columns = catalog.columns(names)
    mark = F.concat_ws(
        " | ",
        F.format_string("%s (%s)", "column", "type"),
        F.when(F.col("pk"), "PRIMARY KEY"),
        F.when(~F.col("nullable"), "NOT NULL"),
        F.when(F.col("default").isNotNull(), F.concat(F.lit("DEFAULT "), F.col("default"))),
    )
    key = F.when(F.col("fk_table").isNotNull(), F.format_string("- %s references %s.%s", "column", "fk_table", "fk_column"))
    lines = lambda value: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", value.alias("line")))), lambda x: x["line"]), "\n")
    described = columns.groupBy("table").agg(lines(F.concat(F.lit("- "), mark)).alias("columns"), lines(key).alias("keys"), F.concat_ws(", ", F.sort_array(F.collect_list("column"))).alias("names"))
    samples = catalog.samples(SAMPLE_ROWS, names).groupBy("table").agg(F.sort_array(F.collect_list("text")).alias("rows"))
    numbered = F.array_join(F.transform("rows", lambda x, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), x)), "\n")
    document = F.concat_ws(
        "\n",
        F.concat(F.lit("Table: "), F.col("table")),
        F.concat(F.lit("Holds "), F.col("names"), F.lit(".")),
        F.lit("Columns:"),
        F.col("columns"),
        F.lit("Foreign keys:"),
        F.when(F.col("keys") == "", "No foreign keys.").otherwise(F.col("keys")),
        F.lit("Sample rows:"),
        F.coalesce(numbered, F.lit("No rows.")),
    )
    return described.join(samples, "table", "left").select(F.col("table").alias("table_name"), document.alias("document"))
