"""The guard's accept and reject matrix, CSV ingest, and the presentation operators."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import axis_number, cell, is_time_label, pretty_sql
from tidemark.operators.chart import chart_series, chart_spec
from tidemark.operators.execute import as_text, capped, execute
from tidemark.operators.insight import NO_ROWS, insight
from tidemark.operators.values import indexed_values
from tidemark.plans.guard import ValidationError, cleaned, validate
from tidemark.sources.catalog import Catalog
from tidemark.sources.csv import column_names, read_csv, table_name
from tidemark.sources.keys import discovered


@pytest.fixture(scope="module")
def known(spark):
    spark.createDataFrame([(1, "x", "2024-01-01")], "id long, updated_at string, `create` string").createOrReplaceTempView("guarded")
    spark.createDataFrame([(7,)], "id long").createOrReplaceTempView("hidden")
    return ["guarded"]


ACCEPTED = [
    "SELECT * FROM guarded",
    "SELECT * FROM Guarded;",
    "SELECT 'a; Update b' AS s, `create` FROM guarded -- c",
    "SELECT updated_at FROM guarded /* drop */",
    "SELECT id FROM (SELECT id FROM guarded) WHERE id IN (SELECT id FROM guarded) AND EXISTS (SELECT 1 FROM guarded)",
    "SELECT extract(YEAR FROM DATE '2024-01-01') AS y, trim(' ' FROM updated_at) AS t FROM guarded WHERE id IS DISTINCT FROM 2",
    "SELECT repeat('-', 3) AS a, lpad('x', 5, '0') AS b, format_string('%5d|%s', id, 'x') AS c, hex(id) AS d FROM guarded",
    "SELECT sum(id) OVER w AS s FROM guarded WINDOW w AS (ORDER BY id) UNION ALL SELECT 1 LIMIT 3",
]
DEFAULT_ONLY = [
    "SELECT x.key, variant_get(x.value, '$', 'int') AS v FROM guarded, LATERAL variant_explode(parse_json(updated_at)) AS x",
    "WITH RECURSIVE t(v, d) AS (SELECT parse_json(updated_at), 0 FROM guarded UNION ALL SELECT x.value, d + 1 FROM t, LATERAL variant_explode(t.v) AS x) SELECT d, to_json(v) AS v FROM t",
    "WITH c AS (SELECT id FROM guarded) SELECT * FROM c", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 3) SELECT n FROM c JOIN guarded", "WITH guarded AS (SELECT id FROM guarded) SELECT * FROM guarded", "(SELECT id FROM guarded)", "FROM guarded SELECT id", "TABLE guarded"]
REJECTED = {
    "security": [
        "INSERT INTO guarded SELECT * FROM guarded", "UPDATE guarded SET id = 1", "DELETE FROM guarded", "DROP TABLE guarded", "ALTER TABLE guarded ADD COLUMNS (x INT)", "CREATE TABLE x AS SELECT 1", "TRUNCATE TABLE guarded",
        "SELECT 1; SELECT 2", "VALUES (1)", "EXPLAIN SELECT 1", "SHOW TABLES", "DESCRIBE guarded", "SET x = 1", "CACHE TABLE guarded", "SELECT reflect('java.lang.System', 'exit', 1)",
        "SELECT TRANSFORM (id) USING 'cat' AS (x) FROM guarded", "SELECT java_method('java.lang.Math', 'random')", "SELECT input_file_name() FROM guarded", "SELECT * FROM range(5)", "SELECT explode(array(1)) FROM guarded",
        "SELECT id FROM guarded WHERE id = (SELECT max(reflect('a', 'b')) FROM guarded)",
        "SELECT repeat('x', 2000000000) FROM guarded", "SELECT lpad('x', id, 'y') FROM guarded", "SELECT rpad('x', 99999) FROM guarded", "SELECT printf('%2000000000d', 1) FROM guarded", "SELECT format_string(updated_at, 1) FROM guarded",
        "SELECT replace(repeat('a', 10000), 'a', repeat('b', 10000)) FROM guarded", "SELECT regexp_replace(repeat('a', 9000), 'a', repeat('b', 9000)) FROM guarded", "SELECT replace(x, 'a', y) FROM (SELECT repeat('a', 9000) AS x, repeat('b', 9000) AS y FROM guarded)",
        "SELECT format_number(1, 100000000) FROM guarded", "SELECT format_number(id, id) FROM guarded", "SELECT collect_list(a.id) FROM guarded a CROSS JOIN guarded b", "SELECT listagg(x) FROM (SELECT a.updated_at AS x FROM guarded a, guarded b)",
        "SELECT * FROM guarded, LATERAL explode(array(1, 2))", "SELECT * FROM variant_explode(parse_json('[' || repeat('1,', 9000) || '1]')), explode(array(1))", "SELECT * FROM guarded, LATERAL (SELECT reflect('a', 'b'))", "SELECT * FROM guarded, LATERAL variant_explode(parse_json(reflect('a', 'b')))",
    ],
    "schema": [
        "WITH guarded AS (SELECT 1 AS id) SELECT * FROM hidden", "WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden", "SELECT * FROM (WITH hidden AS (SELECT * FROM hidden) SELECT * FROM hidden)",
        "SELECT id FROM guarded WHERE id IN (WITH hidden AS (SELECT id FROM hidden) SELECT id FROM hidden)", "WITH RECURSIVE hidden AS (SELECT * FROM hidden) SELECT * FROM hidden",
        "WITH a AS (WITH hidden AS (SELECT 1 AS id) SELECT * FROM hidden) SELECT * FROM hidden", "WITH a AS (SELECT * FROM hidden), hidden AS (SELECT 1 AS id) SELECT * FROM a",
        "SELECT * FROM missing", "SELECT * FROM guarded, missing", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM main.guarded", "SELECT * FROM guarded, LATERAL (SELECT * FROM hidden)", "SELECT nosuch FROM guarded", "SELECT FROM WHERE", "SELECT id FROM guarded WHERE id IN (SELECT id FROM missing)",
    ],
}


@pytest.mark.parametrize("sql", ACCEPTED + DEFAULT_ONLY)
def test_guard_accepts(spark, known, sql):
    assert validate(spark, sql, known).is_valid
    if sql in ACCEPTED:
        assert validate(spark, sql, known, strict=True).tables == ["guarded"]
    else:
        with pytest.raises(ValidationError):
            validate(spark, sql, known, strict=True)


@pytest.mark.parametrize(("kind", "sql"), [(k, s) for k, all_ in REJECTED.items() for s in all_])
def test_guard_rejects(spark, known, kind, sql):
    with pytest.raises(ValidationError) as error:
        validate(spark, sql, known)
    assert error.value.violation_type == kind


def test_unknown_columns_come_with_a_proposal(spark, known):
    with pytest.raises(ValidationError, match="updated_at"):
        validate(spark, "SELECT update_at FROM guarded", known)


def test_cleaned_answers():
    assert cleaned("```SQL\nSELECT 1\n\n```") == "SELECT 1;"
    assert cleaned("Here is the query:\nSELECT 1;") == "SELECT 1;"


def csv(tmp_path, content, name="t.csv"):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_types(spark, tmp_path):
    text = "i,f,b,d,t,big,z,s,na\n1,1.5,True,2025-01-01,2025-01-01 10:00:00,9223372036854775808,007,x,NA\n 2,,false,NA,,1,8,null,n/a\n"
    df = read_csv(spark, csv(tmp_path, text))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "date", "timestamp", "decimal(38,0)", "bigint", "string", "string"]
    rows = df.orderBy("i").collect()
    assert rows[0].z == 7 and rows[1].f is None and rows[1].d is None and rows[1].s is None and rows[1].na is None


def test_csv_shapes(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, '﻿a,a,A,\n1,"x ""y""\nz",3\n'))
    assert df.columns == ["a", "a_2", "A_3", "unnamed_3"] and tuple(df.first()) == (1, 'x "y"\nz', 3, None)
    assert read_csv(spark, csv(tmp_path, "a,b\n")).count() == 0
    assert read_csv(spark, csv(tmp_path, "a\ncaf\xe9\n".encode("latin-1"))).first().a == "café"
    for content in ("", "a,b\n1,2,3\n"):
        with pytest.raises(ValueError):
            read_csv(spark, csv(tmp_path, content))
    with pytest.raises(ValueError):
        read_csv(spark, csv(tmp_path, "a\n1\n", "T.CSV"))


def test_names():
    assert [table_name(n) for n in ("My Data-2024.csv", "2024.csv", "sales (1).csv", "/a/b/X.csv")] == ["my_data_2024", "t_2024", "sales__1_", "x"]
    assert column_names(["a", "a", "A", None]) == ["a", "a_2", "A_3", "unnamed_3"]


def test_capped_execution(spark):
    df = spark.range(0, 2000, 1, 1).select(F.col("id").alias("a"), (F.col("id") * 2).alias("A"))
    assert capped(df).columns == ["a", "A_2"] and capped(df).count() == 500
    result = execute(df, 30)
    assert result.success and result.truncated and result.row_count == 30 and result.rows[1] == {"a": 1, "A_2": 2}
    assert as_text(result).splitlines()[-1] == "... and 10 more rows (truncated)" and as_text(result).startswith("Row 1: a: 0 | A_2: 0")
    failed = execute(spark.range(1).select(F.expr("1 / id").alias("x")))
    assert not failed.success and "DIVIDE_BY_ZERO" in failed.error


def test_charts(spark):
    two = spark.createDataFrame([("Market", 1), ("May", None)], "label string, n int")
    assert chart_spec(two.filter("n = 1")) == {"type": "doughnut", "label": "label", "values": ["n"]}
    assert chart_spec(two)["type"] == "line" and chart_spec(two.filter("n = 1"), "trend")["type"] == "line"
    assert [tuple(r) for r in chart_series(two, chart_spec(two)).collect()] == [("Market", 1.0), ("May", 0.0)]
    assert chart_spec(spark.createDataFrame([(f"c{k}", k) for k in range(7)], "label string, n int"))["type"] == "bar"
    assert chart_spec(two.select("label")) is None and chart_spec(two.limit(0)) is None


def test_formats(spark):
    row = spark.range(1).select(
        cell(F.lit(1234567), "int").alias("a"), cell(F.lit(1234.5), "double").alias("b"), cell(F.lit(None).cast("int"), "int").alias("c"), axis_number(F.lit(2_500_000)).alias("d"), axis_number(F.lit(1500)).alias("e"),
        axis_number(F.lit(7)).alias("f"), is_time_label(F.lit("2024-05")).alias("g"), is_time_label(F.lit("Market")).alias("h"), is_time_label(F.lit("Mar 5")).alias("i"),
    ).first()
    assert tuple(row) == ("1,234,567", "1,234.5", "-", "2.5M", "1.5K", "7", True, False, True)
    assert pretty_sql("SELECT a FROM t WHERE b GROUP BY a ORDER BY a LIMIT 3").splitlines()[1:] == ["FROM t", "WHERE b", "GROUP BY a", "ORDER BY a", "LIMIT 3"]


def test_insight(spark):
    df = spark.createDataFrame([("2024-01", 10.0), ("2024-02", 30.0)], "month string, v double")
    assert insight(df.limit(0), "month", "v") == NO_ROWS
    text = insight(df, "month", "v", trend=True)
    assert "40.00" in text and "75.0%" in text and "+200.0%" in text
    assert insight(df.select("month"), "month", None) == "The query returned 2 rows."


def test_keys_are_found_in_the_rows(spark):
    make = spark.createDataFrame
    shops = make([(k, f"s{k}") for k in range(50)], "shop_id int, name string")
    sales = make([(k, k % 50 if k else None, k % 7) for k in range(300)], "sale_id long, shop_id long, region_id int")
    regions = make([(k,) for k in range(6)], "region_id int")  # lacks the 6 that sales have
    logs = make([(1,), (1,)], "shop_id int")
    nothing = make([], "shop_id int")
    found = discovered({"shops": shops, "sales": sales, "regions": regions, "logs": logs, "nothing": nothing})
    assert {t: k.primary for t, k in found.items()} == {"shops": ("shop_id",), "sales": ("sale_id",), "regions": ("region_id",), "logs": (), "nothing": ()}
    assert {t: k.foreign for t, k in found.items() if k.foreign} == {"sales": {"shop_id": ("shops", "shop_id")}, "logs": {"shop_id": ("shops", "shop_id")}}


def test_samples_do_not_depend_on_partitions(spark):
    catalog, seen = Catalog(spark), set()
    for parts in (1, 7):
        catalog.register("numbers", spark.range(1000).withColumn("x", F.when(F.col("id") % 2 == 0, F.col("id") / 3)).repartition(parts))
        seen.add(tuple(r.text for r in catalog.samples().orderBy("text").collect()))
    assert len(seen) == 1 and len(seen.pop()) == 3


def test_columns_of_many_values_are_indexed(spark):
    rows = spark.range(110_000).select(F.concat(F.lit("Name#"), "id").alias("name"), F.lit("kind").alias("kind"))
    found = indexed_values(rows, "t", ["name", "kind"])
    assert found.count() == 110_001 and [r.value for r in found.filter("term = 'name 109999'").collect()] == ["Name#109999"]
