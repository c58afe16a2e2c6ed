"""Tables from scripts."""

import datetime as dt
import os

import pytest

from tidemark.engine import Engine
from tidemark.sources.catalog import Keys
from tidemark.sources.script import run_script, statements

SCRIPT = """
-- harbours; and ships
CREATE TABLE harbours (id BIGINT PRIMARY KEY, name STRING NOT NULL, depth DOUBLE, opened DATE);
CREATE TABLE IF NOT EXISTS ships (id BIGINT PRIMARY KEY, home BIGINT, name STRING, state STRING DEFAULT 'a;float', FOREIGN KEY (home) REFERENCES harbours (id));
/* two ; rows */
INSERT INTO harbours VALUES (1, 'Lee; side', 4, DATE '2020-02-29'), (2, 'Wind -- ward', NULL, NULL);
INSERT INTO ships (name, id) VALUES ('Tern', 7);
INSERT INTO ships (id, home, name, state) SELECT id + 1, 2, concat(word, '\\'s'), NULL FROM hulls;
"""


def test_statements():
    got = statements(" ;; a 'x;''y' \"b;\" `c;` -- d;\n e/*;*/f-1/2; g")
    assert [s.split() for s in got] == [["a", "'x;''y'", '"b;"', "`c;`", "e", "f-1/2"], ["g"]]
    assert statements("") == statements("-- only this") == []


def test_script_gives_typed_tables_and_keys(spark, tmp_path):
    spark.createDataFrame([(7, "Gull")], "id long, word string").createOrReplaceTempView("hulls")
    path = tmp_path / "s.sql"
    path.write_text(SCRIPT)
    engine = Engine(spark, str(tmp_path / "base"))
    assert engine.bootstrap(str(path)) == ["harbours", "ships"]
    assert spark.table("harbours").dtypes == [("id", "bigint"), ("name", "string"), ("depth", "double"), ("opened", "date")]
    assert sorted(map(tuple, spark.table("harbours").collect())) == [(1, "Lee; side", 4.0, dt.date(2020, 2, 29)), (2, "Wind -- ward", None, None)]
    assert sorted(map(tuple, spark.table("ships").collect())) == [(7, None, "Tern", "a;float"), (8, 2, "Gull's", None)]
    assert engine.catalog.keys["ships"] == Keys(("id",), {"home": ("harbours", "id")}, {"state": "'a;float'"})
    # The second run, also by another engine, stores nothing.
    stored = sorted(os.listdir(tmp_path / "base" / "tables" / "ships"))
    assert Engine(spark, str(tmp_path / "base")).bootstrap(str(path)) == ["harbours", "ships"]
    assert sorted(os.listdir(tmp_path / "base" / "tables" / "ships")) == stored


@pytest.mark.parametrize(
    "script",
    ["DROP TABLE x", "SELECT 1", "INSERT INTO nowhere VALUES (1)", "CREATE TABLE a (i INT); INSERT OVERWRITE a VALUES (1)", "CREATE TABLE a (i INT, j INT); INSERT INTO a VALUES (1)", "CREATE TABLE a (i INT NOT NULL); INSERT INTO a VALUES (NULL)", "CREATE TABLE a (i INT PRIMARY KEY); INSERT INTO a VALUES (1), (1)", "CREATE TABLE a (i INT); INSERT INTO a VALUES ('x')"],
)
def test_refused_scripts_leave_no_marker(spark, tmp_path, script):
    with pytest.raises(Exception):  # noqa: B017
        run_script(spark, script, str(tmp_path))
    assert not os.path.exists(tmp_path / "scripts")


def test_empty_scripts_and_tables(spark, tmp_path):
    assert run_script(spark, "", str(tmp_path)) == {}
    made = run_script(spark, "CREATE TABLE a (i INT, s STRING)", str(tmp_path))
    assert made["a"][0].dtypes == [("i", "int"), ("s", "string")] and made["a"][0].count() == 0
