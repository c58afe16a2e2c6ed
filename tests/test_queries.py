"""Every registered query of the engine's own operators against its DuckDB twin."""

import decimal
import glob
import math
import os

import duckdb
import pytest

from tidemark import queryset

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return out


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.12g}")
    return str(x) if isinstance(x, decimal.Decimal) else x


@pytest.mark.parametrize("name", sorted(queryset.queries()))
def test_query(spark, con, name):
    rows = queryset.queries()[name](spark, DIR)
    got = rows.collect()
    if name not in queryset.oracle_sql():
        assert got
        return
    want = con.execute(queryset.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(rows.columns)
    ordered = lambda table: sorted((tuple(plain(v) for v in r) for r in table), key=repr)
    assert ordered([[r[n] for n in names] for r in got]) == ordered(want.fetchall())


def test_scans_are_narrow(spark):
    """Filters and columns reach the scan."""
    plan = queryset.queries()["scan_filter_project"](spark, DIR)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_name)" in plan and "p_brand" not in plan.split("== Physical Plan ==")[1]
