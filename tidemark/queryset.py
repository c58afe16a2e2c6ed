"""The registered queries of the engine's own operators, each beside the DuckDB SQL that gives the same rows.

Sums of money are taken over decimals, so they don't depend on the order of the rows; whole numbers are longs.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.engine import timeline
from tidemark.functions import axis_number, cell, chart_value, highlights
from tidemark.operators.chart import chart_series, chart_spec
from tidemark.operators.execute import capped
from tidemark.operators.frames import grouped_frames
from tidemark.operators.insight import facts
from tidemark.operators.intervals import met_others, span_totals
from tidemark.operators.json_tables import json_each, json_tree
from tidemark.operators.medians import medians
from tidemark.operators.retrieval import Index, inner_product
from tidemark.operators.schema_docs import schema_documents
from tidemark.operators.terms import search_texts
from tidemark.operators.values import Match, indexed_values
from tidemark.plans.compiler import shape, to_dataframe
from tidemark.plans.guard import validate
from tidemark.plans.planner import planned
from tidemark.plans.semantics import TPCH
from tidemark.session import new_folder
from tidemark.sources.catalog import Catalog
from tidemark.sources.keys import base_name, discovered
from tidemark.sources.script import run_script

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
#: The day that relative time ranges refer to.
AS_OF = dt.date(2001, 8, 1)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        for name in names or TABLES:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its DuckDB twin."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return register


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def total(c: str) -> Column:
    return F.sum(money(c)).cast("double")


def rows() -> Column:
    return F.count(F.lit(1))


# Projections, predicates, scalars


@query("SELECT p_partkey, p_name, p_retailprice * 2 + 1 AS twice FROM part WHERE p_name LIKE '%ring%' AND p_size BETWEEN 5 AND 40 AND NOT p_type = 'PROMO'")
def scan_filter_project(t):
    return t.part.filter(F.col("p_name").like("%ring%") & F.col("p_size").between(5, 40) & ~(F.col("p_type") == "PROMO")).select("p_partkey", "p_name", (F.col("p_retailprice") * 2 + 1).alias("twice"))


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS BIGINT) AS len, substr(c_name, 1, 4) AS start, replace(c_name, '#', '-') AS dashed, trim('  ' || c_mktsegment || ' ') AS trimmed, CAST(instr(c_name, '#') AS BIGINT) AS at, c_name || '/' || c_mktsegment AS both FROM customer")
def string_scalars(t):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.upper(name).alias("up"), F.lower(segment).alias("low"), F.length(name).cast("long").alias("len"), F.substring(name, 1, 4).alias("start"), F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"), F.trim(F.concat(F.lit("  "), segment, F.lit(" "))).alias("trimmed"), F.instr(name, "#").cast("long").alias("at"), F.concat(name, F.lit("/"), segment).alias("both"))


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 'low' WHEN p_retailprice < 1500 THEN 'mid' ELSE 'high' END AS bucket FROM part")
def case_bucket(t):
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", F.when(price < 1000, "low").when(price < 1500, "mid").otherwise("high").alias("bucket"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END AS large FROM orders")
def coalesce_nullif(t):
    return t.orders.select("o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"), F.when(F.col("o_totalprice") > 1000, 1).otherwise(0).alias("large"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none FROM events")
def cast_try(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.col("event_type").try_cast("long").alias("none"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")).filter("k % 2 = 0")


@query("SELECT p_partkey, abs(p_retailprice - 1200) AS away, CAST(floor(p_retailprice) AS BIGINT) AS down, greatest(p_size, 10) AS most, least(p_size, 10) AS few, CAST(p_partkey % 7 AS BIGINT) AS rest, sqrt(p_retailprice) AS root, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice / (p_size % 5) END AS ratio FROM part")
def math_scalars(t):
    price, size = F.col("p_retailprice"), F.col("p_size")
    return t.part.select("p_partkey", F.abs(price - 1200).alias("away"), F.floor(price).alias("down"), F.greatest(size, F.lit(10)).alias("most"), F.least(size, F.lit(10)).alias("few"), (F.col("p_partkey") % 7).alias("rest"), F.sqrt(price).alias("root"), F.try_divide(price, size % 5).alias("ratio"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'signup') AND value IS NOT NULL AND event_type IS DISTINCT FROM 'signup'")
def in_list(t):
    return t.events.filter(F.col("event_type").isin("purchase", "signup") & F.col("value").isNotNull() & ~F.col("event_type").eqNullSafe("signup")).select("event_id", "event_type")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def between_dates(t):
    day = F.col("o_orderdate")
    return t.orders.filter(day.between("1996-01-01", "1996-06-30")).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), F.year(day).cast("long").alias("y"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.date_format(F.trunc(day, "MM"), "yyyy-MM-dd").alias("month"))


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER%1' AND regexp_matches(c_name, '[0-9]+1$')")
def ilike_rlike(t):
    return t.customer.filter(F.col("c_name").ilike("%CUSTOMER%1") & F.col("c_name").rlike("[0-9]+1$")).select("c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_subquery(t):
    return t.orders.join(t.customer.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1.5::DOUBLE FROM orders)")
def scalar_subquery(t):
    return t.views("orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 1.5D FROM orders)")


@query("SELECT p_partkey FROM part p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
def correlated_subquery(t):
    return t.views("part").sql("SELECT p_partkey FROM part p WHERE p_retailprice = (SELECT max(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")


@query("SELECT c_mktsegment, CAST(max(n) AS BIGINT) AS most FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_mktsegment")
def derived_table(t):
    return t.customer.groupBy("c_mktsegment", "c_nationkey").agg(rows().alias("n")).groupBy("c_mktsegment").agg(F.max("n").alias("most"))


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n AS orders, count(*) AS customers FROM c GROUP BY n")
def cte_query(t):
    return t.views("orders").sql("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT n AS orders, count(*) AS customers FROM c GROUP BY n")


# Joins


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000")
def left_join_nulls(t):
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(t):
    return t.supplier.filter("s_acctbal > 5000").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT a.o_orderkey, b.l_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 45) b ON a.o_orderkey = b.l_orderkey")
def full_outer(t):
    return t.orders.filter("o_orderstatus = 'F'").select("o_orderkey").join(t.lineitem.filter("l_quantity >= 45").select("l_orderkey").distinct(), F.col("o_orderkey") == F.col("l_orderkey"), "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join_small(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("one"), F.col("b.n_name").alias("other"))


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey AND n_nationkey < 5")
def theta_join(t):
    return t.supplier.join(F.broadcast(t.nation.filter("n_nationkey < 5")), F.col("s_nationkey") > F.col("n_nationkey")).select("s_suppkey", "n_nationkey")


@query("WITH band(lo, hi, name) AS (VALUES (0, 1000, 'low'), (1000, 1500, 'mid'), (1500, 10000, 'high')) SELECT name, count(*) AS parts FROM part JOIN band ON p_retailprice >= lo AND p_retailprice < hi GROUP BY name")
def range_join(t):
    band = t.spark.createDataFrame([(0, 1000, "low"), (1000, 1500, "mid"), (1500, 10000, "high")], "lo int, hi int, name string")
    return t.part.join(F.broadcast(band), (F.col("p_retailprice") >= F.col("lo")) & (F.col("p_retailprice") < F.col("hi"))).groupBy("name").agg(rows().alias("parts"))


@query(
    "WITH s AS (SELECT event_id AS signup, ts AS s, ts + (event_id % 37 + 1) * INTERVAL 1 HOUR AS e FROM events WHERE event_type = 'signup') "
    "SELECT signup, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM s JOIN events ON ts >= s AND ts < e GROUP BY ALL"
)
def events_within(t):
    """What happens within the hours behind each signup."""
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 37 + 1).cast("int"))
    spans = t.events.filter("event_type = 'signup'").select(F.col("event_id").alias("signup"), F.col("ts").alias("s"), (F.col("ts") + hours).alias("e"))
    met = span_totals(t.events, F.col("ts"), ["event_type"], {"value": F.col("value").cast("decimal(18,2)")}, spans, (F.col("s"), F.col("e")), ["signup"])
    return met.withColumn("value", F.col("value").cast("double"))


_OPEN = "SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) AS e FROM orders"


@query(f"WITH o AS ({_OPEN}) SELECT a.k, count(*) AS others, min(b.k) AS first FROM o a JOIN o b ON a.s < b.e AND b.s < a.e AND a.k <> b.k WHERE a.s < a.e AND b.s < b.e GROUP BY a.k")
def open_together(t):
    """Orders that are open on a day of another, each open for some days of its own."""
    days = t.orders.select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 5).cast("int")).alias("e"))
    return met_others(days, "k", (F.col("s"), F.col("e")))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_join(t):
    return t.orders.join(t.lineitem.filter("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT k AS n_nationkey, count(*) AS customers FROM (SELECT n_nationkey AS k, n_name FROM nation) JOIN (SELECT c_nationkey AS k FROM customer) USING (k) GROUP BY k")
def using_join(t):
    return t.nation.select(F.col("n_nationkey").alias("k")).join(t.customer.select(F.col("c_nationkey").alias("k")), "k").groupBy(F.col("k").alias("n_nationkey")).agg(rows().alias("customers"))


# Aggregates


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem")
def total_sales(t):
    return t.lineitem.agg(total("l_extendedprice").alias("revenue"), rows().alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("SELECT count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) AS n FROM customer")
def count_filter(t):
    return t.customer.agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("building"), rows().alias("n"))


@query("SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS mean FROM orders GROUP BY 1")
def avg_by_status(t):
    return t.orders.groupBy("o_orderstatus").agg((total("o_totalprice") / F.count("o_totalprice")).alias("mean"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS price, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units FROM lineitem GROUP BY ALL")
def sum_decimal(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_extendedprice")).cast("decimal(38,2)").alias("price"), F.sum(F.col("l_quantity").cast("long")).alias("units"))


@query("SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, count(DISTINCT l_partkey) AS n, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY 1)")
def count_distinct(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count_distinct("l_partkey").alias("n"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(DISTINCT CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having_group(t):
    return t.orders.groupBy("o_custkey").agg(rows().alias("n"), F.sum_distinct(money("o_totalprice")).cast("double").alias("spent")).filter("n > 15")


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def listagg_nations(t):
    return t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("nations"))


@query("SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest, coalesce(CAST(sum(CASE WHEN c_acctbal > 20000 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS whales FROM customer GROUP BY 1")
def argmax_total(t):
    return t.customer.groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"), F.coalesce(F.sum(F.when(F.col("c_acctbal") > 20000, money("c_acctbal"))).cast("double"), F.lit(0.0)).alias("whales"))


@query("SELECT p_brand, p_type, count(*) AS n, CAST(GROUPING(p_brand) AS BIGINT) AS g FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rollup(t):
    return t.part.rollup("p_brand", "p_type").agg(rows().alias("n"), F.grouping("p_brand").cast("long").alias("g"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(t):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(rows().alias("n"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(t):
    return t.views("customer").sql("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")


@query("SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def percentile(t):
    """The median of each type, found by counting values in ever narrower ranges: no type's values are in one task."""
    return medians(t.events, "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def day_window(t):
    return t.events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(rows().alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


# Windows


@query("SELECT * FROM (SELECT c_mktsegment, c_custkey, CAST(rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC) AS BIGINT) AS dense FROM customer) WHERE rk <= 3")
def rank_topn(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc())
    return t.customer.select("c_mktsegment", "c_custkey", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dense")).filter("rk <= 3")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def row_number_dedup(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return t.orders.withColumn("n", F.row_number().over(w)).filter("n = 1").select("o_custkey", "o_orderkey")


@query("SELECT event_id, value - lag(value) OVER w AS step, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_delta(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", (F.col("value") - F.lag("value").over(w)).alias("step"), F.lead("event_id").over(w).alias("following"))


@query("SELECT p_partkey, CAST(ntile(4) OVER w AS BIGINT) AS quarter, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)")
def ntile(t):
    w = Window.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")
    return t.part.select("p_partkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.percent_rank().over(w).alias("pr"), F.cume_dist().over(w).alias("cd"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def first_last_value(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("first"), F.last("o_orderkey").over(w).alias("last"), F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DOUBLE) AS so_far, count(*) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND CURRENT ROW) AS recent FROM orders")
def running_total(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = Window.partitionBy("o_custkey").orderBy(F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))).rangeBetween(-90, 0)
    return t.orders.select("o_orderkey", F.sum(money("o_totalprice")).over(w).cast("double").alias("so_far"), rows().over(days).alias("recent"))


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def moving_avg(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", (F.sum(money("value")).over(w).cast("double") / rows().over(w)).alias("mean"))


@query("SELECT p_type, revenue, revenue / CAST(sum(CAST(revenue AS DECIMAL(38,2))) OVER () AS DOUBLE) AS share FROM (SELECT p_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type)")
def share_of_total(t):
    by_type = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(total("l_extendedprice").alias("revenue"))
    everything = F.sum(F.col("revenue").cast("decimal(38,2)")).over(Window.partitionBy()).cast("double")  # over one row for each type
    return by_type.select("p_type", "revenue", (F.col("revenue") / everything).alias("share"))


_DAYS = "CAST(o_orderdate AS DATE)"


def _frames(name: str, frame: str, start: int | None, end: int | None, exclude: str = "no others") -> None:
    """Sums of orders over groups of days of a customer's nation-wide segment: each frame with and without what it excludes."""
    over = f"OVER (PARTITION BY o_orderpriority ORDER BY {_DAYS} GROUPS BETWEEN {frame}{'' if exclude == 'no others' else f' EXCLUDE {exclude.upper()}'})"
    price = "CAST(o_totalprice AS DECIMAL(18,2))"
    SQL[name] = f"SELECT o_orderkey, CAST(sum({price}) {over} AS DOUBLE) AS spent, count({price}) {over} AS n, CAST(min({price}) {over} AS DOUBLE) AS least, CAST(max({price}) {over} AS DOUBLE) AS most FROM orders"

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"), money("o_totalprice").alias("price"))
        framed = grouped_frames(orders, ["o_orderpriority"], ["day"], "price", start, end, exclude)
        return framed.select("o_orderkey", F.col("frame_sum").cast("double").alias("spent"), F.col("frame_count").alias("n"), F.col("frame_min").cast("double").alias("least"), F.col("frame_max").cast("double").alias("most"))

    QUERIES[name] = build


_frames("groups_frame", "3 PRECEDING AND 1 FOLLOWING", -3, 1)
_frames("groups_so_far", "UNBOUNDED PRECEDING AND 1 PRECEDING", None, -1)
_frames("exclude_current_row", "1 PRECEDING AND 2 FOLLOWING", -1, 2, "current row")
_frames("exclude_group", "2 PRECEDING AND UNBOUNDED FOLLOWING", -2, None, "group")
_frames("exclude_ties", "CURRENT ROW AND 1 FOLLOWING", 0, 1, "ties")


# Order, limits, sets


@query("SELECT c_custkey, bal FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, c_acctbal AS bal FROM customer ORDER BY seg NULLS LAST, bal DESC, c_custkey LIMIT 100)")
def sort_nulls(t):
    return t.customer.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING"))).withColumnRenamed("c_acctbal", "bal").orderBy(F.col("seg").asc_nulls_last(), F.col("bal").desc(), "c_custkey").limit(100).select("c_custkey", "bal")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def limit_offset(t):
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey").offset(10).limit(20)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return union_all(t).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect(t):
    keys = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("k"))
    return keys("R").intersect(keys("A"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def except_(t):
    return t.part.select(F.col("p_partkey").alias("k")).subtract(t.lineitem.filter("l_quantity > 40").select("l_partkey"))


# Questions, through the planner and the compiler


class _Looked:
    """Values looked up in the tables themselves, without a stored index."""

    def __init__(self, t: Tables):
        parts = [indexed_values(getattr(t, name), name, columns) for name, columns in TPCH.named_columns().items()]
        self.table = reduce(DataFrame.unionByName, parts)

    def lookup(self, terms):
        return [Match(*r) for r in self.table.filter(F.col("term").isin(list(terms))).orderBy("term", "table", "column", "value").limit(1000).collect()]

    def near(self, term):
        return []


def _asked(t: Tables, question: str) -> DataFrame:
    return to_dataframe(shape(planned(question, TPCH, _Looked(t)), TPCH, AS_OF), lambda name: getattr(t, name))


_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(38,2))) AS DOUBLE) AS revenue"
_STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def question(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _asked(Tables(spark, sf_dir), text)
    SQL[name] = sql


question("show_total_sales", "Show total sales", f"SELECT {_REVENUE} FROM lineitem")
question("sales_by_city", "Show sales by city", f"SELECT n_name AS city, {_REVENUE} FROM {_STAR} GROUP BY 1")
question("sales_by_region", "Sales by region", f"SELECT r_name AS region, {_REVENUE} FROM {_STAR} GROUP BY 1")
question("show_customers", "Show customers", "SELECT * FROM customer")
question("last_month", "Show sales last month", f"SELECT {_REVENUE} FROM {_STAR} WHERE o_orderdate >= DATE '2001-07-01' AND o_orderdate < DATE '2001-08-01'")
question("top5_customers", "Top 5 customers by revenue", f"SELECT c_name AS customer, c_custkey AS customer_key, {_REVENUE} FROM {_STAR} GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 5")
question("top5_products", "What are the top 5 products by revenue?", f"SELECT p_name AS product, p_partkey AS product_key, {_REVENUE} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 5")
question("best_selling", "Best selling products", "SELECT p_name AS product, p_partkey AS product_key, CAST(sum(CAST(l_quantity AS DECIMAL(38,2))) AS DOUBLE) AS units FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
question("revenue_by_category", "Revenue by product category", f"SELECT p_type AS category, {_REVENUE} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
question("monthly_trend", "Monthly sales trend", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {_REVENUE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
question("monthly_trend_1997", "Show monthly sales trend for 1997", f"SELECT strftime(o_orderdate, '%Y-%m') AS month, {_REVENUE} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1997 GROUP BY 1")
question("this_year_by_region", "Sales by region this year", f"SELECT r_name AS region, {_REVENUE} FROM {_STAR} WHERE year(o_orderdate) = 2001 GROUP BY 1")
question("customers_from", "How many customers are from Nation 3?", "SELECT count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'")


question("sales_in_region", "Show sales in Asia", f"SELECT {_REVENUE} FROM {_STAR} WHERE r_name = 'ASIA'")
question("sales_of_category", "Sales from Promo by region", f"SELECT r_name AS region, {_REVENUE} FROM {_STAR} JOIN part ON l_partkey = p_partkey WHERE p_type = 'PROMO' GROUP BY 1")
question("sales_in_two_places", "Show sales in Nation 3 and Nation 17 by city", f"SELECT n_name AS city, {_REVENUE} FROM {_STAR} WHERE n_name IN ('NATION_3', 'NATION_17') GROUP BY 1")
question("customers_by_region", "How many customers by region", "SELECT r_name AS region, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_SIDES = "SELECT 'revenue' AS measure, {} AS first_side, first, {} AS second_side, second, first - second AS difference, first / second AS ratio FROM (SELECT {} AS first, {} AS second FROM {})"
_side = lambda test: f"CAST(sum(CAST(l_extendedprice AS DECIMAL(38,2))) FILTER (WHERE {test}) AS DOUBLE)"
question("compare_places", "Compare sales of Nation 3 and Nation 17", _SIDES.format("'NATION_3'", "'NATION_17'", _side("n_name = 'NATION_3'"), _side("n_name = 'NATION_17'"), _STAR))
question("compare_years", "Sales this year against last year", _SIDES.format("'this year'", "'last year'", _side("year(o_orderdate) = 2001"), _side("year(o_orderdate) = 2000"), _STAR))
question("compare_in_place", "Compare sales of Promo and Economy in Asia", _SIDES.format("'PROMO'", "'ECONOMY'", _side("p_type = 'PROMO'"), _side("p_type = 'ECONOMY'"), f"{_STAR} JOIN part ON l_partkey = p_partkey WHERE r_name = 'ASIA'"))


@query(
    "SELECT lower(trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g'))) AS term, \"table\", \"column\", value FROM (SELECT 'nation' AS \"table\", 'n_name' AS \"column\", n_name AS value FROM nation "
    "UNION SELECT 'part', 'p_type', p_type FROM part UNION SELECT 'part', 'p_name', p_name FROM part UNION SELECT 'region', 'r_name', r_name FROM region UNION SELECT 'customer', 'c_name', c_name FROM customer)"
)
def value_index(t):
    """The values that questions can name, with their columns."""
    return _Looked(t).table


# JSON as tables

_TYPES = "CASE WHEN type IN ('UBIGINT', 'BIGINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'real' WHEN type = 'VARCHAR' THEN 'text' WHEN type = 'BOOLEAN' THEN CAST(value AS VARCHAR) ELSE lower(type) END"
#: JSON with an object and a list within, made of each event.
_NESTED_SQL = "SELECT event_id, '{\"id\":' || event_id || ',\"props\":' || replace(props, ' ', '') || ',\"tags\":[\"' || event_type || '\",{\"user\":' || user_id || '},[true,null]]}' AS doc FROM events"


def _nested(t: Tables) -> DataFrame:
    return t.views("events").sql(_NESTED_SQL)


@query(f"SELECT event_id, key, CAST(value AS VARCHAR) AS value, {_TYPES} AS type FROM ({_NESTED_SQL}), json_each(doc)")
def json_members(t):
    return json_each(_nested(t), "doc").select("event_id", "key", "value", "type")


@query(f"SELECT event_id, fullkey AS path, CAST(value AS VARCHAR) AS value, {_TYPES} AS type FROM ({_NESTED_SQL}), json_tree(doc)")
def json_values(t):
    return json_tree(_nested(t), "doc").select("event_id", "path", "value", "type")


@query("SELECT event_type, j.key, CAST(sum(CAST(j.value AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events, json_each(props) j GROUP BY ALL")
def guarded_json(t):
    """Members of JSON in a guarded statement."""
    spark = t.views("events")
    sql = "SELECT event_type, x.key, sum(variant_get(x.value, '$', 'bigint')) AS total, count(*) AS n FROM events, LATERAL variant_explode(parse_json(props)) AS x GROUP BY event_type, x.key"
    return spark.sql(validate(spark, sql, ["events"]).validated_sql)


# The engine's own operators


def tpch_catalog(t: Tables) -> Catalog:
    """The tables with the keys that their rows show."""
    catalog = Catalog(t.spark)
    frames = {name: getattr(t, name) for name in TABLES}
    for name, keys in discovered(frames).items():
        catalog.register(name, frames[name], keys)
    return catalog


_KINDS = "CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END"
#: Columns of whole numbers and text, in their order.
_KEYLIKE = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_mktsegment", "supplier": "s_suppkey s_name s_nationkey", "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus", "events": "event_id user_id event_type props", "embeddings": "vec_id label",
}
_COLUMNS = [(t, k, c) for t, cs in _KEYLIKE.items() for k, c in enumerate(cs.split())]
#: Which columns hold distinct values without nulls, and the first of each table.
_UNIQUE = " UNION ALL ".join(f"SELECT '{t}' AS t, {k} AS k, '{c}' AS c FROM {t} HAVING count(*) > 0 AND count(*) = count({c}) AND count(*) = count(DISTINCT {c})" for t, k, c in _COLUMNS)
_PRIMARY = f"(SELECT t, arg_min(c, k) AS c FROM ({_UNIQUE}) GROUP BY t)"
#: Which of the columns of one name, but for the prefix, lie within another.
_INCLUDED = " UNION ALL ".join(
    f"SELECT '{t}' AS t, '{c}' AS c, '{u}' AS ft, '{d}' AS fc FROM {t} HAVING count({c}) > 0 AND count({c}) FILTER (WHERE {c} NOT IN (SELECT {d} FROM {u})) = 0"
    for t, _, c in _COLUMNS for u, _, d in _COLUMNS if t != u and base_name(c) == base_name(d) and c.endswith(("key", "id"))
)
_FOREIGN = f"(SELECT i.* FROM ({_INCLUDED}) i JOIN {_PRIMARY} p ON p.t = i.ft AND p.c = i.fc)"


@query(
    f"SELECT table_name AS \"table\", CAST(ordinal_position - 1 AS INT) AS ordinal, column_name AS \"column\", {_KINDS} AS type, p.c IS NOT NULL AS pk, p.c IS NULL AS nullable, CAST(NULL AS VARCHAR) AS \"default\", f.ft AS fk_table, f.fc AS fk_column "
    f"FROM information_schema.columns LEFT JOIN {_PRIMARY} p ON p.t = table_name AND p.c = column_name LEFT JOIN {_FOREIGN} f ON f.t = table_name AND f.c = column_name WHERE table_name IN {TABLES}"
)
def catalog_columns(t):
    return tpch_catalog(t).columns()


@query(f"SELECT t AS \"table\", c AS \"column\", ft AS to_table, fc AS to_column FROM {_FOREIGN}")
def foreign_keys(t):
    """The foreign keys that the tables' rows show."""
    catalog = tpch_catalog(t)
    return t.spark.createDataFrame([(name, *key) for name in catalog.tables() for key in catalog.foreign_keys(name)], "table string, column string, to_table string, to_column string")


def _sampled(name: str, text: str) -> str:
    return f"SELECT * FROM (SELECT '{name}' AS \"table\", {text} AS text FROM {name} ORDER BY md5({text}), text LIMIT 3)"


@query(
    " UNION ALL ".join(
        [
            _sampled("nation", "'n_nationkey=' || n_nationkey || ', n_name=' || n_name || ', n_regionkey=' || n_regionkey"),
            _sampled("region", "'r_regionkey=' || r_regionkey || ', r_name=' || r_name"),
            _sampled("documents", "'doc_id=' || doc_id || ', lang=' || lang || ', source=' || source || ', n_chars=' || n_chars"),
        ]
    )
)
def table_samples(t):
    """Samples of tables in any order of rows."""
    catalog = Catalog(t.spark)
    for name in ("region", "nation", "documents"):
        catalog.register(name, getattr(t, name).drop("text").repartition(3))
    return catalog.samples()


@query()
def schema_documents_(t):
    return schema_documents(tpch_catalog(t))


@query("SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 5")
def vector_topk(t):
    asked = t.embeddings.filter("vec_id = 0").select(F.col("embedding").alias("asked")).limit(1)
    score = inner_product(F.col("embedding"), F.col("asked"))
    scored = t.embeddings.crossJoin(F.broadcast(asked)).withColumn("score", score)
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(5).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus")
def guarded_sql(t):
    spark = t.views()
    return spark.sql(validate(spark, "SELECT o_orderstatus, count(*) AS n FROM Orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus;", TABLES).validated_sql)


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000) SELECT o_orderpriority, count(*) AS n, hex(o_orderpriority) AS code FROM big GROUP BY ALL")
def guarded_cte(t):
    spark = t.views()
    sql = "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 1000), small AS (SELECT * FROM big) SELECT o_orderpriority, count(*) AS n, hex(o_orderpriority) AS code FROM small GROUP BY o_orderpriority"
    return spark.sql(validate(spark, sql, TABLES).validated_sql)


@query("WITH RECURSIVE up(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM up WHERE n < 4) SELECT n, r_name FROM up JOIN region ON r_regionkey = n")
def recursive_cte(t):
    spark = t.views("region")
    sql = "WITH RECURSIVE up(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM up WHERE n < 4) SELECT n, r_name FROM up JOIN region ON r_regionkey = n"
    return spark.sql(validate(spark, sql, ["region"]).validated_sql)


@query("SELECT c_custkey, CAST(row_number() OVER w AS INT) AS place, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER w AS DOUBLE) AS upto FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)")
def named_window(t):
    return t.views("customer").sql("SELECT c_custkey, row_number() OVER w AS place, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER w AS DOUBLE) AS upto FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_custkey)")


@query("SELECT DISTINCT CASE typeof(p_size) WHEN 'INTEGER' THEN 'int' END AS size, CASE typeof(p_partkey) WHEN 'BIGINT' THEN 'bigint' END AS key, CASE typeof(p_name) WHEN 'VARCHAR' THEN 'string' END AS name FROM part")
def value_types(t):
    return t.part.select(F.typeof("p_size").alias("size"), F.typeof("p_partkey").alias("key"), F.typeof("p_name").alias("name")).distinct()


@query("SELECT agent, s.status, s.timestamp_ms FROM (SELECT event_type AS agent, arg_max({'status': props, 'timestamp_ms': epoch_us(ts) // 1000}, (epoch_us(ts) // 1000, event_id)) AS s FROM events GROUP BY event_type)")
def agent_timeline(t):
    log = t.events.select(F.col("event_type").alias("agent"), F.col("props").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.col("event_id").alias("seq"))
    return timeline(log)


_CHOSEN = "SELECT {0} AS question, CASE WHEN {1} THEN 'line' WHEN count(DISTINCT label) <= 6 THEN 'doughnut' ELSE 'bar' END AS type, any_value(CASE WHEN {1} THEN 'month' ELSE {2} END) AS label, ['revenue'] AS \"values\" FROM (SELECT {3} AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(" UNION ALL ".join([_CHOSEN.format("'Sales by region'", "false", "'region'", "r_name"), _CHOSEN.format("'Sales by city'", "false", "'city'", "n_name"), _CHOSEN.format("'Show monthly sales trend'", "true", "'month'", "strftime(o_orderdate, '%Y-%m')")]))
def chart_choice(t):
    """The charts that answers of a few labels, of many and over time are given."""
    chosen = {question: chart_spec(_asked(t, question)) for question in ("Sales by region", "Sales by city", "Show monthly sales trend")}
    return t.spark.createDataFrame([(q, s["type"], s["label"], s["values"]) for q, s in chosen.items()], "question string, type string, label string, `values` array<string>")


@query("SELECT r_name AS label, CAST(count(*) AS DOUBLE) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def chart_series_(t):
    counted = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("label")).agg(rows().alias("n"))
    return chart_series(counted, chart_spec(counted))


def _tfidf(texts: str, query: str, key: str, k: int, least: str) -> str:
    """The k best of (id, text) by the cosine of word counts times ln((1 + texts) / (1 + texts with the word)) + 1."""
    words = r"list_filter(list_transform(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: regexp_replace(x, 's$', '')), lambda x: length(x) > 1)"
    asked = words.format(f"'{query}'")
    return (
        f"WITH w AS (SELECT id, {words.format("coalesce(text, '')")} AS words FROM ({texts})), n AS (SELECT count(*) AS total FROM w), p AS (SELECT id, unnest(words) AS word FROM w), c AS (SELECT id, word, count(*) AS n FROM p GROUP BY ALL), "
        "f AS (SELECT word, ln((1.0::DOUBLE + total) / (1.0::DOUBLE + count(DISTINCT id))) + 1 AS idf FROM p, n GROUP BY word, total), "
        f"q AS (SELECT word, count(*) AS times FROM (SELECT unnest({asked}) AS word) GROUP BY word), l AS (SELECT coalesce(sqrt(sum(times * idf * times * idf)), 0) AS length FROM q JOIN f USING (word)), "
        "s AS (SELECT id, sum(n * idf * coalesce(times, 0) * idf) AS product, sqrt(sum(n * idf * n * idf)) AS norm FROM c JOIN f USING (word) LEFT JOIN q USING (word) GROUP BY id) "
        f"SELECT id AS {key}, CASE WHEN product > 0 THEN round(product / (norm * length), 9) ELSE 0 END AS score FROM s, l WHERE {least} ORDER BY score DESC, id LIMIT {k}"
    )


_SOUGHT = "the results of the market and the new price of energy"


@query(_tfidf("SELECT doc_id AS id, text FROM documents", _SOUGHT, "doc_id", 50, "product > 0"))
def text_search(t):
    """The documents most like a query, by word frequencies over all of them."""
    return search_texts(t.documents, "doc_id", "text", _SOUGHT, 50).withColumnRenamed("id", "doc_id")


_DESCRIBED = {"region": "r_name", "nation": "n_name", "part": "p_type", "customer": "c_mktsegment", "orders": "o_orderpriority", "events": "event_type", "documents": "source"}
_ASKED = "urgent orders of large and promo parts in Asia"


@query(_tfidf(" UNION ALL ".join(f"SELECT '{name}' AS id, string_agg(DISTINCT {c}, ' ') AS text FROM {name}" for name, c in _DESCRIBED.items()), _ASKED, "table_name", 4, "true"))
def index_search(t):
    """The nearest tables, described by their values, in an index that two uploads made; the second replaced two tables."""

    def described(names: list[str]) -> DataFrame:
        texts = [getattr(t, n).agg(F.concat_ws(" ", F.sort_array(F.collect_set(_DESCRIBED[n]))).alias("document")).select(F.lit(n).alias("table_name"), "document") for n in names]
        return reduce(DataFrame.unionByName, texts)

    earlier = lambda names: described(names).withColumn("document", F.when(F.col("table_name").isin("part", "region"), "an earlier text").otherwise(F.col("document")))
    folder = new_folder(t.spark, "index")
    Index.updated(t.spark, folder, {n: "old" if n in ("part", "region") else "now" for n in _DESCRIBED}, earlier)
    return Index.updated(t.spark, folder, dict.fromkeys(_DESCRIBED, "now"), described).search(_ASKED, 4).select("table_name", "score")


_SCRIPT = """
-- what customers have spent; 'none' for those without orders
CREATE TABLE spent (custkey BIGINT PRIMARY KEY, total DOUBLE NOT NULL, n BIGINT DEFAULT 0, tier STRING DEFAULT 'buys; often');
INSERT INTO spent (custkey, total, n) SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))), count(*) FROM orders GROUP BY o_custkey;
INSERT INTO spent (custkey, total, tier) SELECT c_custkey, 0, NULL FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey;
"""


@query("SELECT c_custkey AS custkey, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE), 0) AS total, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) > 0 THEN 'buys; often' END AS tier FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def scripted_table(t):
    """A table that a script makes, its rows inserted from queries."""
    return run_script(t.views("orders", "customer"), _SCRIPT, new_folder(t.spark, "script"))["spent"][0]


@query("SELECT n_name AS city, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) AS order_value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def average_by_city(t):
    return _asked(t, "Average order value by city")


@query("SELECT p_name AS product, p_partkey AS product_key, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY revenue, 1, 2 LIMIT 3")
def bottom3_products(t):
    return _asked(t, "Bottom 3 products by revenue")


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '2001-01-01' AND o_orderdate < DATE '2001-02-01'")
def sales_in_january(t):
    return _asked(t, "Show sales in January")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def capped_result(t):
    return capped(t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey"))


@query(
    "WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value FROM orders GROUP BY 1) "
    "SELECT count(*) AS row_count, round(sum(CAST(value AS DECIMAL(38,2)))::DOUBLE, 2) AS total, min(value) AS least, arg_min(month, (value, month)) AS least_label, max(value) AS greatest, arg_max(month, (value, month)) AS greatest_label, "
    "round((arg_max(value, month) - arg_min(value, month)) * 100 / arg_min(value, month), 6) AS change_percent FROM m"
)
def result_facts(t):
    monthly = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(total("o_totalprice").alias("value"))
    found = facts(monthly, "month", "value")
    return found.select("row_count", F.round("total", 2).alias("total"), "least", "least_label", "greatest", "greatest_label", F.round("change_percent", 6).alias("change_percent"))


@query("SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS label_value, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS k FROM events")
def chart_label_cast(t):
    return t.events.select("event_id", chart_value(F.col("event_type")).alias("label_value"), chart_value(F.get_json_object("props", "$.k")).alias("k"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE format('{:,}', c_custkey * 1000) END AS cell, CASE WHEN c_custkey = 0 THEN '0' WHEN c_custkey >= 1000 THEN format('{:.1f}M', x + CASE WHEN (4 * x) % 2 = 1 THEN 0.01 ELSE 0 END) ELSE format('{:.1f}K', x) END AS axis FROM (SELECT c_custkey, c_custkey * 1000 / CASE WHEN c_custkey >= 1000 THEN 1000000.0::DOUBLE ELSE 1000.0::DOUBLE END AS x FROM customer)")
def cell_formats(t):
    thousand = F.col("c_custkey") * 1000
    return t.customer.select("c_custkey", cell(F.when(F.col("c_custkey") % 3 != 0, thousand), "bigint").alias("cell"), axis_number(thousand).alias("axis"))


@query("SELECT p_partkey, ['$' || CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR) || '%'] AS found FROM part")
def number_highlights(t):
    size = F.col("p_size").cast("string")
    return t.part.select("p_partkey", highlights(F.concat(F.lit("from $"), size, F.lit(" by "), size, F.lit("% in all"))).alias("found"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
