"""From a plan to a DataFrame, and to the Spark SQL that means the same."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.planner import QueryPlan, time_range
from tidemark.plans.semantics import Join, Semantics

#: The type in which amounts of money are exact; their sums have ten digits more.
MONEY = "decimal(18,2)"


#: (table, column, operator, values): >= and < a day, or equal to one of some values but for upper and lower case.
Test = tuple[str, str, str, tuple[str, ...]]


@dataclass(frozen=True)
class Shape:
    """What a plan comes to on given tables."""

    table: str
    joins: tuple[Join, ...]
    where: tuple[Test, ...]
    group: tuple[tuple[str, str, str], ...]  # (table, column, name)
    month: tuple[str, str] | None
    metric: tuple[str, str, str] | None  # (table, column, name)
    count: bool
    order: tuple[tuple[str, bool], ...]  # (output column, descending)
    limit: int | None
    aggregate: str = "sum"
    #: Of a comparison, its two sides: a name and the tests that hold on it.
    sides: tuple[tuple[str, tuple[Test, ...]], ...] = ()


def shape(plan: QueryPlan, semantics: Semantics, as_of: dt.date) -> Shape:
    metric = semantics.metric(plan.metrics[0]) if plan.metrics else None
    if metric is None and plan.entity is None:
        raise ValueError("the plan has neither a measure nor a table")
    table = metric.table if metric else plan.entity
    needed: list[str] = []
    where: list[Test] = []
    used = plan.used_filters()

    def within(text: str) -> list[Test]:
        needed.append(semantics.date[0])
        return [(*semantics.date, op, (day.isoformat(),)) for op, day in zip((">=", "<"), time_range(text, as_of), strict=True)]

    def equal(t: str, c: str, values: tuple[str, ...]) -> Test:
        needed.append(t)
        return t, c, "=", tuple(v.lower() for v in values)

    if "time_range" in used:
        where += within(used["time_range"])
    where += [equal(*test) for test in plan.where]
    sides = tuple((name, tuple([equal(t, c, (v,))] if t else within(v))) for name, t, c, v in plan.sides)
    date_table = semantics.date[0]
    if "location" in used and not plan.where:
        if table not in semantics.places:
            raise ValueError(f"not understood: {table} has no place")
        where.append(equal(*semantics.places[table], (used["location"],)))
    if "category" in used and not plan.where:
        if semantics.categories is None:
            raise ValueError(f"not understood: the category {used['category']}")
        where.append(equal(*semantics.categories, (used["category"],)))
    group: tuple[tuple[str, str, str], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    if plan.grouping and plan.grouping != "month":
        d = semantics.dimension(plan.grouping)
        needed.append(d.table)
        group = ((d.table, d.column, d.name), *(((d.table, d.key, f"{d.name}_key"),) if d.key else ()))
        order = ((metric.name if metric else "count", not plan.ascending), *((name, False) for _, _, name in group))
    if plan.grouping == "month":
        needed.append(date_table)
        order = (("month", False),)
    where_month = semantics.date if plan.grouping == "month" else None
    joins = tuple(semantics.path(table, [t for t in needed if t != table]))
    return Shape(table, joins, tuple(where), group, where_month, (metric.table, metric.column, metric.name) if metric else None, plan.intent == "count", order, plan.limit, plan.aggregate, sides)


def to_dataframe(s: Shape, table: Callable[[str], DataFrame]) -> DataFrame:
    """The plan in DataFrame operations; table: gives a table by its name. Join sides are left to the optimizer."""
    frames = {name: table(name).alias(name) for name in [s.table, *(j.to_table for j in s.joins)]}
    col = lambda t, c: F.col(f"{t}.{c}")
    df = _joined(s, frames)
    if s.count:
        return _grouped(df, s, F.count(F.lit(1)).alias("count"))
    if s.metric is None:
        df = df.select(f"{s.table}.*")
        return df if s.limit is None else df.limit(s.limit)
    t, c, name = s.metric
    if s.sides:
        return _compared(df, s)
    if s.aggregate == "sum" and s.joins and not s.where and all(j.column == s.joins[0].column for j in s.joins if j.table == s.table) and t == s.table and not any(x[0] == s.table for x in (*s.group, *([s.month] if s.month else []))):
        # All joins hang on one key and drop no facts: these are summed by it before they meet the other tables.
        key = s.joins[0].column
        summed = table(s.table).groupBy(key).agg(F.sum(F.col(c).cast(MONEY)).alias(c)).alias(s.table)
        return _grouped(_joined(s, {**frames, s.table: summed}), s, F.sum(col(t, c)).cast("double").alias(name))
    amount = col(t, c).cast(MONEY)
    total = {"sum": F.sum(amount).cast("double"), "avg": F.sum(amount).cast("double") / F.count(amount), "max": F.max(amount).cast("double"), "min": F.min(amount).cast("double")}[s.aggregate].alias(name)
    return _grouped(df, s, total)


def _joined(s: Shape, frames: dict[str, DataFrame]) -> DataFrame:
    """The tables joined and filtered."""
    col = lambda t, c: F.col(f"{t}.{c}")
    df = frames[s.table]
    for j in s.joins:
        df = df.join(frames[j.to_table], col(j.table, j.column) == col(j.to_table, j.to_column))
    # Where sides are compared, rows of neither are dropped first.
    for test in s.where:
        df = df.filter(_holds(test))
    return df.filter(reduce(or_, (_all(tests) for _, tests in s.sides))) if s.sides else df


def _holds(test: Test) -> Column:
    t, c, operator, values = test
    column = F.col(f"{t}.{c}")
    if operator == "=":
        return F.lower(column).isin(*values)
    day = F.lit(values[0]).cast("date")
    return column >= day if operator == ">=" else column < day


def _all(tests: tuple[Test, ...]) -> Column:
    return reduce(and_, map(_holds, tests))


def _compared(df: DataFrame, s: Shape) -> DataFrame:
    """One row: both sides' values by conditional aggregates in one pass, their difference, and the first over the second."""
    t, c, name = s.metric
    amount = F.col(f"{t}.{c}").cast(MONEY)
    values = []
    for _, tests in s.sides:
        on = F.when(_all(tests), amount)
        total = {"sum": F.sum, "avg": F.sum, "max": F.max, "min": F.min}[s.aggregate](on).cast("double")
        values.append(total / F.nullif(F.count(on), F.lit(0)) if s.aggregate == "avg" else total)
    first, second = (F.coalesce(v, F.lit(0.0)) if s.aggregate == "sum" else v for v in values)
    both = df.agg(first.alias("first"), second.alias("second"))
    labels = [F.lit(side).alias(n) for (side, _), n in zip(s.sides, ("first_side", "second_side"), strict=True)]
    return both.select(F.lit(name).alias("measure"), labels[0], "first", labels[1], "second", (F.col("first") - F.col("second")).alias("difference"), F.try_divide("first", "second").alias("ratio"))


def _grouped(df: DataFrame, s: Shape, total: Column) -> DataFrame:
    keys: list[Column] = [F.col(f"{gt}.{gc}").alias(gn) for gt, gc, gn in s.group]
    if s.month:
        keys.append(F.date_format(F.col(".".join(s.month)), "yyyy-MM").alias("month"))
    out = df.groupBy(*keys).agg(total) if keys else df.agg(total)
    if s.order:
        out = out.orderBy(*(F.col(n).desc() if down else F.col(n).asc() for n, down in s.order))
    return out if s.limit is None else out.limit(s.limit)


def to_sql(s: Shape) -> str:
    """The plan as one SELECT of Spark SQL."""
    name = lambda t, c: f"`{t}`.`{c}`"
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    lines = [f"FROM `{s.table}`"]
    lines += [f"JOIN `{j.to_table}` ON {name(j.table, j.column)} = {name(j.to_table, j.to_column)}" for j in s.joins]
    test = lambda t, c, o, vs: f"lower({name(t, c)}) IN ({', '.join(map(quoted, vs))})" if o == "=" else f"{name(t, c)} {o} DATE {quoted(vs[0])}"
    sides = [" AND ".join(test(*x) for x in tests) for _, tests in s.sides]
    tests = [test(*x) for x in s.where] + ([f"({' OR '.join(f'({x})' for x in sides)})"] if sides else [])
    if tests:
        lines.append("WHERE " + " AND ".join(tests))
    if s.count:
        keys = [(name(t, c), n) for t, c, n in s.group]
        head = "SELECT " + ", ".join([*(f"{e} AS `{n}`" for e, n in keys), "count(*) AS `count`"])
        tail = ["GROUP BY " + ", ".join(e for e, _ in keys), "ORDER BY " + ", ".join(f"`{n}` {'DESC' if down else 'ASC'}" for n, down in s.order)] if keys else []
        return "\n".join([head, *lines, *tail])
    if s.metric is None:
        return "\n".join([f"SELECT `{s.table}`.*", *lines, *([f"LIMIT {s.limit}"] if s.limit is not None else [])])
    keys = [(name(t, c), n) for t, c, n in s.group]
    if s.month:
        keys.append((f"date_format({name(*s.month)}, 'yyyy-MM')", "month"))
    t, c, metric = s.metric
    amount = f"CAST({name(t, c)} AS {MONEY})"
    if s.sides:
        on = [f"CASE WHEN {x} THEN {amount} END" for x in sides]
        how = {"avg": "CAST(sum({0}) AS DOUBLE) / nullif(count({0}), 0)", "sum": "coalesce(CAST(sum({0}) AS DOUBLE), 0.0D)"}.get(s.aggregate, f"CAST({s.aggregate}({{0}}) AS DOUBLE)")
        first, second = (how.format(x) for x in on)
        inner = "\n".join([f"SELECT {first} AS first, {second} AS second", *lines])
        labels = [quoted(side) for side, _ in s.sides]
        return f"SELECT {quoted(metric)} AS measure, {labels[0]} AS first_side, first, {labels[1]} AS second_side, second, first - second AS difference, try_divide(first, second) AS ratio\nFROM ({inner})"
    total = {"avg": f"CAST(sum({amount}) AS DOUBLE) / count({amount})"}.get(s.aggregate, f"CAST({s.aggregate}({amount}) AS DOUBLE)") + f" AS `{metric}`"
    head = "SELECT " + ", ".join([*(f"{e} AS `{n}`" for e, n in keys), total])
    if keys:
        lines.append("GROUP BY " + ", ".join(e for e, _ in keys))
    if s.order:
        lines.append("ORDER BY " + ", ".join(f"`{n}` {'DESC' if down else 'ASC'}" for n, down in s.order))
    if s.limit is not None:
        lines.append(f"LIMIT {s.limit}")
    return "\n".join([head, *lines])
