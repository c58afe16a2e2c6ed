"""Only queries that read the engine's tables run.

The statement is parsed by Spark and its logical plan walked: every node, function and relation must be on a list. This is the
only module that reaches into the session's JVM objects.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

#: Names of the logical plan's nodes that only read.
NODES = frozenset(
    "Project Filter Join Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias UnresolvedSubqueryColumnAliases "
    "UnresolvedRelation UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedHint Deduplicate".split()
)
WITH_NODES = frozenset({"UnresolvedWith"})
#: Nodes of table functions beside a table, and the table functions that a query may call: they give rows of values that it holds.
TABLE_NODES = frozenset({"LateralJoin", "UnresolvedTableValuedFunction"})
TABLE_FUNCTIONS = frozenset({"variant_explode", "variant_explode_outer"})
#: Functions that a query may call.
FUNCTIONS = frozenset(
    "abs add_months any_value array_join avg bool_and bool_or cardinality cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if "
    "cume_dist current_date date date_add date_diff date_format date_part date_sub date_trunc datediff day dayofmonth dayofweek dayofyear dense_rank div endswith equal_null every exp format_string hex printf "
    "extract first first_value floor format_number from_json get_json_object greatest grouping grouping_id hour if ifnull initcap instr isnotnull isnull json_array_length lag last last_day last_value "
    "lcase lead least left len length like listagg ln log log10 lower lpad ltrim make_date max max_by mean median min min_by minute mod month months_between nth_value ntile nullif nvl nvl2 percent_rank "
    "is_variant_null parse_json schema_of_variant to_json try_parse_json try_variant_get variant_get "
    "percentile percentile_approx position pow power quarter rank regexp_extract regexp_replace repeat replace reverse right round row_number rpad rtrim second sign some split sqrt startswith std stddev stddev_pop stddev_samp "
    "string_agg substr substring substring_index sum timestamp to_date to_timestamp translate trim trunc try_add try_avg try_cast try_divide try_subtract try_sum try_to_date typeof ucase unix_timestamp upper var_pop var_samp variance weekofyear when window year".split()
)

#: Functions that make a text of the length in their second argument, and those that do as their first argument's widths say.
LENGTHS = frozenset({"repeat", "lpad", "rpad"})
FORMATS = frozenset({"format_string", "printf"})
MOST_LENGTH = 10_000
#: Texts of such lengths can be put into each other, also by way of columns, so the product over a statement is bounded.
MOST_PRODUCT = 1_000_000
#: Aggregates that hold all values of a group, which must not come from a join without a condition.
HOLDING = frozenset({"collect_list", "collect_set", "listagg", "string_agg"})


class ValidationError(Exception):
    """violation_type: security (never retried) or schema (worth another try)."""

    def __init__(self, violation_type: str, message: str):
        super().__init__(message)
        self.violation_type = violation_type


@dataclass
class Verdict:
    is_valid: bool
    security_check: bool
    schema_check: bool
    validated_sql: str
    tables: list[str]
    warnings: list[str] = field(default_factory=list)


def _seq(items) -> Iterator:
    for k in range(items.size()):
        yield items.apply(k)


def _expressions(node) -> Iterator:
    """All expressions of a plan node, from the top down."""
    stack = list(_seq(node.expressions()))
    while stack:
        e = stack.pop()
        yield e
        stack += list(_seq(e.children()))


_SUBQUERIES = frozenset({"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"})


def _scoped(plan) -> Iterator[tuple]:
    """All plan nodes, with those of common table expressions and subqueries, each with the names of the expressions in its scope.

    A name counts behind its own definition, within its own WITH; in a recursive WITH within the definition too.
    """
    stack = [(plan, frozenset())]
    while stack:
        node, scope = stack.pop()
        yield node, scope
        stack += [(e.plan(), scope) for e in _expressions(node) if e.getClass().getSimpleName() in _SUBQUERIES]
        if node.nodeName() == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                defined = scope | {pair._1().lower()}
                stack.append((pair._2(), defined if node.allowRecursion() else scope))
                scope = defined
        stack += [(child, scope) for child in _seq(node.children())]


def _literal(call, place: int) -> str | None:
    arguments = list(_seq(call.arguments()))
    found = arguments[place] if len(arguments) > place else None
    return str(found.value()) if found is not None and found.getClass().getSimpleName() == "Literal" else None


def _check_size(function: str, call) -> int:
    """By how much a call can make a text longer; functions that make texts of any length must have literal counts and formats within bounds."""
    if function in LENGTHS:
        count = _literal(call, 1)
        if count is None or not re.fullmatch(r"\d{1,5}", count) or int(count) > MOST_LENGTH:
            raise ValidationError("security", f"{function} needs a literal length of at most {MOST_LENGTH}")
        return max(int(count), 1)
    if function in FORMATS:
        pattern = _literal(call, 0)
        if pattern is None or re.search(r"\d{4}", pattern):
            raise ValidationError("security", f"{function} needs a literal format with widths below 1000")
        return max([1, *map(int, re.findall(r"\d+", pattern))])
    if function == "format_number":
        digits = _literal(call, 1)
        if digits is None or (digits.isdigit() and int(digits) > 100) or len(digits) > 100:
            raise ValidationError("security", "format_number needs a literal format of at most 100 digits")
    return 1


def _check_join(node) -> None:
    """Aggregates that hold a whole group don't stand over a join without a condition."""
    held = any(e.getClass().getSimpleName() == "UnresolvedFunction" and ".".join(_seq(e.nameParts())).lower() in HOLDING for e in _expressions(node))
    stack = list(_seq(node.children())) if held else []
    while stack:
        below = stack.pop()
        if below.nodeName() == "Join" and below.condition().isEmpty() and below.joinType().toString() in ("Inner", "Cross"):
            raise ValidationError("security", "a list of values needs a join with a condition")
        stack += list(_seq(below.children()))


def _check_plan(plan, allowed: frozenset[str]) -> list[str]:
    """The tables that a plan reads; raises ValidationError for what isn't allowed."""
    relations: list[str] = []
    longer = 1
    for node, scope in _scoped(plan):
        name = node.nodeName()
        if name not in allowed:
            raise ValidationError("security", f"{name} isn't allowed in a query")
        if name == "UnresolvedTableValuedFunction" and (function := ".".join(_seq(node.name())).lower()) not in TABLE_FUNCTIONS:
            raise ValidationError("security", f"the table function {function} isn't allowed")
        _check_join(node)
        if name == "UnresolvedRelation":
            parts = list(_seq(node.multipartIdentifier()))
            if len(parts) != 1:
                raise ValidationError("schema", f"unknown table {'.'.join(parts)}")
            if parts[0].lower() not in scope:
                relations.append(parts[0])
        for e in _expressions(node):
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                function = ".".join(_seq(e.nameParts())).lower()
                if function not in FUNCTIONS:
                    raise ValidationError("security", f"the function {function} isn't allowed")
                longer *= _check_size(function, e)
                if longer > MOST_PRODUCT:
                    raise ValidationError("security", f"the lengths of generated texts multiply to more than {MOST_PRODUCT}")
            if kind in ("ExpressionWithUnresolvedIdentifier", "UnresolvedGenerator"):
                raise ValidationError("security", "identifiers and rows can't be generated")
    return relations


def _views(analysed) -> set[str]:
    """The names of the views that an analysed plan reads, without those that these read themselves."""
    found, stack = set(), [analysed]
    while stack:
        node = stack.pop()
        if node.nodeName() == "View":
            found.add(node.desc().identifier().table().lower())
            continue
        stack += list(_seq(node.children()))
        stack += [e.plan() for e in _expressions(node) if e.getClass().getSimpleName() in _SUBQUERIES]
    return found


def validate(spark: SparkSession, sql: str, tables: Iterable[str], strict: bool = False) -> Verdict:
    """Check a statement before it runs; raises ValidationError. strict: the text must begin with SELECT."""
    text = sql.strip().rstrip(";").strip()
    if strict and not re.match(r"(?i)select\b", text):
        raise ValidationError("security", "only SELECT statements are allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        kind = "security" if ";" in text else "schema"
        raise ValidationError(kind, f"the statement can't be parsed: {str(error).splitlines()[0]}") from error
    relations = _check_plan(plan, NODES if strict else NODES | WITH_NODES | TABLE_NODES)
    known = {t.lower() for t in tables}
    for name in relations:
        if name.lower() not in known:
            raise ValidationError("schema", f"unknown table {name}; known: {', '.join(sorted(known))}")
    try:
        analysed = spark.sql(text)._jdf.queryExecution().analyzed()  # nothing runs
    except AnalysisException as error:
        hint = (error.getMessageParameters() or {}).get("proposal")
        raise ValidationError("schema", str(error).splitlines()[0] + (f" Did you mean {hint}?" if hint else "")) from error
    if unlisted := _views(analysed) - known:
        raise ValidationError("schema", f"unknown table {', '.join(sorted(unlisted))}; known: {', '.join(sorted(known))}")
    return Verdict(True, True, True, text, sorted({r.lower() for r in relations}))


def cleaned(answer: str) -> str:
    """The SQL of a model's answer: without fences, blank lines and lines of prose, ending with a semicolon."""
    answer = re.sub(r"(?i)```\s*(sql)?", "", answer)
    prose = re.compile(r"(?i)^\s*(here|this|the|note|explanation)\b(?!.*\bfrom\b)")
    lines = [line for line in answer.splitlines() if line.strip() and not prose.match(line)]
    return "\n".join(lines).strip().rstrip(";") + ";"
