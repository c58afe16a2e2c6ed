"""The engine's front: questions and SQL in, envelopes out; ingest and index upkeep."""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.chart import chart_spec
from tidemark.operators.execute import MAX_ROWS, execute, json_value
from tidemark.operators.insight import insight
from tidemark.operators.retrieval import Embedder, Index, retrieved
from tidemark.operators.schema_docs import schema_documents
from tidemark.operators.values import ValueIndex
from tidemark.plans.compiler import shape, to_dataframe, to_sql
from tidemark.plans.guard import ValidationError, Verdict, cleaned, validate
from tidemark.plans.planner import QueryPlan, TextModel, parsed, planned
from tidemark.plans.semantics import Semantics
from tidemark.sources.catalog import Catalog, Keys
from tidemark.sources.csv import read_csv, replace_table, table_name
from tidemark.sources.keys import Sketch, discovered
from tidemark.sources.script import run_script

ATTEMPTS = 3
RETRIEVED = 5
QUESTION_LENGTH = (3, 1000)


@dataclass
class Log:
    """What each step of an answer did, and when."""

    entries: list[dict[str, Any]] = field(default_factory=list)

    def add(self, agent: str, status: str, detail: str = "") -> None:
        self.entries.append({"agent": agent, "status": status, "detail": detail, "timestamp_ms": int(time.time() * 1000)})


def timeline(log: DataFrame) -> DataFrame:
    """(agent, status, timestamp_ms): the last entry of each agent; log: agent, status, timestamp_ms, seq."""
    last = F.max_by(F.struct("status", "timestamp_ms"), F.struct("timestamp_ms", "seq"))
    return log.groupBy("agent").agg(last.alias("last")).select("agent", "last.status", "last.timestamp_ms")


class Engine:
    """Tables with their meaning, an index over their descriptions, and answers to questions.

    Without a text model, plans and SQL are made by rules; with one, it writes both and every statement of it goes through
    the guard, with the reason of a refusal in its next prompt.
    """

    def __init__(self, spark: SparkSession, base_dir: str, semantics: Semantics | None = None, model: TextModel | None = None, embed: Embedder | None = None):
        self.spark, self.base_dir, self.semantics, self.model, self.embed = spark, base_dir, semantics, model, embed
        self.catalog = Catalog(spark)
        self._index: Index | None = None
        self._values = ValueIndex(spark, f"{base_dir}/values", semantics.named_columns() if semantics else {})
        self._unread: set[str] = set()
        self._sketches: dict[str, list[Sketch]] = {}

    def register(self, name: str, df: DataFrame, keys: Keys | None = None, version: str = "") -> None:
        """Add a table or replace it. version: tells rows apart that the schema doesn't, such as those of two uploads."""
        self.catalog.register(name, df, keys, version)
        self._unread.add(name)
        self._sketches.pop(name, None)

    def values(self) -> ValueIndex:
        """The index of the tables' values; those of tables that are new since the last question are read now."""
        while self._unread:
            name = self._unread.pop()
            self._values.add(name, self.spark.table(name))
        return self._values

    def ingest_csv(self, path: str) -> dict[str, Any]:
        """Replace the table named after a CSV file by its contents."""
        name = table_name(path)
        self.register(name, replace_table(read_csv(self.spark, path), name, f"{self.base_dir}/tables"), version=uuid.uuid4().hex)
        self.find_keys()
        self.index()
        Index.vacuum(self.spark, f"{self.base_dir}/index")
        return {"success": True, "table_name": name, "total_tables": len(self.catalog.tables()), "message": f"the table {name} is ready"}

    def bootstrap(self, path: str) -> list[str]:
        """The tables of a script of CREATE TABLE and INSERT statements; a script that has run before is not run again."""
        row = self.spark.read.text(path, wholetext=True).first()
        made = run_script(self.spark, row.value if row else "", self.base_dir)
        for name, (df, keys) in made.items():
            self.register(name, df, keys, version=hashlib.sha256(row.value.encode()).hexdigest())
        return list(made)

    def find_keys(self) -> None:
        """Give tables that came without keys those that their rows show."""
        for name, keys in discovered({name: self.spark.table(name) for name in self.catalog.tables()}, self._sketches).items():
            if self.catalog.keys[name] == Keys():
                self.catalog.keys[name] = keys

    def index(self) -> Index:
        """The index over the present tables: the one at hand, the one kept, or a version with what is new described."""
        now = self.catalog.fingerprints()
        if self._index is None or self._index.fingerprints != now:
            self._index = Index.updated(self.spark, f"{self.base_dir}/index", now, lambda names: schema_documents(self.catalog, names), self.embed)
        return self._index

    def health(self) -> dict[str, Any]:
        return {"status": "healthy", "index_ready": self._index is not None}

    def info(self) -> dict[str, Any]:
        return {"name": "tidemark", "tables": self.catalog.tables(), "max_result_rows": MAX_ROWS}

    def sql(self, statement: str, strict: bool = False) -> DataFrame:
        """A guarded statement as a DataFrame."""
        return self.spark.sql(validate(self.spark, statement, self.catalog.tables(), strict).validated_sql)

    def _plan(self, question: str) -> QueryPlan:
        if self.model is not None:
            prompt = f"Turn the question into a JSON plan with intent, metrics, filters, grouping and steps.\nQuestion: {question}"
            return parsed(question, self.model.complete(prompt, as_json=True))
        if self.semantics is None:
            raise ValueError("questions need a semantic model or a text model")
        return planned(question, self.semantics, self.values())

    def _statement(self, plan: QueryPlan, context: str, as_of: dt.date, refusal: str | None) -> tuple[str, DataFrame | None]:
        if self.model is None:
            s = shape(plan, self.semantics, as_of)
            return to_sql(s), to_dataframe(s, self.spark.table)
        parts = ["Write one SELECT statement of Spark SQL.", f"Today is {as_of.isoformat()}.", f"Question: {plan.original_query}", plan.as_text(), context]
        if refusal:
            parts.append(f"The last statement was refused: {refusal}")
        return cleaned(self.model.complete("\n\n".join(parts))), None

    def ask(self, question: str, as_of: dt.date | None = None) -> dict[str, Any]:
        """Answer a question; failures are part of the envelope. as_of: the day that 'last month' and the like refer to."""
        began, log = time.perf_counter(), Log()
        as_of = as_of or dt.date.today()
        envelope: dict[str, Any] = {"success": False, "query": question, "sql": None, "result": {"columns": [], "rows": [], "row_count": 0}, "insight": None}
        envelope |= {"llm_mode": "model" if self.model else "rules", "metadata": {}, "agent_logs": log.entries}

        def done(**more: Any) -> dict[str, Any]:
            envelope["metadata"]["pipeline_time_seconds"] = round(time.perf_counter() - began, 3)
            return envelope | more

        try:
            if not QUESTION_LENGTH[0] <= len(question) <= QUESTION_LENGTH[1]:
                raise ValueError(f"a question has {QUESTION_LENGTH[0]} to {QUESTION_LENGTH[1]} characters")
            plan = self._plan(question)
            log.add("planner", "completed", plan.intent)
            hits = self.index().search(plan.search_text(), RETRIEVED).collect()
            found = retrieved(hits)
            log.add("retrieval", "completed", ", ".join(found["retrieved_tables"]))
            verdict, ready = self._generated(plan, found["schema_context"], as_of, log)
            envelope["sql"] = verdict.validated_sql
            df = ready if ready is not None else self.spark.sql(verdict.validated_sql)
            result = execute(df)
            if not result.success:
                log.add("execution", "failed", result.error or "")
                return done(error=result.error)
            log.add("execution", "completed", f"{result.row_count} rows")
            envelope["result"] = {"columns": result.columns, "rows": [{c: json_value(v) for c, v in row.items()} for row in result.rows], "row_count": result.row_count}
            bounded = self.spark.createDataFrame([tuple(r.values()) for r in result.rows], df.toDF(*result.columns).schema)
            spec = chart_spec(bounded, plan.intent)
            value = spec["values"][-1] if spec else None
            envelope["insight"] = insight(bounded, spec["label"] if spec else None, value, plan.intent == "trend")
            log.add("insight", "completed")
            envelope["metadata"] = {"execution_time_ms": result.execution_time_ms, "tables_used": verdict.tables, "plan": plan.as_dict(), "validation_warnings": verdict.warnings, "chart": spec, "truncated": result.truncated}
            return done(success=True)
        except Exception as error:  # whatever fails is told in the envelope
            log.add("pipeline", "failed", str(error))
            return done(error=str(error))

    def _generated(self, plan: QueryPlan, context: str, as_of: dt.date, log: Log) -> tuple[Verdict, DataFrame | None]:
        """A statement that the guard accepts, within ATTEMPTS tries; a breach of security isn't tried again."""
        refusal = None
        for attempt in range(1, ATTEMPTS + 1):
            statement, ready = self._statement(plan, context, as_of, refusal)
            log.add("sql", "completed", f"attempt {attempt}")
            try:
                verdict = validate(self.spark, statement, self.catalog.tables())
                log.add("validator", "completed", ", ".join(verdict.tables))
                return verdict, ready
            except ValidationError as error:
                log.add("validator", "failed", str(error))
                if error.violation_type == "security" or attempt == ATTEMPTS:
                    raise
                refusal = str(error)
        raise AssertionError("unreachable")
