"""Guarded exploration: answers that can never contain a denied column."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from typing import Any
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lakegauge.dataset import Dataset, column, constant_rows
from lakegauge.functions.numbers import rounded
from lakegauge.operators.profile import check_column
from lakegauge.plans.metrics import _aggregate

# defaults of guarded answers; a caller's own limit holds as stated
MAX_ROWS = 200
MAX_SAMPLE = 15
TIMEOUT_SECONDS = 10


class GuardError(ValueError):
    """A question the guard refuses."""


def adhoc_aggregate(
    ds: Dataset,
    table: str,
    measure: str,
    op: str,
    group_by: str | None = None,
    where: Mapping[str, Any] | None = None,
    denied: tuple[str, ...] = (),
    limit: int | None = None,
) -> DataFrame:
    """One of the nine aggregations, optionally grouped, with equality filters; all groups unless limited."""
    for name in (measure, *([group_by] if group_by else []), *(where or {})):
        check_column(ds, table, name, denied)
    rows = ds.table(table)
    for name, value in (where or {}).items():
        rows = rows.where(column(name) == value)
    keys = [column(group_by).alias("grp")] if group_by else []
    found = _aggregate(
        rows.select(*keys, column(measure).alias("measure")), ["grp"] if group_by else [], op
    )
    if not group_by:
        return found
    ordered = found.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("grp"))
    return ordered if limit is None else ordered.limit(limit)


def sample_contains(
    ds: Dataset,
    table: str,
    columns: list[str],
    needle: str | None = None,
    personal: tuple[str, ...] = (),
    limit: int = MAX_SAMPLE,
) -> DataFrame:
    """A few rows, optionally those where any column contains the text.

    The text is compared literally and without case; rows come in the order
    of the chosen columns.
    """
    for name in columns:
        check_column(ds, table, name)
        if name in personal:
            raise GuardError(f"{table}.{name} is personal data and cannot be sampled")
    rows = ds.table(table).select(*[column(c) for c in columns])
    if needle:
        found = [F.lower(column(c).cast("string")).contains(needle.lower()) for c in columns]
        rows = rows.where(reduce(lambda a, b: a | b, found))
    return rows.orderBy(*[column(c) for c in columns]).limit(limit)


def value_set_coverage(ds: Dataset, table: str, name: str, candidates: list[str]) -> DataFrame:
    """``candidate, present`` for each supposed value of a column.

    The distinct values are compared where they are; only the candidates, a
    list the caller wrote, are broadcast.
    """
    check_column(ds, table, name)
    wanted = constant_rows(
        ds.spark, [(i, c) for i, c in enumerate(candidates)], "place int, candidate string"
    )
    values = (
        ds.table(table)
        .select(column(name).cast("string").alias("candidate"))
        .join(F.broadcast(wanted.select("candidate").distinct()), "candidate", "left_semi")
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return wanted.join(values, "candidate", "left").select(
        "place", "candidate", F.coalesce("present", F.lit(False)).alias("present")
    )


def coverage_summary(ds: Dataset, table: str, name: str, candidates: list[str]) -> DataFrame:
    """Coverage of the candidates, absent ones, and their share of real values."""
    tested = value_set_coverage(ds, table, name, candidates)
    counts = tested.agg(
        F.count_if("present").alias("matched"),
        F.count(F.lit(1)).alias("candidates"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(~F.col("present"), F.struct("place", "candidate")))),
                lambda c: c["candidate"],
            ),
            ", ",
        ).alias("absent"),
    ).withColumn("table", F.lit(table))
    real = (
        ds.table(table).agg(F.count_distinct(column(name)).alias("real_values")).withColumn("table", F.lit(table))
    )
    return counts.join(real, "table").select(
        "table",
        F.lit(name).alias("column"),
        "matched",
        "candidates",
        "absent",
        "real_values",
        F.when(F.col("candidates") > 0, rounded(F.col("matched") / F.col("candidates"), 4))
        .otherwise(0.0)
        .alias("coverage_ratio"),
    )


def search_records(
    ds: Dataset,
    table: str,
    filters: Mapping[str, Any] | None = None,
    denied: tuple[str, ...] = (),
    order_by: Iterable[str] = (),
    limit: int = 20,
) -> DataFrame:
    """Rows that match exactly, without denied columns, in a stated order."""
    visible = ds.table(table).drop(*denied)
    unknown = [c for c in (filters or {}) if c not in visible.columns]
    if unknown:
        raise GuardError(f"unknown or denied filter columns {unknown}")
    rows = visible
    for name, value in (filters or {}).items():
        rows = rows.where(column(name) == value)
    order = [column(c) for c in order_by] or [column(c) for c in visible.columns]
    return rows.orderBy(*order).limit(limit)


# ------------------------------------------------------------------ guarded SQL

# functions that run code or tell where files lie, and the expressions they become
FORBIDDEN_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length"})
FORBIDDEN_EXPRESSIONS = frozenset({"CallMethodViaReflection", "InputFileName", "InputFileBlockStart", "InputFileBlockLength"})

#: Nodes of a resolved query that only work on what lies below them.
_OPERATORS = frozenset(
    {
        "Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "Sort", "Window", "WithWindowDefinition",
        "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Tail", "SubqueryAlias", "Union", "Distinct", "Deduplicate",
        "Intersect", "Except", "Generate", "Expand", "Sample", "ResolvedHint", "WithCTE", "CTERelationDef", "UnionLoop",
        "RepartitionByExpression", "Repartition", "RebalancePartitions",
    }
)
#: Leaves that hold constants, or stand for a common table whose definition is in the same tree.
_CONSTANTS = frozenset({"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef"})


def _seq(items) -> list:
    return [items.apply(i) for i in range(items.size())]


def _check_resolved(plan, views: set[str]) -> None:
    """Refuse a resolved query that reads anything but ``views``, in any scope.

    Names have been looked up by then, so neither a common table that shares a
    name, nor a name put together by an expression, hides what is read: every
    leaf must be a constant or lie under one of the session's own views.  Kinds of nodes
    that are not known are refused.
    """
    plans, expressions = [plan], []
    while plans or expressions:
        if plans:
            node = plans.pop()
            kind = node.getClass().getSimpleName()
            if kind == "View":
                name = node.desc().identifier()
                if not node.isTempView() or name.database().isDefined() or name.table().lower() not in views:
                    raise GuardError(f"{name.unquotedString()} is not one of the views")
                continue  # what lies below was put there by the guard
            if kind not in _OPERATORS and kind not in _CONSTANTS:
                raise GuardError(f"the statement reads or does more than the views allow ({kind})")
            plans += _seq(node.children()) + _seq(node.subqueries())
            expressions += _seq(node.expressions())
        else:
            node = expressions.pop()
            if node.getClass().getSimpleName() in FORBIDDEN_EXPRESSIONS:
                raise GuardError("the statement calls a function that is not allowed")
            expressions += _seq(node.children())


def _functions_of(plan) -> set[str]:
    """Names of the functions that an unresolved plan calls, subqueries included."""
    functions: set[str] = set()
    plans, expressions = [plan], []
    while plans or expressions:
        if plans:
            node = plans.pop()
            kind = node.getClass().getSimpleName()
            if kind == "UnresolvedTableValuedFunction":
                functions.add(_seq(node.name())[-1].lower())
            elif kind == "UnresolvedWith":
                plans += [pair._2() for pair in _seq(node.cteRelations())]
            plans += _seq(node.children()) + _seq(node.subqueries())
            expressions += _seq(node.expressions())
        else:
            node = expressions.pop()
            if node.getClass().getSimpleName() == "UnresolvedFunction":
                functions.add(_seq(node.nameParts())[-1].lower())
            expressions += _seq(node.children())
    return functions


class GuardedSql:
    """Free SELECT statements over tables that lack their denied columns.

    The statement is parsed alone first, so that it cannot leave the subquery it
    is wrapped in, and forbidden calls are refused before the resolver could
    fold them.  The resolved tree may read the registered views only.  It runs in
    a session whose views lack the denied columns.
    """

    def __init__(
        self,
        spark: SparkSession,
        load: Callable[[SparkSession], Dataset],
        denied: Mapping[str, Iterable[str]] | None = None,
        max_rows: int = MAX_ROWS,
    ) -> None:
        self.session = spark.newSession()
        for setting, value in {
            "spark.sql.runSQLOnFiles": "false",
            "spark.sql.variable.substitute": "false",
            "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
            "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        }.items():
            self.session.conf.set(setting, value)
        self.max_rows = max_rows
        self.views: set[str] = set()
        for name, df in load(self.session).without(denied or {}).tables.items():
            df.createOrReplaceTempView(name)
            self.views.add(name.lower())

    def query(self, sql: str) -> DataFrame:
        state = self.session._jsparkSession.sessionState()
        plan = state.sqlParser().parsePlan(sql)
        wrapped = f"SELECT * FROM (\n{sql}\n) LIMIT {self.max_rows}"
        state.sqlParser().parsePlan(wrapped)  # a query, not a command
        if _functions_of(plan) & FORBIDDEN_FUNCTIONS:
            raise GuardError("the statement calls a function that is not allowed")
        try:
            found = self.session.sql(wrapped)
        except AnalysisException as error:
            if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":  # as for a table that is there
                raise GuardError("the statement names something that is not one of the views") from None
            raise
        _check_resolved(found._jdf.queryExecution().analyzed(), self.views)
        return found.limit(self.max_rows)

    def rows(self, sql: str, seconds: float = TIMEOUT_SECONDS) -> list[Row]:
        """The statement's rows, or a TimeoutError after so many seconds."""
        return rows_within(self.query(sql), seconds, self.max_rows)

    def answer(self, sql: str, seconds: float = TIMEOUT_SECONDS) -> DataFrame:
        """The statement's rows, at most ``max_rows``, computed within the time limit, as a table of constants."""
        return answer_within(self.query(sql), seconds, self.max_rows)


@contextmanager
def time_limit(spark: SparkSession, seconds: float = TIMEOUT_SECONDS) -> Iterator[None]:
    """Jobs started inside carry a tag of their own, and are cancelled by it after ``seconds`` with a TimeoutError.

    Tags belong to the thread, and a job may have several, so that questions
    may run side by side or inside one another, each with its own limit.
    """
    context = spark.sparkContext
    tag = f"lakegauge-{uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"query exceeded {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def rows_within(df: DataFrame, seconds: float = TIMEOUT_SECONDS, max_rows: int = MAX_ROWS) -> list[Row]:
    """The first rows of a result; its jobs are cancelled after the time limit."""
    with time_limit(df.sparkSession, seconds):
        return df.limit(max_rows).collect()


def answer_within(df: DataFrame, seconds: float = TIMEOUT_SECONDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """``rows_within`` as a DataFrame of the same columns, which needs no further job; at most ``max_rows`` rows are held."""
    return df.sparkSession.createDataFrame(rows_within(df, seconds, max_rows), df.schema)
