"""Read-only SQL over one table: what may run, how many rows it may return, and for how long.

Spark's own parser reads the statement; the parsed plan is then walked. Only nodes that read and
compute are allowed, the only sources are the named tables and the statement's own CTEs, and
functions that reach outside of SQL are refused. Limits are applied on top of the plan.
"""

from __future__ import annotations

import threading
import time
import uuid
from functools import cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import Evidence

# Limits of a guarded query, and the plan nodes that it may consist of.
MOST_ROWS, SECONDS = 10_000, 30
ALLOWED = {"Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "LimitAll", "Offset", "Join", "SubqueryAlias", "UnresolvedWith", "UnresolvedRelation", "Distinct", "OneRowRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "WithWindowDefinition", "Window", "UnresolvedOrderBy"}
SET_OPERATIONS = {"Union", "Intersect", "Except"}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
FORBIDDEN_FUNCTIONS = {"java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "read_files", "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "version", "spark_partition_id", "assert_true", "raise_error", "from_avro", "to_avro"}


class GuardError(ValueError):
    """A statement that may not run."""


@cache
def own_functions(spark: SparkSession) -> frozenset[str]:
    """The names of Spark's own functions; what a session registered is not among them."""
    return frozenset(r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect())


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _check(plan, tables: set[str], set_operations: bool, known: frozenset[str]) -> None:
    kind = plan.nodeName()
    if kind not in ALLOWED and not (set_operations and kind in SET_OPERATIONS):
        raise GuardError(f"{kind} is not allowed")
    if kind == "UnresolvedWith":
        for pair in _list(plan.cteRelations()):
            tables = tables | {pair.productElement(0).lower()}
            _check(pair.productElement(1), tables, set_operations, known)
    if kind == "UnresolvedRelation":
        parts = _list(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0].lower() not in tables:
            raise GuardError(f"unknown source {'.'.join(parts)}")
    for e in _list(plan.expressions()):
        _check_expression(e, tables, set_operations, known)
    for child in _list(plan.children()):
        _check(child, tables, set_operations, known)


def _check_expression(e, tables: set[str], set_operations: bool, known: frozenset[str]) -> None:
    if e.getClass().getSimpleName() == "UnresolvedFunction":
        name = _list(e.nameParts())[-1].lower()
        if name in FORBIDDEN_FUNCTIONS or name not in known:
            raise GuardError(f"function {name} is not allowed")
    if hasattr(e, "plan") and e.getClass().getSimpleName() in SUBQUERIES:
        _check(e.plan(), tables, set_operations, known)
    for child in _list(e.children()):
        _check_expression(child, tables, set_operations, known)


def validate(spark: SparkSession, sql: str, tables: set[str] = frozenset({"dataset"}), set_operations: bool = False) -> None:
    """Raise GuardError unless sql is one read-only query over the tables."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except PySparkException as error:
        raise GuardError(f"not a query: {error}") from error
    _check(plan, {t.lower() for t in tables}, set_operations, own_functions(spark))


def guarded(df: DataFrame, sql: str, table: str = "dataset", most: int = MOST_ROWS, ready: bool = True, seconds: float = SECONDS) -> DataFrame:
    """The result of a guarded query over df, of at most `most` rows. Views of the session stay as they are.

    Scalar subqueries that stand alone are answered first (ready), within `seconds`, so that Spark plans with their values: a bound
    on a rank that is a number keeps whole groups out of the sort of a window."""
    spark = df.sparkSession
    validate(spark, sql, {table})
    before = spark.table(table) if any(t.isTemporary and t.name == table for t in spark.catalog.listTables()) else None
    df.createOrReplaceTempView(table)
    try:
        return spark.sql(answered_subqueries(spark, sql, table, seconds) if ready else sql).limit(most)
    finally:
        if before is None:
            spark.catalog.dropTempView(table)
        else:
            before.createOrReplaceTempView(table)


def _scalar_subqueries(plan, found: list[tuple[int, int]], names: set[str]) -> None:
    """Where outermost scalar subqueries stand in the statement, and the names of its CTEs."""

    def within(e) -> None:
        if e.getClass().getSimpleName() == "ScalarSubquery":
            origin = e.origin()
            if origin.startIndex().isDefined() and origin.stopIndex().isDefined():
                found.append((origin.startIndex().get(), origin.stopIndex().get()))
            return
        if e.getClass().getSimpleName() in SUBQUERIES:
            _scalar_subqueries(e.plan(), found, names)
        for child in _list(e.children()):
            within(child)

    if plan.nodeName() == "UnresolvedWith":
        for pair in _list(plan.cteRelations()):
            names.add(pair.productElement(0).lower())
            _scalar_subqueries(pair.productElement(1), found, names)
    for e in _list(plan.expressions()):
        within(e)
    for child in _list(plan.children()):
        _scalar_subqueries(child, found, names)


def answered_subqueries(spark: SparkSession, sql: str, table: str, seconds: float) -> str:
    """sql with the values of scalar subqueries over the table that refer to nothing outside of them and are whole numbers."""
    found, names = [], set()
    _scalar_subqueries(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), found, names)
    if table.lower() in names:  # a CTE of the table's name stands for something else
        return sql
    for start, stop in sorted(set(found), reverse=True):
        text = sql[start : stop + 1]
        if not (text.startswith("(") and text.endswith(")")):
            continue
        try:
            one = spark.sql(text[1:-1])
        except PySparkException:  # it refers to the statement around it
            continue
        kind = one.dtypes[0][1]
        if kind not in ("tinyint", "smallint", "int", "bigint") or not one._jdf.queryExecution().optimizedPlan().deterministic():
            continue
        rows = collect_within(one.limit(2), seconds)
        if len(rows) < 2:  # more than one row is an error, which the statement itself gives
            value = rows[0][0] if rows else None
            sql = f"{sql[:start]}CAST({'NULL' if value is None else repr(str(value))} AS {kind}){sql[stop + 1 :]}"
    return sql


def table_reads(plan, table: str, top=None) -> list[tuple]:
    """For each place where an analysed plan reads the table: the plan with all conditions (WHERE, and of derived tables)
    right above it, and the attributes of the table."""
    kind = plan.nodeName()
    if kind == "SubqueryAlias" and plan.alias().lower() == table.lower() and plan.child().nodeName() == "View":
        return [(top or plan, _list(plan.output()))]
    if kind in ("Filter", "SubqueryAlias", "Project"):
        top = top or (plan if kind == "Filter" else None)
    else:
        top = None
    found = []
    for child in _list(plan.children()):
        found += table_reads(child, table, top)
    for e in _list(plan.subqueries()):
        found += table_reads(e, table)
    return found


def _attributes(plan, found: set[int]) -> set[int]:
    """Ids of the attributes that an optimised plan returns or that any node refers to; a local table that has filtered by itself has them as output."""
    for attribute in _list(plan.output()):
        found.add(attribute.exprId().id())
    todo = [plan]
    while todo:
        node = todo.pop()
        found |= {x.exprId().id() for x in _list(node.references().toSeq())}
        if node.nodeName() == "LocalRelation":
            found |= {x.exprId().id() for x in _list(node.output())}
        todo += [*_list(node.children()), *_list(node.subqueries())]
    return found


def _conditions(plan, found: set[int]) -> set[int]:
    """Ids of the attributes in the conditions of an analysed plan."""
    if plan.nodeName() in ("Filter", "Join"):
        found |= {a.exprId().id() for e in _list(plan.expressions()) for a in _list(e.references().toSeq())}
    for child in [*_list(plan.children()), *_list(plan.subqueries())]:
        _conditions(child, found)
    return found


def scope_of(df: DataFrame, result: DataFrame, table: str) -> tuple[list[str], int, int]:
    """What a result over the table df rests on: the columns that reach the pruned plan, the rows of df that pass the
    conditions right above the statement's first read of it, and all rows. One job counts both, where conditions see df's columns alone."""
    run = result._jdf.queryExecution()
    reads = table_reads(run.analyzed(), table)
    used = _conditions(run.analyzed(), _attributes(run.optimizedPlan(), set()))
    columns = [c for i, c in enumerate(df.columns) if any(attributes[i].exprId().id() in used for _, attributes in reads)]
    total = df.count()
    if not reads or reads[0][0].nodeName() == "SubqueryAlias":
        return columns, total, total
    spark = df.sparkSession
    scope = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, reads[0][0])
    return columns, DataFrame(scope, spark).count(), total


def answered(df: DataFrame, sql: str, table: str = "dataset", most: int = MOST_ROWS, seconds: float = SECONDS) -> tuple[list, Evidence]:
    """The rows of a guarded query, with what they rest on: the query, the columns that it reads, how many rows meet its conditions and how many there are."""
    began = time.monotonic()
    rows = collect_within(guarded(df, sql, table, most, seconds=seconds), max(seconds - (time.monotonic() - began), 0.001))
    # what the statement rests on is told by its plan as it was written
    columns, scope, total = scope_of(df, guarded(df, sql, table, most, ready=False), table)
    return rows, Evidence(sql, columns, [], scope, total, time.monotonic() - began)


def collect_within(df: DataFrame, seconds: float = SECONDS) -> list:
    """df's rows, or TimeoutError; the jobs are cancelled and the session stays usable."""
    sc, tag, late = df.sparkSession.sparkContext, f"guarded-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    sc.setInterruptOnCancel(True)
    sc.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"no result within {seconds} s") from error
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
        sc.setInterruptOnCancel(False)
