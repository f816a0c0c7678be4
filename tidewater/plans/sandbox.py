"""A read-only SQL surface: one SELECT over published views, refused before it runs if it reaches for anything else.

The statement is parsed, and its plan is walked node by node, expressions and subqueries included: only the kinds of nodes
and the functions that are named here may occur, only by their bare names, over published views and the statement's CTEs.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections.abc import Collection, Iterator

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

MAX_SQL_CHARS = 20_000
log = logging.getLogger(__name__)

#: Plan nodes that a SELECT may have.
NODES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Join Union Except Intersect SubqueryAlias UnresolvedRelation "
    "UnresolvedWith UnresolvedHaving WithWindowDefinition OneRowRelation UnresolvedSubqueryColumnAliases UnresolvedInlineTable "
    "LateralJoin Pivot Unpivot Tail Generate".split()
)
#: Functions that compute from their arguments alone, or give the time of the query.
FUNCTIONS = frozenset(
    "count count_if sum avg mean min max min_by max_by first last any_value median mode percentile percentile_cont percentile_approx approx_percentile "
    "approx_count_distinct stddev stddev_samp stddev_pop variance var_samp var_pop corr covar_samp covar_pop skewness kurtosis regr_slope "
    "regr_intercept regr_r2 collect_list collect_set array_agg string_agg listagg bool_and bool_or every some any grouping grouping_id histogram_numeric "
    "row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value "
    "between abs ceil ceiling floor round bround sqrt cbrt exp ln log log2 log10 log1p pow power sign signum greatest least mod pmod width_bucket "
    "isnan isnull isnotnull nullif nvl nvl2 ifnull coalesce if nanvl try_add try_subtract try_multiply try_divide try_avg try_sum "
    "lower lcase upper ucase trim ltrim rtrim btrim length char_length octet_length substring substr left right concat concat_ws replace translate "
    "split split_part regexp_extract regexp_extract_all regexp_replace regexp_like regexp_count rlike like ilike contains startswith endswith instr locate position "
    "lpad rpad reverse initcap ascii char md5 sha2 xxhash64 hash crc32 "
    "date to_date timestamp to_timestamp try_to_timestamp date_trunc trunc date_add date_sub date_diff datediff add_months months_between year "
    "quarter month day dayofmonth dayofweek dayofyear weekday weekofyear hour minute second extract date_part unix_timestamp unix_seconds "
    "unix_millis unix_micros timestamp_millis timestamp_seconds from_unixtime date_format make_date current_date current_timestamp now "
    "timestampdiff window "
    "array size cardinality array_contains array_distinct array_sort sort_array array_max array_min array_join array_position array_intersect "
    "array_union array_except element_at get slice flatten transform filter exists forall aggregate map map_keys map_values map_entries "
    "struct named_struct explode explode_outer posexplode inline get_json_object json_array_length cast string int bigint double boolean decimal".split()
)
#: Expressions that are no functions but name something outside the statement.
OUTSIDE = ("UnresolvedIdentifier", "Parameter", "VariableReference", "ScalarSubqueryReference", "PythonUDF", "ScalaUDF", "Invoke", "StaticInvoke", "Reflect")


class Refused(ValueError):
    pass


def items(seq: JavaObject) -> Iterator[JavaObject]:
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def walk(plan: JavaObject, views: frozenset[str]) -> None:
    """Refuse a node that isn't allowed; names of CTEs count within their own statement."""
    name = kind(plan)
    if name not in NODES:
        raise Refused(f"{name} is not allowed")
    if name == "UnresolvedRelation":
        parts = [str(p) for p in items(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0].lower() not in views:
            raise Refused(f"{'.'.join(parts)} is not a published view")
    if name == "UnresolvedWith":
        ctes = list(items(plan.cteRelations()))
        if plan.allowRecursion():
            raise Refused("a recursive CTE is not allowed")
        for cte in ctes:
            walk(cte._2(), views)
            views = views | {str(cte._1()).lower()}
    for child in items(plan.children()):
        walk(child, views)
    for expression in items(plan.expressions()):
        walk_expression(expression, views)


def walk_expression(node: JavaObject, views: frozenset[str]) -> None:
    name = kind(node)
    if any(x in name for x in OUTSIDE):
        raise Refused(f"{name} is not allowed")
    if name in ("UnresolvedFunction", "UnresolvedGenerator"):
        parts = [str(p) for p in items(node.nameParts())] if name == "UnresolvedFunction" else [node.name().unquotedString()]
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise Refused(f"function {'.'.join(parts)} is not allowed")
    for child in items(node.children()):
        walk_expression(child, views)
    if hasattr_java(node, "plan"):
        walk(node.plan(), views)


def hasattr_java(node: JavaObject, method: str) -> bool:
    return any(m.getName() == method and m.getParameterCount() == 0 for m in node.getClass().getMethods())


def gate(spark: SparkSession, sql: str, views: Collection[str]) -> None:
    """Raise :class:`Refused` unless ``sql`` is one query over ``views`` and its own CTEs."""
    if not isinstance(sql, str) or not sql.strip():
        raise Refused("no statement")
    if len(sql) > MAX_SQL_CHARS:
        raise Refused(f"{len(sql)} characters, the limit is {MAX_SQL_CHARS}")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise Refused(f"not one statement: {str(e).splitlines()[0]}") from None
    walk(plan, frozenset(v.lower() for v in views))


def attacks(path: str) -> list[str]:
    """Statements that must be refused whatever the views are; ``path`` is a file that exists."""
    far = ", ".join(f"{i} AS c{i}" for i in range(40))
    return [
        f"SELECT * FROM parquet.`{path}`", f"SELECT * FROM csv.`{path}`", f"SELECT * FROM text.`{path}`", f"SELECT * FROM `{path}`",
        "SELECT java_method('java.lang.System', 'getenv', 'PATH')", "SELECT reflect('java.lang.Runtime', 'getRuntime')",
        f"SELECT {far}, `java_method`('java.lang.System', 'getenv', 'PATH')", "SELECT system.builtin.java_method('java.lang.System', 'nanoTime')",
        "SELECT upper(lower(try_reflect('java.lang.System', 'getenv', 'PATH')))", "SELECT 1 WHERE EXISTS (SELECT java_method('java.lang.System', 'nanoTime'))",
        "WITH t AS (SELECT reflect('java.lang.System', 'nanoTime')) SELECT * FROM t", "SELECT transform(array(1), x -> java_method('java.lang.System', 'nanoTime'))",
        "SELECT sum(1) OVER (ORDER BY java_method('java.lang.System', 'nanoTime'))", "SELECT count(*) FILTER (WHERE java_method('java.lang.System', 'nanoTime') = '1')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'nanoTime')", "SELECT * FROM IDENTIFIER('system.x')", "SELECT input_file_name()", "SELECT current_user()", "SELECT version()",
        f"SELECT * FROM read_files('{path}')", "SELECT * FROM range(10)", "SELECT explode(sequence(1, 1000000000))", "SELECT raise_error('x')", "SELECT sleep(1)",
        "SET spark.sql.shuffle.partitions=1", "DROP VIEW v", "CREATE TABLE t AS SELECT 1", "INSERT INTO v VALUES (1)", "SHOW TABLES", "DESCRIBE v", "EXPLAIN SELECT 1", "CACHE TABLE v",
        f"ADD JAR '{path}'", f"LOAD DATA INPATH '{path}' INTO TABLE v", "SELECT 1; SELECT 2", "/* look */ SET x=1", "SELECT TRANSFORM(1) USING 'cat'", "USE default", "FROM v INSERT INTO w SELECT 1", "", "SELECT * FROM other",
    ]


def self_test(spark: SparkSession, path: str, views: Collection[str] = ("v",)) -> list[str]:
    """The attacks that pass the gate: none, if the surface is sound."""
    passed = []
    for sql in attacks(path):
        try:
            gate(spark, sql, views)
        except Refused:
            continue
        passed.append(sql)
    return passed


def run_sql(spark: SparkSession, sql: str, views: Collection[str], timeout_s: float = 30, max_rows: int = 200, max_cell: int = 500, max_chars: int = 50_000) -> dict:
    """Rows of a guarded query, cancelled after ``timeout_s``: cut to so many rows, characters a cell, and columns from the
    last on while the whole is above ``max_chars``. Numbers that aren't finite are null. Every call leaves a line in the log."""
    began = time.monotonic()
    entry = {"sql": sql, "status": "refused"}
    tag = f"sandbox-{uuid.uuid4().hex}"
    done = threading.Event()

    def watch() -> None:
        late = not done.wait(timeout_s)
        while late and not done.is_set():  # again and again: a job may not have begun, or be followed by the next
            spark.sparkContext.cancelJobsWithTag(tag)
            done.wait(0.5)

    try:
        gate(spark, sql, views)
        entry["status"] = "failed"
        spark.sparkContext.addJobTag(tag)
        threading.Thread(target=watch, daemon=True).start()
        df = spark.sql(sql)
        try:
            rows = df.limit(max_rows + 1).collect()
        except Exception as e:
            if "SPARK_JOB_CANCELLED" not in str(e):
                raise
            entry["status"] = "timeout"
            raise TimeoutError(f"the query took more than {timeout_s} s") from None
        entry |= {"status": "ok", "rows": len(rows)}
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
        log.info(json.dumps(entry | {"ms": round(1000 * (time.monotonic() - began))}))

    def cell(v: object) -> object:
        if v is None or isinstance(v, (bool, int)):
            return v
        if isinstance(v, float):
            return v if abs(v) < float("inf") else None
        return str(v)[:max_cell]

    cells = [[cell(v) for v in r] for r in rows[:max_rows]]
    columns = df.columns
    while len(columns) > 1 and sum(len(str(v)) for r in cells for v in r) > max_chars:
        columns, cells = columns[:-1], [r[:-1] for r in cells]
    return {"columns": columns, "rows": cells, "truncated": len(rows) > max_rows, "columns_dropped": len(df.columns) - len(columns)}
