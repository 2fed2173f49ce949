"""What a SQL statement reads, from the session parser's own plan: tables, functions, and whatever is no part of a SELECT."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: The kinds of plan nodes that one SELECT is made of; anything else (commands, inserts, scripts, computed names, time travel) is not.
SELECT_NODES = frozenset(
    "Project Filter Aggregate UnresolvedHaving Join LateralJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith Sort GlobalLimit LocalLimit Offset Distinct "
    "Deduplicate Union Intersect Except Window WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation OneRowRelation$ Generate Pivot Unpivot UnresolvedHint Sample PipeOperator".split()
)
#: Functions that run code or tell of files and sessions.
UNSAFE = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_database current_schema current_catalog current_user user session_user version spark_partition_id".split())


@dataclass
class Reads:
    """Names are lower-case; parts of a name are joined by dots. `kinds` holds the plan nodes that are no part of a SELECT."""

    tables: set[str] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    kinds: set[str] = field(default_factory=set)


def _seq(items) -> Iterator:
    return (items.apply(i) for i in range(items.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def reads(spark: SparkSession, sql: str) -> Reads:
    """What one statement reads, subqueries and common table expressions included; what the statement itself defines is no table.

    A common table expression is known to those after it and to what the WITH belongs to, and nowhere else. More than one statement,
    and what the parser doesn't take, is a ParseException.
    """
    out = Reads()
    _walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset(), out)
    return out


def _walk(node, defined: frozenset[str], out: Reads) -> None:
    kind = _kind(node)
    if kind not in SELECT_NODES:
        out.kinds.add(kind)
    if kind == "UnresolvedRelation":
        name = ".".join(_seq(node.multipartIdentifier())).lower()
        if name not in defined:
            out.tables.add(name)
    for e in _seq(node.expressions()):
        _functions(e, out)
    if kind == "UnresolvedWith":
        for alias in _seq(node.innerChildren()):
            own = alias.alias().lower()
            _walk(alias, defined | {own} if node.allowRecursion() else defined, out)
            defined |= {own}
    else:
        for inner in _seq(node.innerChildren()):  # subqueries of the node's expressions
            _walk(inner, defined, out)
    for child in _seq(node.children()):
        _walk(child, defined, out)


def _functions(e, out: Reads) -> None:
    if _kind(e) == "UnresolvedFunction":
        out.functions.add(".".join(_seq(e.nameParts())).lower())
    for child in _seq(e.children()):
        _functions(child, out)


def built_in(spark: SparkSession, name: str) -> bool:
    c = spark.sparkContext._jvm.org.apache.spark.sql.catalyst
    known = c.FunctionIdentifier(name)
    return c.analysis.FunctionRegistry.builtin().functionExists(known) or c.analysis.TableFunctionRegistry.builtin().functionExists(known)


def only_select(spark: SparkSession, sql: str, tables: set[str]) -> Reads:
    """What a statement reads, if it is one SELECT over some of the tables (in lower case) with harmless built-in functions; else PermissionError."""
    try:
        found = reads(spark, sql)
    except ParseException as e:
        raise PermissionError(f"not one SELECT: {str(e).strip().splitlines()[0]}") from e
    if found.kinds:
        raise PermissionError(f"only a SELECT is allowed, not {sorted(found.kinds)}")
    if unknown := found.tables - tables:
        raise PermissionError(f"not among the tables: {sorted(unknown)}")
    if unsafe := sorted(f for f in found.functions if f in UNSAFE or not built_in(spark, f)):
        raise PermissionError(f"not among the functions: {unsafe}")
    return found
