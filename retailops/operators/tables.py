"""Queries over any table: filters, search, paging, distinct values, running totals and shares."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def condition(df: DataFrame, column: str, operator: str, value) -> Column:
    """One filter of a table query; unknown operators mean equality. LIKE is case-sensitive and % and _ in the value are wildcards."""
    c, text = F.col(column), F.col(column).cast("string")
    typed = F.lit(value).cast(df.schema[column].dataType)
    return {
        "contains": lambda: text.like(f"%{value}%"), "startswith": lambda: text.like(f"{value}%"), "endswith": lambda: text.like(f"%{value}"),
        "greaterthan": lambda: c > typed, "lessthan": lambda: c < typed,
    }.get(operator.lower(), lambda: c == typed)()


def table_query(df: DataFrame, columns: Sequence[str] = (), filters: Sequence[tuple[str, str, object]] = (), sorts: Sequence[tuple[str, bool]] = (), page: int = 1, page_size: int | None = None) -> DataFrame:
    """Projection, ANDed filters (blank ones are skipped), sort (column, descending) and one page."""
    for column, operator, value in filters:
        if column and value not in (None, ""):
            df = df.where(condition(df, column, operator, value))
    if sorts:
        df = df.orderBy(*(F.desc(c) if d else F.asc(c) for c, d in sorts))
    df = df.select(*columns) if columns else df
    return df if page_size is None else df.offset((page - 1) * page_size).limit(page_size)


def filtered_count(df: DataFrame, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
    return table_query(df, filters=filters).agg(F.count("*").alias("n"))


def metric_filters(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    """Filters {column, operator, value, default, order}: = <> < > <= >= IN NOT IN LIKE NOT LIKE BETWEEN, all of which must hold.

    A value that isn't given is the default; blank ones say nothing. Lists, of IN and BETWEEN only, are separated by semicolons. LIKE
    takes its pattern as it is. BETWEEN without two values says nothing; an unknown operator is an equality.
    """
    for f in sorted(filters, key=lambda f: f.get("order") or 0):
        value = f.get("default") if f.get("value") is None else f["value"]
        if value is None or not str(value).strip():
            continue
        c, kind = F.col(f["column"]), df.schema[f["column"]].dataType
        one, parts = F.lit(str(value)).cast(kind), [F.lit(x.strip()).cast(kind) for x in str(value).split(";") if x.strip()]
        op = f["operator"].upper()
        if op in ("IN", "NOT IN") and not parts or op == "BETWEEN" and len(parts) != 2:
            continue
        made = {
            "<>": lambda: c != one, "<": lambda: c < one, ">": lambda: c > one, "<=": lambda: c <= one, ">=": lambda: c >= one,
            "IN": lambda: c.isin(parts), "NOT IN": lambda: ~c.isin(parts), "BETWEEN": lambda: c.between(*parts),
            "LIKE": lambda: c.cast("string").like(str(value)), "NOT LIKE": lambda: ~c.cast("string").like(str(value)),
        }.get(op, lambda: c == one)
        df = df.where(made())
    return df


def search(df: DataFrame, text: str | None, columns: Sequence[str] | None = None, each: dict[str, str] | None = None) -> DataFrame:
    """Rows that have the text in any of the columns, and each further text in its own column, ignoring case; blank ones are skipped."""
    has = lambda c, x: F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(x.lower()))
    if text and text.strip():
        df = df.where(reduce(Column.__or__, [has(c, text) for c in columns or df.columns]))
    for c, x in (each or {}).items():
        df = df.where(has(c, x)) if x and x.strip() else df
    return df


#: The columns that a search of the audit log looks at, as far as the log has them.
AUDIT_TEXTS = ("user_name", "user_id", "action", "table_name", "query_text", "details", "message")


def audit_search(df: DataFrame, company, text: str | None = None, equal: dict | None = None, start=None, end=None, columns: Sequence[str] = AUDIT_TEXTS, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Audit rows of one company from start to end, both included, newest first; without a company no rows."""
    if company in (None, ""):
        return df.limit(0)
    df = df.where(F.col("company_id") == company)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v) if v not in (None, "") else df
    if start is not None:
        df = df.where(F.col("event_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("event_time") <= F.lit(end).cast("timestamp_ntz"))
    found = search(df, text, [c for c in columns if c in df.columns]).orderBy(F.desc("event_time"), "event_id")
    return found if page_size is None else found.offset((page - 1) * page_size).limit(page_size)


def audit_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"), F.count_distinct("user_id").alias("users"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"))


def sorted_as_numbers(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort in which texts that look like numbers come first, by value."""
    number = F.col(column).cast("string").try_cast("double")
    d = (lambda c: c.desc_nulls_last()) if descending else (lambda c: c.asc_nulls_last())
    return df.orderBy(d(number), d(F.col(column)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def running_total(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """SUM(value) OVER (ORDER BY order) with peers sharing the value.

    Values are summed up by the order key first. Without a partition key the sums are dealt by range of the key; each range adds
    up its own, and the totals of the ranges before, one number a range, are broadcast. No task sees all keys.
    """
    sums = df.groupBy(*by, order).agg(F.sum(value).alias("_v"))
    if by:
        return sums.select(*by, order, F.sum("_v").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)).alias("running"))
    parts = sums.repartitionByRange(order).withColumn("_p", F.spark_partition_id())
    # one row a range: few enough for one sort and one broadcast
    before = parts.groupBy("_p").agg(F.sum("_v").alias("_t")).select("_p", (F.sum("_t").over(Window.orderBy("_p")) - F.col("_t")).alias("_b"))
    own = F.sum("_v").over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_p").select(order, (F.col("_own") + F.col("_b")).alias("running"))


def share_of_total(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's percent of the total; the total is one broadcast row."""
    sums = df.groupBy(key).agg(F.sum(value).alias("v"))
    total = F.broadcast(sums.agg(F.sum("v").alias("t")))
    return sums.crossJoin(total).select(key, F.round(F.col("v") * 100 / F.nullif(F.col("t"), F.lit(0.0)), 4).alias("share"))


def column_difference(left: DataFrame, right: DataFrame) -> tuple[list[str], list[str]]:
    """(missing in left, extra in left)."""
    return [c for c in right.columns if c not in left.columns], [c for c in left.columns if c not in right.columns]


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and mix of type families of each table."""
    out = None
    for name, df in tables.items():
        families = [_family(t) for _, t in df.dtypes]
        mix = " · ".join(f"{families.count(f)} {f}" for f in ("text", "num", "date", "bool", "other") if f in families)
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", F.lit(len(families)).alias("n_columns"), F.lit(mix).alias("types"))
        out = one if out is None else out.unionByName(one)
    return out


def dataset_totals(stats: DataFrame) -> DataFrame:
    """Tables, rows and columns of the tables of `statistics`, and a state: empty without tables or rows, else ready."""
    total = stats.agg(F.count("*").alias("n_tables"), F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum("n_columns"), F.lit(0)).cast("long").alias("n_columns"))
    return total.withColumn("state", F.when(F.col("n_rows") > 0, "ready").otherwise("empty"))


def _family(kind: str) -> str:
    return "text" if kind == "string" else "num" if kind.startswith(("int", "bigint", "double", "float", "decimal", "small", "tiny")) else "date" if kind.startswith(("date", "timestamp")) else "bool" if kind == "boolean" else "other"
