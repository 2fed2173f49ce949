"""Column grants and row filters: what a user may see of shared tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .references import only_select


def allowed_values(text: str) -> list[str]:
    """A JSON array of scalars as texts; anything else is refused."""
    try:
        values = json.loads(text)
    except ValueError as e:
        raise PermissionError(f"malformed filter: {text!r}") from e
    if not isinstance(values, list) or any(isinstance(v, (list, dict)) or v is None for v in values):
        raise PermissionError(f"malformed filter: {text!r}")
    return [str(v).lower() if isinstance(v, bool) else str(v) for v in values]


def secured(df: DataFrame, granted: Sequence[str], filters: Mapping[str, Sequence[str]], long_list: int = 200) -> DataFrame:
    """Granted columns of the rows that pass all filters. A filter on a column applies to any table that has it, ignoring case.

    An empty list lets no row pass; no granted column is refused. Long lists become a semi join instead of a long predicate.
    """
    names = {c.lower(): c for c in df.columns}
    columns = [names[g.lower()] for g in granted if g.lower() in names]
    if not columns:
        raise PermissionError("no readable column")
    for column, values in filters.items():
        c = names.get(column.lower())
        if c is None:
            continue
        if not values:
            df = df.where(F.lit(False))
        elif len(values) <= long_list:
            df = df.where(F.col(c).cast("string").isin(list(values)))
        else:
            allowed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], "_allowed string")
            df = df.join(allowed, F.col(c).cast("string") == F.col("_allowed"), "left_semi")
    return df.select(*columns)


def run_secured(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], grants: Mapping[str, Sequence[str]], filters: Mapping[str, Sequence[str]], masked: Sequence[str] = ()) -> DataFrame:
    """One SELECT over the granted tables only, as the user sees them, so that joins and aggregates see filtered rows.

    Files, other tables, table functions, commands and functions that aren't harmless built-in ones are refused before
    anything is resolved; a masked column in the result is refused after. The views that the statement is resolved with have names
    of their own and are gone when this returns.
    """
    granted = {name.lower(): name for name in tables if name in grants}
    read = only_select(spark, sql, set(granted)).tables
    views: dict[str, str] = {}
    try:
        for name in sorted(read):
            views[name] = f"_secured_{uuid.uuid4().hex}"
            secured(tables[granted[name]], grants[granted[name]], filters).createOrReplaceTempView(views[name])
        named = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
        body = sql.rstrip().rstrip(";")
        out = spark.sql(f"WITH {named} SELECT * FROM (\n{body}\n)" if named else body)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    if {c.lower() for c in out.columns} & {m.lower() for m in masked}:
        raise PermissionError("the result has a masked column")
    return out
