"""Named SQL steps that read each other's results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..operators import ingest
from ..operators.references import reads


@dataclass(frozen=True)
class Step:
    """A SELECT under a name. What it needs of the other steps is found in it; `needs` may add what can't be seen there."""

    name: str
    sql: str
    needs: tuple[str, ...] = ()


@dataclass
class Outcome:
    name: str
    status: str  # done, failed or skipped
    rows: int | None = None
    error: str | None = None


def _marked(sql: str) -> str:
    return re.sub(r"\{\{\s*(\w+)\s*\}\}", r":\1", sql)


def needed(spark: SparkSession, step: Step, names: Sequence[str]) -> set[str]:
    """The steps that a step reads, by the parsed plan of its SQL. Under its own name it reads what was there before it."""
    by = {n.lower(): n for n in names if n != step.name}
    try:
        found = reads(spark, _marked(step.sql)).tables
    except ParseException:  # it fails when it is run
        found = set()
    return {by[t] for t in found if t in by}


def order(steps: Sequence[Step], spark: SparkSession | None = None) -> list[Step]:
    """Steps after those that they need; a cycle, an unknown need or a repeated name is an error and nothing runs."""
    by = {s.name: s for s in steps}
    if len({n.lower() for n in by}) < len(steps) or not all(re.fullmatch(r"[A-Za-z_]\w*", n) for n in by):
        raise ValueError("step names must be identifiers, each used once")
    if unknown := {n for s in steps for n in s.needs} - set(by):
        raise ValueError(f"no such step: {sorted(unknown)}")
    # in the order given wherever needs leave it open
    needs = {s.name: sorted(set(s.needs) | (needed(spark, s, list(by)) if spark else set()), key=list(by).index) for s in steps}
    try:
        return [by[n] for n in TopologicalSorter(needs).static_order()]
    except CycleError as e:
        raise ValueError(f"the steps form a cycle: {' -> '.join(e.args[1])}") from e


def with_parameters(spark: SparkSession, sql: str, parameters: dict[str, object]) -> DataFrame:
    """SQL with {{name}} markers, bound as parameters and never pasted; an unknown name is an error."""
    names = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", sql))
    if unknown := names - set(parameters):
        raise KeyError(f"no value for {sorted(unknown)}")
    return spark.sql(_marked(sql), args={n: parameters[n] for n in names})


def run(spark: SparkSession, steps: Sequence[Step], parameters: dict[str, object] | None = None, folder: str | None = None) -> list[Outcome]:
    """Runs the steps in order; each result is a view under the step's name. The first failure skips all that follow.

    With a folder each result is written there once and the view reads it, so no step is computed again by a later one; without,
    a result is a view only, and its rows are counted.
    """
    out: list[Outcome] = []
    for step in order(steps, spark):
        if out and out[-1].status != "done":
            out.append(Outcome(step.name, "skipped"))
            continue
        try:
            df = with_parameters(spark, step.sql, parameters or {})
            if folder:
                path = f"{folder.rstrip('/')}/{step.name}-{uuid.uuid4().hex}"
                df.write.parquet(path)
                df = spark.read.schema(df.schema).parquet(path)
            df.createOrReplaceTempView(step.name)
            out.append(Outcome(step.name, "done", df.count()))
        except Exception as e:  # noqa: BLE001  reported as the step's outcome
            out.append(Outcome(step.name, "failed", error=str(e).split("\n")[0]))
    return out


def save(spark: SparkSession, name: str, sql: str, view: bool = False) -> None:
    """Saves one SELECT under a name: as a table with its rows of now, or as a view that reads anew each time. What had the name is replaced."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a name: {name!r}")
    try:
        if found := reads(spark, sql).kinds:
            raise ValueError(f"only a SELECT can be saved, not {sorted(found)}")
    except ParseException as e:
        raise ValueError(f"only one SELECT can be saved: {str(e).splitlines()[0]}") from e
    body = sql.rstrip().rstrip(";")
    is_view = spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType == "VIEW"
    if spark.catalog.tableExists(name) and is_view != view:
        spark.sql(f"DROP {'VIEW' if is_view else 'TABLE'} {name}")
    if view:
        spark.sql(f"CREATE OR REPLACE VIEW {name} AS {body}")
    else:
        ingest.replace_whole(spark.sql(body), name)
