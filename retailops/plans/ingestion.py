"""Ingestion runs: read, type, load, move the watermark on and record the run.

Two tables keep what outlives a run: `runs` (one row for each run) and `watermarks` (rows of states; the newest of a source counts).
Both are only appended to, so a run that dies leaves no half-changed row. An incremental run first writes that it is open: if it
dies, the next one finds that, and takes the watermark from the table itself, so that nothing is appended twice, however far the
load had come. A source whose table is a `Bucketed` one keeps its watermark in that table's manifest, with the load.

What a run reads is read once; rows are counted on the way.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..operators.buckets import Bucketed
from ..session import kept, seen
from ..sources import files

RUNS = "run_id string, source string, started_at timestamp, finished_at timestamp, status string, inserted long, updated long, skipped long, error string"
WATERMARKS = "source string, column_name string, value string, saved_at timestamp, state string"

#: (session, last watermark or None) -> staged rows past it.
Reader = Callable[[SparkSession, "str | None"], DataFrame]


@dataclass(frozen=True)
class Source:
    """Where rows come from and how they go into a table: one of the catalog, or the folder of a `Bucketed` one."""

    name: str
    table: str | Bucketed
    read: Reader
    mode: str = "append"
    keys: Sequence[str] = ()
    incremental: str | None = None
    create: bool = True


@dataclass(frozen=True)
class Run:
    run_id: str
    status: str
    inserted: int = 0
    updated: int = 0
    skipped: int = 0
    watermark: str | None = None
    error: str | None = None


def from_file(path: str, kind: str | None = None) -> Reader:
    """A whole file; the rows past the watermark are found once they have the table's types."""
    return lambda spark, last: files.read_staged(spark, path, kind)


def from_query(query: str, incremental: str | None = None) -> Reader:
    return lambda spark, last: ingest.newer_than(spark.sql(query), incremental, last) if incremental else spark.sql(query)


def from_database(url: str, query: str, incremental: str | None = None, partition: tuple[str, int, int, int] | None = None, properties: dict[str, str] | None = None, keys: Sequence[str] = (), parts: int = 8) -> Reader:
    """The watermark becomes part of the query, so that the database reads past it only; in parallel by `partition` or by a key."""
    return lambda spark, last: files.read_jdbc(spark, url, query=files.incremental_sql(query, incremental, _number(last)) if incremental else query, partition=partition, properties=properties, keys=keys, parts=parts)


def _number(value: str | None):
    try:
        return value if value is None else int(value)
    except ValueError:
        return value


def last_watermark(spark: SparkSession, source: Source, table: str = "ingestion_watermarks") -> str | None:
    """Where the source's next run begins."""
    if isinstance(source.table, Bucketed):
        return source.table.manifest().sources.get(source.name, {}).get("watermark") if source.table.exists() else None
    if not spark.catalog.tableExists(table):
        return None
    newest = spark.table(table).where(F.col("source") == source.name).agg(F.max_by(F.struct("value", "state"), "saved_at").alias("r")).first().r
    if newest and newest.state == "open" and spark.catalog.tableExists(source.table):
        return ingest.watermark(spark.table(source.table), source.incremental).first().watermark
    return newest.value if newest else None


def run(spark: SparkSession, source: Source, runs: str = "ingestion_runs", watermarks: str = "ingestion_watermarks") -> Run:
    """One run of a source. Rows that don't fit the table's types are skipped and counted; a failure moves no watermark."""
    started, run_id = dt.datetime.now(dt.UTC), uuid.uuid4().hex
    last = None

    def state(value: str | None, name: str) -> None:
        if source.incremental and not isinstance(source.table, Bucketed):
            spark.createDataFrame([(source.name, source.incremental, value, dt.datetime.now(dt.UTC), name)], WATERMARKS).write.mode("append").saveAsTable(watermarks)

    try:
        last = last_watermark(spark, source, watermarks) if source.incremental else None
        state(last, "open")
        out = _load(spark, source, run_id, last)
        state(out.watermark, "saved")
    except Exception as e:  # noqa: BLE001  reported as the run's outcome
        out = Run(run_id, "Failed", error=str(e).split("\n")[0][:500])
        state(last, "failed")
    row = (run_id, source.name, started, dt.datetime.now(dt.UTC), out.status, out.inserted, out.updated, out.skipped, out.error)
    spark.createDataFrame([row], RUNS).write.mode("append").saveAsTable(runs)
    return out


def past(staged: DataFrame, target: T.StructType, column: str | None, last: str | None) -> tuple[DataFrame, Callable[[], int]]:
    """Staged rows beyond the watermark whose values fit the table's types, in these types, and how many of them don't fit.

    Both sides of the watermark are compared in the table's type. A null there is beyond nothing; a value that is none of that type
    doesn't fit.
    """
    pairs = ingest.matched(staged, target)
    beyond = F.lit(True)
    if last is not None and column in pairs:
        kind, value = target[column].dataType, F.col(f"`{pairs[column]}`")
        beyond = F.coalesce(value.try_cast(kind) > F.lit(last).cast(kind), value.isNotNull())
    bad = Observation()
    rows = staged.where(beyond).observe(bad, F.count_if(~ingest.fits(staged, target)).alias("skipped"))
    return ingest.typed(rows, target), lambda: seen(bad, "skipped")


def _load(spark: SparkSession, source: Source, run_id: str, last: str | None) -> Run:
    staged = source.read(spark, last)
    own = isinstance(source.table, Bucketed)
    exists = source.table.exists() if own else spark.catalog.tableExists(source.table)
    if not exists and (own or not source.create):
        raise ValueError(f"no such table: {source.table.path if own else source.table}")
    if own:
        rows, skipped = past(staged, source.table.manifest().columns, source.incremental, last)
        done = source.table.load(rows, source.mode, source.name, {}, source.incremental)
        mark = last_watermark(spark, source)
    else:
        rows, skipped = past(staged, spark.table(source.table).schema, source.incremental, last) if exists else (staged, lambda: 0)
        done = ingest.load(rows, source.table, source.mode, source.keys)
        # the greatest value in the table after the load, not in what was read
        mark = ingest.watermark(spark.table(source.table), source.incremental).first().watermark if source.incremental else None
    return Run(run_id, "Success", done["inserted"], done["updated"], skipped(), mark)


def pull_files(spark: SparkSession, folder: str, schema: T.StructType | str, table: Bucketed, checkpoint: str, kind: str = "parquet", mode: str = "append", files_a_batch: int | None = None, **options: str):
    """Loads the files of a folder that no earlier pull with this checkpoint has loaded, and ends; to be run by a schedule.

    Rows that don't fit the table's types are skipped and counted. A batch's load and its number are one commit of the table, so
    a pull that dies between that and the stream's own commit loads nothing twice when it is run again.
    """
    reader = spark.readStream.format(kind).schema(schema).options(**options)
    stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(folder)

    def apply(batch: DataFrame, number: int) -> None:
        columns = table.manifest().columns
        bad = Observation()
        rows = kept(batch.observe(bad, F.count_if(~ingest.fits(batch, columns)).alias("skipped")).transform(lambda df: ingest.typed(df, columns)), "pulled")
        before = table.manifest().sources.get(checkpoint, {}).get("skipped", 0)
        table.load_batch(checkpoint, number, rows, mode, skipped=before + seen(bad, "skipped"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
