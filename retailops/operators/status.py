"""Status history: latest state, grids, transitions, uptime, dominant status and impact along dependencies.

Columns: entity_id, checked_at, status, response_time, id. Ties in time are broken by id.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .buckets import Bucketed
from .tables import search

#: Severity of a status, the worst highest.
SEVERITY = {"Offline": 5, "Error": 5, "Degraded": 4, "Maintenance": 3, "Unknown": 2, "Online": 1}
#: Which status stands for an hour in which several were seen.
DOMINANCE = ("Error", "Offline", "Degraded", "Maintenance", "Online", "Unknown")
UNHEALTHY = ("Offline", "Error", "Degraded")


def _ranked(column: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(column == name, F.lit(rank)).otherwise(out)
    return out


def latest(history: DataFrame, key: str = "entity_id", time: str = "checked_at", tie: str = "id") -> DataFrame:
    """The newest row of each key, by partial aggregation instead of a sort."""
    rest = [c for c in history.columns if c != key]
    best = history.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("r"))
    return best.select(key, "r.*").select(*history.columns)


def current_counts(entities: DataFrame, history: DataFrame) -> DataFrame:
    """Entities by their latest status; those without history are Unknown."""
    now = entities.join(latest(history).select("entity_id", "status"), "entity_id", "left")
    return now.groupBy(F.coalesce("status", F.lit("Unknown")).alias("status")).agg(F.count("*").alias("n"))


def due(entities: DataFrame, history: DataFrame, now: dt.datetime, minutes: int = 15) -> DataFrame:
    """Entities that were never checked or not within the last minutes, the oldest first."""
    last = history.groupBy("entity_id").agg(F.max("checked_at").alias("last_check"))
    out = entities.join(last, "entity_id", "left").where(F.col("last_check").isNull() | (F.col("last_check") < F.lit(now - dt.timedelta(minutes=minutes)).cast("timestamp_ntz")))
    return out.select("entity_id", "last_check").orderBy(F.col("last_check").asc_nulls_first(), "entity_id")


def per_entity(history: DataFrame) -> DataFrame:
    """Checks, mean response, uptime %, incidents (Offline or Error) and degraded checks of each entity."""
    share = F.count_if(F.col("status") == "Online") * 100.0 / F.count("*")
    return history.groupBy("entity_id").agg(
        F.count("*").alias("checks"), F.round(F.coalesce(F.avg("response_time"), F.lit(0.0)), 4).alias("response"), F.bround(share, 1).alias("uptime"),
        F.count_if(F.col("status").isin("Offline", "Error")).alias("incidents"), F.count_if(F.col("status") == "Degraded").alias("degraded"),
    )


def status_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("entity_id", "status").agg(F.count("*").alias("n"))


def grid(entities: DataFrame, history: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """One row for each entity and day: the day's last status (null without checks). 1 to 90 days; the calendar is broadcast."""
    days = min(max(days, 1), 90)
    start = as_of - dt.timedelta(days=days - 1)
    seen = history.where(F.to_date("checked_at").between(F.lit(start), F.lit(as_of)))
    last = seen.groupBy("entity_id", F.to_date("checked_at").alias("day")).agg(F.max_by("status", F.struct("checked_at", "id")).alias("status"))
    all_days = entities.select("entity_id", F.explode(F.sequence(F.lit(start), F.lit(as_of))).alias("day"))
    return all_days.join(last, ["entity_id", "day"], "left")


def grid_uptime(cells: DataFrame) -> DataFrame:
    """Share of an entity's days with checks that end Online, and its last status in the window (Unknown without any)."""
    return cells.groupBy("entity_id").agg(
        F.count("status").alias("days"),
        F.bround(F.count_if(F.col("status") == "Online") * 100.0 / F.nullif(F.count("status"), F.lit(0)), 1).alias("uptime"),
        F.coalesce(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("day"))), F.lit("Unknown")).alias("current"),
    )


def groups(entities: DataFrame, history: DataFrame) -> DataFrame:
    """Entities of each type and their worst current status."""
    now = entities.join(latest(history).select("entity_id", "status"), "entity_id", "left").withColumn("status", F.coalesce("status", F.lit("Unknown")))
    worst = F.max_by("status", F.struct(_ranked(F.col("status"), SEVERITY), F.col("status")))
    return now.groupBy("entity_type").agg(F.count("*").alias("n"), worst.alias("worst"))


def hourly(history: DataFrame, start: dt.datetime, hours: int) -> DataFrame:
    """The dominant status and number of checks of each hour; hours without checks are kept."""
    end = start + dt.timedelta(hours=hours)
    rank = {s: len(DOMINANCE) - k for k, s in enumerate(DOMINANCE)}
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    seen = history.where((F.col("checked_at") >= at(start)) & (F.col("checked_at") < at(end)))
    by = seen.groupBy(F.date_trunc("hour", "checked_at").cast("timestamp_ntz").alias("hour")).agg(F.max_by("status", _ranked(F.col("status"), rank)).alias("status"), F.count("*").alias("checks"))
    every = history.sparkSession.range(hours).select((at(start) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    return every.join(by, "hour", "left").select("hour", "status", F.coalesce("checks", F.lit(0)).cast("long").alias("checks"))


def changes(history: DataFrame) -> DataFrame:
    """Rows whose status differs from the entity's row before, the first one included."""
    w = Window.partitionBy("entity_id").orderBy("checked_at", "id")
    return history.withColumn("before", F.lag("status").over(w)).where("before IS NULL OR before <> status").select("entity_id", "checked_at", "before", "status")


def severity_of(status: Column, critical: Column) -> Column:
    return F.when(status == "Error", "Critical").when((status == "Offline") & critical, "High").when(status == "Maintenance", "Low").otherwise("Medium")


def incidents(history: DataFrame, entities: DataFrame) -> DataFrame:
    """An incident for each step from Online to something else, resolved when the entity is next Online.

    Time runs backwards, so that the next Online check is the last one seen: frames only grow, and a row costs the same in any history.
    """
    w = Window.partitionBy("entity_id").orderBy(F.desc("checked_at"), F.desc("id"))
    online = F.when(F.col("status") == "Online", F.col("checked_at"))
    rows = history.select("entity_id", "checked_at", "id", "status").withColumns({"before": F.lead("status", 1, "Unknown").over(w), "resolved_at": F.last(online, True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    opened = rows.where("before = 'Online' AND status <> 'Online'").join(entities.select("entity_id", "is_critical"), "entity_id", "left")
    return opened.select("entity_id", F.col("checked_at").alias("opened_at"), "resolved_at", "status", severity_of(F.col("status"), F.coalesce("is_critical", F.lit(False))).alias("severity"))


def freshness(tables: dict[str, tuple[DataFrame | Bucketed, str, int]], now: dt.datetime) -> DataFrame:
    """For each table (frame or table in buckets, time column, most minutes): rows, newest time, age and state.

    Without any time a table is Degraded, as it is when its newest row is too old; a check that can't be made is an Error.
    Of a table in buckets no row is read: its files' footers tell.
    """
    out = None
    for name, (df, column, most) in tables.items():
        own = isinstance(df, Bucketed)
        if column in (df.manifest().columns.fieldNames() if own else df.columns):
            seen = df.agg(F.count("*").alias("n_rows"), F.max(column).alias("newest")) if not own else _told(df, column)
            age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 60)
            found = seen.select("n_rows", age.alias("age_minutes"))
            state = F.when(F.col("age_minutes").isNull() | (F.col("age_minutes") > most), "Degraded").otherwise("Online")
        else:
            found = (df.spark if own else df.sparkSession).range(1).select(F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("age_minutes"))
            state = F.lit("Error")
        one = found.select(F.lit(name).alias("table_name"), "n_rows", "age_minutes", state.alias("state"))
        out = one if out is None else out.unionByName(one)
    return out


def _told(table: Bucketed, column: str) -> DataFrame:
    """Rows and newest time of a table in buckets: two values, asked for at once, which become constants."""
    row = table.extremes(column)
    return table.spark.range(1).select(F.lit(row.n_rows).cast("long").alias("n_rows"), F.lit(row[f"greatest_{column}"]).cast(table.manifest().columns[column].dataType).alias("newest"))


def _stale(cutoff: dt.datetime) -> Column:
    return (F.col("status") == "Running") & (F.col("started_at") < F.lit(cutoff).cast("timestamp_ntz"))


def fail_stale(runs: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Runs that have been Running since before the cutoff become Failed."""
    return runs.withColumn("status", F.when(_stale(cutoff), "Failed").otherwise(F.col("status")))


def fail_sources(sources: DataFrame, runs: DataFrame, cutoff: dt.datetime, now: dt.datetime) -> DataFrame:
    """Sources (source_id, last_run_at, last_status) whose newest stale run is their latest activity become Failed at `now`."""
    newest = runs.where(_stale(cutoff)).groupBy("source_id").agg(F.max("started_at").alias("_t"))
    hit = F.col("_t").isNotNull() & (F.col("last_run_at").isNull() | (F.col("last_run_at") <= F.col("_t")))
    changed = sources.join(newest, "source_id", "left").withColumns({"last_run_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_run_at")), "last_status": F.when(hit, F.lit("Failed")).otherwise(F.col("last_status"))})
    return changed.select(*sources.columns)


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not deleted softly; all of them where there is no such mark."""
    return rows.where(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in rows.columns else rows


def history_rows(history: DataFrame, entity=None, start: dt.datetime | None = None, end: dt.datetime | None = None, state: str | None = None, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Checks that are not deleted, from start to end, both included, newest first."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    found = live(history)
    for test in (entity is not None and (F.col("entity_id") == entity), state and (F.col("status") == state), start and (F.col("checked_at") >= at(start)), end and (F.col("checked_at") <= at(end))):
        found = found.where(test) if isinstance(test, Column) else found
    found = found.orderBy(F.desc("checked_at"), F.desc("id"))
    return found if page_size is None else found.offset((page - 1) * page_size).limit(page_size)


def entity_search(entities: DataFrame, history: DataFrame, text: str | None = None, kind=None, active: bool | None = None, critical: bool | None = None, state: str | None = None, sort: str = "name", descending: bool = False, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Entities that are not deleted with their latest status (Unknown without checks), by a text in name, description, owner or location."""
    found = live(entities).join(latest(live(history)).select("entity_id", "status"), "entity_id", "left").withColumn("status", F.coalesce("status", F.lit("Unknown")))
    found = search(found, text.strip() if text else None, ("name", "description", "owner", "location"))
    for column, value in (("entity_type", kind), ("is_active", active), ("is_critical", critical), ("status", state)):
        found = found.where(F.col(column) == value) if value is not None else found
    found = found.orderBy(F.desc(sort) if descending else F.asc(sort), "entity_id")
    return found if page_size is None else found.offset((page - 1) * page_size).limit(page_size)


def incident_search(incidents: DataFrame, entities: DataFrame, text: str | None = None, active_only: bool = False, severity: str | None = None, state: str | None = None, kind=None, sort: str = "started_at", descending: bool = True, page: int = 1, page_size: int | None = None) -> DataFrame:
    """Incidents that are not deleted with their entity's name and type, by a text in title, description or that name."""
    found = live(incidents).join(entities.select("entity_id", F.col("name").alias("entity_name"), "entity_type"), "entity_id", "left")
    if active_only:
        found = found.where("status <> 'Resolved'")
    for column, value in (("severity", severity), ("status", state), ("entity_type", kind)):
        found = found.where(F.col(column) == value) if value is not None else found
    found = search(found, text.strip() if text else None, ("title", "description", "entity_name"))
    found = found.orderBy(F.desc(sort) if descending else F.asc(sort), "incident_id")
    return found if page_size is None else found.offset((page - 1) * page_size).limit(page_size)
