"""Structured Streaming: hourly windows, arrival stamps, replace-by-key state, the day's latest rows and incidents.

Keyed state (transformWithState) needs the RocksDB provider: spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.buckets import Bucketed
from ..session import kept


def hourly_sales(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and sum by hour and type. On a stream give the allowed lateness, so that state is bounded."""
    if late:
        events = events.withWatermark("ts", late)
    w = F.window(F.col("ts").cast("timestamp"), "1 hour") if not late else F.window("ts", "1 hour")
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")


def stamped(feed: DataFrame, company: str, unique: tuple[str, ...] = (), late: str = "1 day") -> DataFrame:
    """Feed rows with the company and the time of arrival; with a key, repeats within the lateness are dropped."""
    out = feed.withColumn("company_id", F.lit(company)).withColumn("received_at", F.current_timestamp())
    return out.withWatermark("received_at", late).dropDuplicatesWithinWatermark(list(unique)) if unique else out


def replace_slices(state: DataFrame | None, batch: DataFrame, scheme: str = "scheme", store: str = "store_code", arrived: str = "received_at") -> DataFrame:
    """The feed state after a batch: all slices of each (scheme, store) in it, keys compared ignoring case, are replaced.

    Of several arrivals for a key within the batch, the newest counts.
    """
    keyed = lambda df: df.withColumns({"_a": F.lower(F.col(scheme).cast("string")), "_b": F.lower(F.col(store).cast("string"))})
    new = keyed(batch)
    last = new.groupBy("_a", "_b").agg(F.max(arrived).alias("_t"))
    fresh = new.join(last, ["_a", "_b"]).where(F.col(arrived) == F.col("_t")).drop("_t")
    if state is not None:
        fresh = keyed(state).join(last.select("_a", "_b"), ["_a", "_b"], "left_anti").select(*fresh.columns).unionByName(fresh)
    return fresh.drop("_a", "_b")


def run_feed_state(feed: DataFrame, table: Bucketed, checkpoint: str, scheme: str = "scheme", store: str = "store_code", arrived: str = "received_at"):
    """Keeps the feed state of a stream in a table in buckets of (scheme_key, store_key), the two in lower case.

    A batch rewrites the buckets of its keys. The table's manifest knows the last batch of each checkpoint, so that a batch that
    comes again changes nothing, and a new checkpoint goes on from the table.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        fresh = replace_slices(None, batch, scheme, store, arrived)
        keys = {"scheme_key": F.lower(F.col(scheme).cast("string")), "store_key": F.lower(F.col(store).cast("string"))}
        table.load_batch(checkpoint, epoch, fresh.withColumns(keys), "upsert")

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of_day(feed: DataFrame, keys: Sequence[str], arrived: str = "received_at", late: str = "1 hour") -> DataFrame:
    """Changes of today's latest rows of each key: its rows of the newest arrival, or, as `gone`, the key alone once its day is over.

    State of a key: its newest rows. A timer at the end of their day, which is when the watermark passes it, clears them; a key that
    has had rows of the next day by then keeps those. Rows older than the lateness are dropped, and counted by the stream.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    columns = feed.schema
    out = T.StructType([*columns.fields, T.StructField("gone", T.BooleanType())])
    names = columns.fieldNames()

    class Latest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.rows = handle, handle.getListState("rows", columns)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            batch = pd.concat(list(rows))
            new = batch[batch[arrived] == batch[arrived].max()]
            old = pd.DataFrame(list(self.rows.get()), columns=names) if self.rows.exists() else new.iloc[:0]
            known = pd.Timestamp(old[arrived].iloc[0]) if len(old) else None
            if known is not None and new[arrived].iloc[0] < known:
                return
            if known is not None and new[arrived].iloc[0] == known:
                new = pd.concat([old, new])
            self.rows.put([tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v for v in r) for r in new[names].itertuples(index=False)])
            self.handle.registerTimer(int((new[arrived].iloc[0].normalize() + pd.Timedelta(days=1)).timestamp() * 1000))
            yield new[names].assign(gone=False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            rows = pd.DataFrame(list(self.rows.get()), columns=names) if self.rows.exists() else pd.DataFrame(columns=names)
            if len(rows) and pd.Timestamp(rows[arrived].iloc[0]).timestamp() * 1000 < expiredTimerInfo.getExpiryTimeInMs():
                self.rows.clear()
                yield rows.iloc[:1].assign(gone=True)

        def close(self) -> None:
            pass

    return feed.withWatermark(arrived, late).groupBy(*keys).transformWithStateInPandas(Latest(), out, "Update", "EventTime")


def run_latest_of_day(feed: DataFrame, table: Bucketed, checkpoint: str, keys: Sequence[str], arrived: str = "received_at", late: str = "1 hour"):
    """Keeps today's latest rows of each key in a table in buckets of feed_key, the keys as JSON; those of days that are over leave it."""

    def apply(batch: DataFrame, epoch: int) -> None:
        batch = kept(batch.withColumn("feed_key", F.to_json(F.struct(*keys))), "changes")
        # a key may be gone and back in one batch
        table.load_batch(checkpoint, epoch, batch.where("NOT gone").drop("gone"), "upsert", batch.where("gone"))

    return latest_of_day(feed, keys, arrived, late).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def incident_events(statuses: DataFrame, late: str = "10 minutes") -> DataFrame:
    """opened and resolved events of a status stream (entity_id, id, checked_at, status), by the time of the checks.

    Checks wait in the state until the watermark has passed them and are then taken in order, so that rows may come in any order
    within the lateness. Later ones are dropped; the stream counts them (numRowsDroppedByWatermark). State of an entity: the waiting
    checks, its last status and when its incident was opened.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Incidents(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "status string, opened timestamp")
            self.waiting = handle.getListState("waiting", "checked_at timestamp, id long, status string")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
            batch = pd.concat(list(rows))
            self.waiting.appendList([(at.to_pydatetime(), int(i), s) for at, i, s in zip(batch.checked_at, batch.id, batch.status, strict=True)])
            self.wake(batch.checked_at.min())
            yield pd.DataFrame(columns=["entity_id", "event", "at", "status"])

        def wake(self, at: pd.Timestamp) -> None:
            self.handle.registerTimer(-(-int(pd.Timestamp(at).value) // 1_000_000))  # whole milliseconds, not before

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
            now = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
            rows = sorted(((pd.Timestamp(at), i, s) for at, i, s in self.waiting.get()), key=lambda r: r[:2])
            due, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
            before, opened = self.last.get() if self.last.exists() else ("Unknown", None)
            out = []
            for at, _, status in due:
                if before == "Online" and status != "Online":
                    opened = at.to_pydatetime()
                    out.append((key[0], "opened", at, status))
                elif before != "Online" and status == "Online" and opened is not None:
                    out.append((key[0], "resolved", at, status))
                    opened = None
                before = status
            self.last.update((before, opened))
            self.waiting.clear()
            if rest:
                self.waiting.put([(at.to_pydatetime(), i, s) for at, i, s in rest])
                self.wake(rest[0][0])
            yield pd.DataFrame(out, columns=["entity_id", "event", "at", "status"])

        def close(self) -> None:
            pass

    rows = statuses.select("entity_id", "id", "checked_at", "status").withWatermark("checked_at", late)
    return rows.groupBy("entity_id").transformWithStateInPandas(Incidents(), "entity_id long, event string, at timestamp, status string", "Append", "EventTime")
