"""Files in and out, and streams run to their end over a folder."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailops.operators import status
from retailops.operators.buckets import Bucketed
from retailops.plans import ingestion
from retailops.plans.ingestion import Source
from retailops.sources import files
from retailops.streaming import jobs


def test_formats():
    assert [files.file_format(*a) for a in (("x.TSV",), ("x.csv", "json"), ("x.unknown",), ("x",), ("a.parquet",))] == ["tsv", "json", "csv", "csv", "parquet"]


def test_staged_csv_keeps_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('id,"Na,me"\n1,"a ""q"", b\nc"\n02,caf\xe9\n'.encode("windows-1252"))
    df = files.read_staged(spark, str(p), encoding="windows-1252")
    assert [tuple(r) for r in df.collect()] == [("1", 'a "q", b\nc'), ("02", "café")] and df.dtypes == [("id", "string"), ("Na,me", "string")]
    assert dict(files.read_inferred(spark, str(p), encoding="windows-1252").dtypes)["id"] == "int"


def test_json_paths(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps({"d": {"rows": [{"x": 1}, {"x": 2}], "one": {"x": 3}}}))
    assert [r.x for r in files.read_json_at(spark, str(p), "d.rows").collect()] == [1, 2]
    assert files.read_json_at(spark, str(p), "d.one").first().x == 3
    with pytest.raises(KeyError):
        files.read_json_at(spark, str(p), "d.none")


def test_jdbc_options_and_ranges(spark):
    o = files.jdbc_options("jdbc:x", query="SELECT 1", partition=("id", 0, 100, 4))
    assert o["dbtable"] == "(SELECT 1) AS q" and o["numPartitions"] == "4" and "query" not in o
    rows = spark.createDataFrame([(a, b) for a in range(4) for b in "xyz"], "a int, b string")
    parts = files.key_ranges(["a", "b"], [(1, "y"), (2, "z")])
    counts = [rows.where(p).count() for p in parts]
    assert sum(counts) == 12 and counts == [4, 4, 4]
    assert files.incremental_sql("SELECT * FROM t", "d", "2024-01-01").endswith("d > '2024-01-01'")


def test_reading_a_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.createDataFrame([(a, b) for a in range(40) for b in "xyz"], "A int, B string").write.jdbc(url, "t", "append", {"createTableColumnTypes": "B varchar(5)"})
    whole = files.read_jdbc(spark, url, "t", partition=("A", 0, 40, 4))
    assert whole.count() == 120 and whole.rdd.getNumPartitions() == 4
    parts = files.read_jdbc(spark, url, "t", predicates=files.key_ranges(["A", "B"], [(10, "y"), (20, "z")]))
    assert parts.count() == 120 and parts.rdd.getNumPartitions() == 3
    table = Source("db", "t_from_db", ingestion.from_database(url, "SELECT * FROM t WHERE A < 30", "A"), incremental="A")
    first = ingestion.run(spark, table, "runs_db", "marks_db")
    assert (first.status, first.inserted, first.watermark) == ("Success", 90, "29")
    assert (ingestion.run(spark, table, "runs_db", "marks_db").inserted, spark.table("t_from_db").count()) == (0, 90)


def test_ingestion_runs_from_csv_to_table(spark, tmp_path):
    spark.sql("CREATE TABLE t_ingest (id BIGINT, amount DOUBLE, note STRING) USING parquet")
    path = tmp_path / "in.csv"
    source = Source("sales", "t_ingest", ingestion.from_file(str(path)), mode="upsert", keys=["id"], incremental="id")
    path.write_text("ID,Amount,extra\n1,2.5,x\n2,bad,x\n3,4,x\n")
    one = ingestion.run(spark, source, "runs_csv", "marks_csv")
    assert (one.status, one.inserted, one.updated, one.skipped, one.watermark) == ("Success", 2, 0, 1, "3")
    path.write_text("ID,Amount,extra\n3,9,x\n4,1,x\n10,2,x\n")
    two = ingestion.run(spark, source, "runs_csv", "marks_csv")
    assert (two.inserted, two.updated, two.watermark) == (2, 0, "10")  # only rows past the watermark
    gone = Source("sales", "t_ingest", ingestion.from_file(str(tmp_path / "none.csv")), incremental="id")
    assert ingestion.run(spark, gone, "runs_csv", "marks_csv").status == "Failed"
    assert ingestion.last_watermark(spark, source, "marks_csv") == "10"
    assert sorted((r.id, r.amount, r.note) for r in spark.table("t_ingest").collect()) == [(1, 2.5, None), (3, 4.0, None), (4, 1.0, None), (10, 2.0, None)]
    assert sorted((r.status, r.inserted, r.skipped) for r in spark.table("runs_csv").collect()) == [("Failed", 0, 0), ("Success", 2, 0), ("Success", 2, 1)]
    again = Source("copy", "t_copy", ingestion.from_query("SELECT id, amount FROM t_ingest"), mode="replace")
    assert [ingestion.run(spark, again, "runs_csv", "marks_csv").inserted for _ in range(2)] == [4, 4] and spark.table("t_copy").count() == 4
    assert ingestion.run(spark, Source("no", "t_no", ingestion.from_query("SELECT 1 AS x"), create=False), "runs_csv", "marks_csv").status == "Failed"


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), None, 'a"b'), (2, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 5, 6), "c,d")], "k long, t timestamp_ntz, d date, s string")
    files.export_csv(df.coalesce(1), str(tmp_path / "out"))
    lines = sorted(next((tmp_path / "out").glob("part*")).read_text().strip().split("\n"))
    assert lines[0] == '"1","02/01/2024","","a""b"' and lines[1] == '"2","02/01/2024 03:04:05","06/05/2024","c,d"'


def test_audit_store(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, m, 1), 1, "x") for m in (1, 2, 2)], "event_time timestamp_ntz, company_id int, action string")
    files.write_audit(df, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).where("month = '2024-02'").count() == 2
    assert files.drop_old_months(spark, str(tmp_path / "audit"), "2024-07", 6) == ["2024-01"]
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    assert files.retained_months(["2023-07", "2023-08", "2024-01"], "2024-01", 6) == ["2023-08", "2024-01"]


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_hourly_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    drain(jobs.hourly_sales(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour"), "hourly", "complete")
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, jobs.hourly_sales(events).collect()))


@pytest.fixture
def keyed(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


FEED = "scheme string, store_code string, category string, net double, received_at timestamp"


def arrive(spark, rows, path):
    spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(FEED).parquet(f"{path}/in")


def test_feed_state_replaces_slices_and_restarts(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    table = Bucketed.create(spark, str(tmp_path / "state"), StructType.fromDDL(f"{FEED}, scheme_key string, store_key string"), ["scheme_key", "store_key"], 8)
    state = lambda: {(r.scheme, r.store_code, r.category, r.net) for r in table.rows().collect()}
    batches = [[("A", "s1", "x", 1.0, at(1)), ("A", "s1", "y", 2.0, at(1)), ("B", "s2", "x", 3.0, at(1))], [("a", "S1", "x", 9.0, at(2)), ("a", "S1", "z", 8.0, at(1))]]
    for rows in batches:
        jobs.run_feed_state(arrive(spark, rows, tmp_path), table, str(tmp_path / "ck")).awaitTermination()
    assert state() == {("B", "s2", "x", 3.0), ("a", "S1", "x", 9.0)}
    assert table.load_batch(str(tmp_path / "ck"), 1, table.rows(), "replace") is None  # the batch comes again
    # a new checkpoint goes on from the table
    spark.createDataFrame([("C", "s3", "x", 4.0, at(3))], FEED).write.parquet(str(tmp_path / "more"))
    jobs.run_feed_state(spark.readStream.schema(FEED).parquet(str(tmp_path / "more")), table, str(tmp_path / "ck2")).awaitTermination()
    assert state() == {("B", "s2", "x", 3.0), ("a", "S1", "x", 9.0), ("C", "s3", "x", 4.0)}


def test_latest_of_the_day_equals_the_batch(keyed, tmp_path):
    spark, keys = keyed, ["scheme", "store_code", "category"]
    at = lambda d, h, m=0: dt.datetime(2024, 1, d, h, m)
    table = Bucketed.create(spark, str(tmp_path / "state"), StructType.fromDDL(f"{FEED}, feed_key string"), ["feed_key"], 4)
    batches = [
        [("A", "s1", "x", 1.0, at(1, 9)), ("A", "s1", "x", 2.0, at(1, 10)), ("A", "s1", "x", 3.0, at(1, 10)), ("A", "s2", "x", 4.0, at(1, 10)), (None, "s2", None, None, at(1, 10))],
        [("A", "s1", "x", 5.0, at(1, 9, 30)), ("A", "s2", "x", 6.0, at(1, 10)), ("B", "s9", "x", 7.0, at(1, 23))],
        [("A", "s2", "x", 8.0, at(2, 3))],
        [("A", "s2", "y", 9.0, at(2, 4))],
    ]
    seen = []
    for k, rows in enumerate(batches):
        jobs.run_latest_of_day(arrive(spark, rows, tmp_path), table, str(tmp_path / "ck"), keys).awaitTermination()
        seen += rows
        day = max(r[4] for r in seen).date()
        want = {r[:4] for r in seen if r[4].date() == day and r[4] == max(x[4] for x in seen if x[:3] == r[:3] and x[4].date() == day)}
        got = {tuple(r)[:4] for r in table.rows().collect()}
        assert want <= got and (got == want or k == 2)  # the first day ends once the watermark passes it
    assert table.rows().count() == 2
    assert [r.n for r in spark.read.format("statestore").option("stateVarName", "rows").load(str(tmp_path / "ck")).selectExpr("count(*) AS n").collect()] == [2]


def test_incident_stream_in_event_time_equals_the_batch(keyed, tmp_path):
    spark = keyed
    from retailops.sources.roles import role

    rows = role(spark, "/root/testdata/sf0.001", "status_history").where("entity_id < 12").orderBy("checked_at").select("entity_id", "id", F.col("checked_at").cast("timestamp").alias("checked_at"), "status").collect()
    last = max(r.checked_at for r in rows)
    cuts = [rows[: len(rows) // 3], rows[len(rows) // 3 : 2 * len(rows) // 3], rows[2 * len(rows) // 3 :]]
    cuts[0], cuts[1] = cuts[0][:-5] + cuts[1][:5], cuts[0][-5:] + cuts[1][5:]  # some come a file late
    cuts += [[(99, -1, last + dt.timedelta(days=30), "Online")], [(5, -2, rows[0].checked_at, "Error"), (99, -3, last + dt.timedelta(days=40), "Online")]]
    query = None
    for part in cuts:
        spark.createDataFrame(part[::-1], "entity_id long, id long, checked_at timestamp, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("entity_id long, id long, checked_at timestamp, status string").parquet(str(tmp_path / "in"))
        query = jobs.incident_events(stream, "5 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("entity_id", "event", F.col("at").cast("timestamp_ntz").alias("at"), "status").where("entity_id < 99")
    want = status.incidents(role(spark, "/root/testdata/sf0.001", "status_history").where("entity_id < 12"), role(spark, "/root/testdata/sf0.001", "entity")).collect()
    assert sorted((r.entity_id, r.at, r.status) for r in found.where("event = 'opened'").collect()) == sorted((r.entity_id, r.opened_at, r.status) for r in want)
    assert sorted((r.entity_id, r.at) for r in found.where("event = 'resolved'").collect()) == sorted({(r.entity_id, r.resolved_at) for r in want if r.resolved_at})
    assert sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators) == 1


def test_a_pull_that_dies_loads_nothing_twice(spark, tmp_path, monkeypatch):
    table = Bucketed.create(spark, str(tmp_path / "t"), StructType.fromDDL("id bigint, day date"), ["id"], 4)

    def land(rows):
        spark.createDataFrame(rows, "ID string, Day string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    pull = lambda: ingestion.pull_files(spark, str(tmp_path / "in"), "ID string, Day string", table, str(tmp_path / "ck"), files_a_batch=1)
    land([("1", "2024-01-01"), ("2", "never")])
    pull().awaitTermination()
    land([("3", "2024-01-03")])
    usual = Bucketed.load_batch

    def dies(self, *args, **kw):
        usual(self, *args, **kw)
        raise RuntimeError("killed after the load")

    with monkeypatch.context() as m:
        m.setattr(Bucketed, "load_batch", dies)
        with pytest.raises(Exception, match="killed"):
            pull().awaitTermination()
    assert table.rows().count() == 2
    land([("4", "2024-01-04")])
    pull().awaitTermination()
    assert sorted(r.id for r in table.rows().collect()) == [1, 3, 4]
    assert table.manifest().sources[str(tmp_path / "ck")] == {"skipped": 1, "batch": 2}


def test_stamps(spark):
    df = jobs.stamped(spark.createDataFrame([(1,)], "id long"), "co")
    assert df.first().company_id == "co" and "received_at" in df.columns
