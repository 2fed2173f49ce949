"""Loads in one read, tables that keep their columns, and tables in buckets."""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailops.operators import ingest
from retailops.operators.buckets import Bucketed
from retailops.plans import ingestion
from retailops.plans.ingestion import Source


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def told(spark, folder, rows, schema, parts=3):
    """Rows whose every read leaves a file for each partition."""
    folder = str(folder)

    def read(batches):
        with open(f"{folder}/{uuid.uuid4().hex}", "w"):
            yield from batches

    return spark.createDataFrame(rows, schema).repartition(parts).mapInArrow(read, schema)


@pytest.mark.parametrize("mode", ["append", "replace", "upsert"])
def test_missing_extra_and_reordered_columns(spark, mode):
    table = f"t_columns_{mode}"
    spark.sql(f"CREATE TABLE {table} (id BIGINT, name STRING, upd DOUBLE) USING parquet")
    ingest.load(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, name string, upd double"), table)
    part = spark.createDataFrame([("x", 9, "c", 2), ("x", 9, "d", 3)], "other string, more int, NAME string, ID int")
    assert ingest.load(part, table, mode, [" Id ", "none"]) == {"append": {"inserted": 2, "updated": 0}, "replace": {"inserted": 2, "updated": 0}, "upsert": {"inserted": 1, "updated": 1}}[mode]
    assert spark.table(table).dtypes == [("id", "bigint"), ("name", "string"), ("upd", "double")]
    new, old = [(2, "c", None), (3, "d", None)], [(1, "a", 1.0), (2, "b", 2.0)]
    assert rows_of(spark.table(table)) == sorted({"append": old + new, "replace": new, "upsert": old[:1] + new}[mode], key=str)
    with pytest.raises(ValueError, match="no column"):
        ingest.load(spark.createDataFrame([(1,)], "q int"), table, mode, ["id"])
    with pytest.raises(ValueError, match="key column"):
        ingest.load(part, table, "upsert", ["upd", " "])


@pytest.mark.parametrize("mode", ["append", "replace", "upsert"])
@pytest.mark.parametrize("bucketed", [False, True])
def test_a_run_reads_its_source_once(spark, tmp_path, mode, bucketed):
    columns = StructType.fromDDL("id bigint, amount double, note string")
    table = Bucketed.create(spark, str(tmp_path / "t"), columns, ["id"], 4) if bucketed else f"t_once_{mode}"
    if not bucketed:
        spark.createDataFrame([], columns).write.saveAsTable(table)
    (tmp_path / "reads").mkdir()
    rows = [(str(k), "bad" if k % 5 == 0 else str(k)) for k in range(40)]
    source = Source("once", table, lambda s, last: told(s, tmp_path / "reads", rows, "ID string, Amount string"), mode, ["id"])
    done = ingestion.run(spark, source, "runs_once", "marks_once")
    assert (done.status, done.inserted, done.updated, done.skipped) == ("Success", 32, 0, 8)
    assert len(list((tmp_path / "reads").iterdir())) == 3
    again = ingestion.run(spark, source, "runs_once", "marks_once")
    assert (again.inserted, again.updated, again.skipped) == ((0, 32, 8) if mode == "upsert" else (32, 0, 8))
    assert (table.rows() if bucketed else spark.table(table)).count() == (64 if mode == "append" else 32)


def test_an_upload_is_scanned_once(spark, tmp_path):
    seen = ingest.inspect(told(spark, tmp_path, [(str(k), "x") for k in range(30)], "a string, b string"), StructType.fromDDL("a int, b int, c int"))
    assert (seen.total, seen.missing, {r.column_name: (r.n_bad, r.samples) for r in seen.columns.collect()}) == (30, ["c"], {"a": (0, []), "b": (30, ["x"])})
    assert len(list(tmp_path.iterdir())) == 3
    assert ingest.inspect(spark.range(7), StructType.fromDDL("q int")).total == 7


@pytest.mark.parametrize("bucketed", [False, True])
def test_a_run_that_dies_appends_nothing_twice(spark, tmp_path, monkeypatch, bucketed):
    columns = StructType.fromDDL("id bigint, day date")
    table = Bucketed.create(spark, str(tmp_path / "t"), columns, ["id"], 4) if bucketed else "t_dies"
    if not bucketed:
        spark.createDataFrame([], columns).write.saveAsTable(table)
    state = {"n": 3}
    source = Source("dies", table, lambda s, last: s.createDataFrame([(str(k), f"2024-01-{k + 1:02}") for k in range(state["n"])], "id string, day string"), incremental="id")
    assert ingestion.run(spark, source, "runs_dies", "marks_dies").watermark == "2"
    state["n"] = 12  # 10 and 11 are past 2 as numbers, not as texts
    with monkeypatch.context() as m:

        def dead(*_):
            raise KeyboardInterrupt

        if bucketed:  # the data are written, the manifest is not
            m.setattr(Bucketed, "_publish", dead)
        else:  # the table is loaded, the watermark is not saved
            m.setattr(ingest, "watermark", dead)
        with pytest.raises(KeyboardInterrupt):
            ingestion.run(spark, source, "runs_dies", "marks_dies")
    after = ingestion.run(spark, source, "runs_dies", "marks_dies")
    assert (after.status, after.inserted, after.watermark) == ("Success", 9 if bucketed else 0, "11")
    assert sorted(r.id for r in (table.rows() if bucketed else spark.table(table)).collect()) == list(range(12))


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_a_small_delta_rewrites_its_buckets_only(spark, tmp_path):
    base = spark.range(40000).selectExpr("id AS k", "concat('v', id) AS v", "id * 0.5 AS x")
    table = Bucketed.create(spark, str(tmp_path / "b"), base.schema, ["k"], 32)
    assert table.load(base) == {"inserted": 40000, "updated": 0}
    whole, first = size_of(tmp_path / "b"), table.manifest()
    by_bucket = base.withColumn("b", table._bucket(first))
    delta = by_bucket.where("b IN (3, 17) AND k % 3 = 0").selectExpr("k", "'new' AS v", "CAST(NULL AS DOUBLE) AS x").unionByName(spark.createDataFrame([(None, "n", 1.0)], "k long, v string, x double"))
    assert table.load(delta, "upsert") == {"inserted": 1, "updated": delta.count() - 1}
    new = table.manifest()
    commits = {c for cs in new.live.values() for c in cs} - {c for cs in first.live.values() for c in cs}
    assert len(commits) == 1 and size_of(tmp_path / "b" / "data" / commits.pop()) < 0.15 * whole
    assert sum(new.live[b] != first.live[b] for b in first.live) <= 3  # two, and that of the row without key
    assert rows_of(table.rows()) == rows_of(ingest.upsert(base, delta, ["k"]))
    assert rows_of(table.rows(first)) == rows_of(base)  # readers of the older version go on
    assert len(table.vacuum(1)) == 0 and table.rows().count() == 40001  # the first folder holds the untouched buckets
    table.load(base.limit(10), "replace")
    assert len(table.vacuum(1)) == 2 and table.rows().count() == 10


def test_changes_in_buckets_equal_changes_of_a_table(spark, tmp_path):
    base = spark.range(500).selectExpr("id AS k", "concat('v', id) AS v", "id * 0.5 AS x")
    table = Bucketed.create(spark, str(tmp_path / "b"), base.schema, ["k"], 16)
    table.load(base)
    updates = spark.createDataFrame([(3, "", "u", 1), (3, "2.5", "w", 2), (900, "1", "none", 1)], "k long, x string, v string, step int")
    deletes = spark.createDataFrame([(4,), (4,), (901,)], "k long")
    inserts = spark.createDataFrame([(1000, "i", "7"), (4, "again", "")], "k long, v string, x string")
    table.change(updates, deletes, inserts, order="step")
    assert rows_of(table.rows()) == rows_of(ingest.apply_changes(base, "k", updates, deletes, inserts, order="step"))
    before = table.manifest()
    with pytest.raises(Exception, match="several updates"):
        table.change(updates)
    assert table.manifest() == before
    for _ in range(3):
        table.load(base.where("k < 2"))
    table.compact(1)
    assert max(len(c) for c in table.manifest().live.values()) == 1 and table.rows().count() == 500 + 1 + 6


def test_two_writers_and_dead_ones(spark, tmp_path):
    table = Bucketed.create(spark, str(tmp_path / "b"), StructType.fromDDL("k bigint, v string"), ["k"], 4)
    m = table.manifest()
    table.load(spark.range(5).selectExpr("id AS k", "'a' AS v"))
    with pytest.raises(Exception, match="(?i)exist"):
        table._next(m, {})
    (tmp_path / "b" / "manifest" / "_dead").write_text('{"version": 3, "sch')  # its writer died
    assert table.manifest().version == 2 and table.rows().count() == 5
    for bad in (["x"], []):
        with pytest.raises(ValueError):
            Bucketed.create(spark, str(tmp_path / "c"), StructType.fromDDL("x double, k bigint"), bad)
    with pytest.raises(ValueError, match="key column"):
        table.load(spark.range(1).selectExpr("'z' AS v"), "upsert")
