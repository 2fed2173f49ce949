"""Operators that must not grow with the product of two sides, read what they needn't or put all in one place."""

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from retailops.operators import kpi, pages, tables
from retailops.operators.buckets import Bucketed
from retailops.sources import audit_index, footers
from retailops.sources import files as files_module


def test_targets_of_random_intervals(spark):
    rnd = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randrange(400))
    targets = [(m, day(), rnd.choice([None, day(), day()]), float(rnd.randrange(9)), rnd.random() < 0.8) for m in (1, 2, None) for _ in range(60)]
    targets += [(3, dt.date(1, 1, 1), dt.date(9999, 12, 31), 1.0, True), (3, dt.date(2020, 5, 5), dt.date(2020, 5, 5), 2.0, True), (3, None, None, 3.0, True), (3, dt.date(2020, 6, 1), None, None, True)]
    values = [(k, rnd.choice([1, 2, 3, 4, None]), rnd.choice([day(), day(), day(), None, dt.date(1, 1, 1), dt.date(9999, 12, 31)])) for k in range(600)]
    got = kpi.active_target(spark.createDataFrame(values, "value_id long, metric_id int, period_date date"), spark.createDataFrame(targets, "metric_id int, start_date date, end_date date, target double, is_active boolean"))
    want = []
    for k, m, d in values:
        held = [(s, t) for m2, s, e, t, on in targets if on and m is not None and m2 == m and d and s and s <= d and (e is None or e >= d)]
        best = max(held, key=lambda x: (x[0], -1.0 if x[1] is None else x[1]), default=(None, None))
        want.append((k, m, d, best[1], best[0]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_metric_with_very_many_values_and_targets(spark):
    values = spark.range(1_000_000).select("id", F.lit(1).alias("metric_id"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 9000).cast("int")).alias("period_date"))
    targets = spark.range(10_000).select(F.lit(1).alias("metric_id"), F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 9000).cast("int")).alias("start_date"), F.lit(None).cast("date").alias("end_date"), F.col("id").cast("double").alias("target"), F.lit(True).alias("is_active"))
    began = time.perf_counter()
    row = kpi.active_target(values, targets).agg(F.count("*").alias("n"), F.count_if(F.col("target_start") != F.col("period_date")).alias("wrong")).first()
    assert tuple(row) == (1_000_000, 0) and time.perf_counter() - began < 60  # 1e10 pairs otherwise


def test_extremes_come_from_footers(spark, tmp_path):
    rows = spark.range(5000).select(F.lit("x").alias("s"), "id", (F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=F.col("id"))).cast("timestamp_ntz").alias("at"), F.when(F.col("id") % 3 > 0, F.col("id").cast("int")).alias("n"), F.lit(None).cast("date").alias("never"), F.lit(1.5).alias("f"))
    table = Bucketed.create(spark, str(tmp_path / "t"), rows.schema, ["id"], 4)
    assert tuple(table.extremes("at")) == (0, None, None)
    table.load(rows)
    m = table.manifest()
    plan = footers.extremes(spark, table._paths(m), m.columns, ["id", "at", "n"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id)" in plan
    last = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=4999)
    assert tuple(table.extremes("id", "at", "n")) == (5000, 0, 4999, dt.datetime(2024, 1, 1), last, 1, 4999)
    assert tuple(table.extremes("f", "s")) == (5000, 1.5, 1.5, "x", "x")  # these are read
    assert tuple(table.extremes("never", "at")) == (5000, None, None, dt.datetime(2024, 1, 1), last)  # no footer tells of what is all null


def test_pages_read_their_range(spark, tmp_path):
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("k"), "id")
    index = pages.build(rows, ["k", F.desc("id")], str(tmp_path), 16)
    assert index.total == 20_000
    ordered = [tuple(r) for r in rows.orderBy("k", F.desc("id")).collect()]
    for number, size in ((1, 30), (400, 30), (667, 30), (668, 30), (3, 2000), (1, 20_000)):
        assert [tuple(r) for r in index.page(number, size).collect()] == ordered[(number - 1) * size : number * size]
    page = index.page(400, 30)
    assert "GreaterThanOrEqual(at" in page._jdf.queryExecution().executedPlan().toString()
    ranges = {r for r, at, n in index.starts if at < 12_000 and 11_970 < at + n}
    assert len(ranges) <= 2 and read_files(page) <= sum(len(list((tmp_path / "rows" / f"in_range={r}").glob("*.parquet"))) for r in ranges)
    tied = pages.build(rows.withColumn("same", F.lit(1)), ["same"], str(tmp_path / "tied"), 4)
    seen = [r.id for k in range(1, 11) for r in tied.page(k, 2000).collect()]
    assert sorted(seen) == list(range(20_000)) and seen[:2000] == [r.id for r in tied.page(1, 2000).collect()]


def read_files(df):
    """How many files the scan of a plan reads."""
    import re

    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    found = []

    def walk(p):
        if re.match("FileSourceScan", p.getClass().getSimpleName()):
            found.append(int(p.metrics().apply("numFiles").value()))
        for kids in (p.children(), p.innerChildren()):
            for i in range(kids.size()):
                if hasattr(kids.apply(i), "metrics"):
                    walk(kids.apply(i))
        if "QueryStage" in p.getClass().getSimpleName():
            walk(p.plan())

    walk(plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan)
    return sum(found)


def test_a_rare_text_reads_few_files(spark, tmp_path):
    store, sidecar = str(tmp_path / "audit"), str(tmp_path / "index")

    def rows(month, n, odd):
        at = F.lit(dt.datetime(2024, month, 1)) + F.make_dt_interval(secs=F.col("id") * 60)
        text = F.when(F.col("id") == odd, "A RareWord here").otherwise(F.concat(F.lit("usual details "), F.col("id") % 7))
        return spark.range(n).select("id", F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("event_time"), (F.col("id") % 2).alias("company_id"), F.lit("act").alias("action"), text.alias("details"), F.lit(None).cast("string").alias("message")).drop("id")

    for k in range(8):
        files_module.write_audit(rows(1 + k // 4, 500, 10 if k == 1 else -1), store)
    assert audit_index.update(spark, store, sidecar) >= 8 and audit_index.update(spark, store, sidecar) == 0
    every = spark.read.parquet(store).inputFiles()
    found = audit_index.search(spark, store, sidecar, 0, "rareword")
    assert [r.event_id for r in found.collect()] == [10] and len(found.inputFiles()) == 1
    size = lambda names: sum((tmp_path / "audit" / n.split("/audit/")[1]).stat().st_size for n in names)
    assert size(found.inputFiles()) < 0.2 * size(every)
    assert audit_index.search(spark, store, sidecar, 0, "no such text").count() == 0
    for text in ("USUAL details 3", "us", "", None, "ab"):
        want = tables.audit_search(spark.read.parquet(store), 0, text, start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 1, 2))
        got = audit_index.search(spark, store, sidecar, 0, text, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
        assert got.count() == want.count() and all("month=2024-01" in f for f in got.inputFiles())
    files_module.write_audit(rows(3, 100, 50), store)  # not indexed yet
    assert audit_index.search(spark, store, sidecar, 0, "rareword").count() == 2
    assert audit_index.update(spark, store, sidecar) > 0
    files_module.drop_old_months(spark, store, "2024-03", 2)
    assert [r.event_id for r in audit_index.search(spark, store, sidecar, 0, "rareword").collect()] == [50]


def test_an_index_of_many_rows_and_long_texts(spark, tmp_path):
    store, sidecar = str(tmp_path / "audit"), str(tmp_path / "index")
    at = F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(secs=F.col("id") % 2_000_000)
    rows = spark.range(0, 400_000, numPartitions=8).select(F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("event_time"), (F.col("id") % 4).alias("company_id"), F.lit("purchase").alias("action"), F.concat(F.lit("order "), F.col("id") * 7919 % 1_000_003).alias("details"))
    files_module.write_audit(rows, store)
    long = rows.where("event_id = 0").withColumns({"event_id": F.lit(-1).cast("long"), "details": F.concat(F.repeat(F.lit("abcdé "), 50_000), F.lit("Ω end"))})
    files_module.write_audit(long, store)
    began = time.perf_counter()
    audit_index.update(spark, store, sidecar)
    assert time.perf_counter() - began < 20  # a pattern matched for each trigram of the rows, a text put in lower case for each of its own otherwise
    found = audit_index.search(spark, store, sidecar, 0, "ω END")
    assert [r.event_id for r in found.collect()] == [-1] and len(found.inputFiles()) == 1
    assert audit_index.search(spark, store, sidecar, 0, "Order 7919").count() == rows.where("company_id = 0 AND details LIKE 'order 7919%'").count()


def test_a_store_of_many_rows_has_more_files(spark, tmp_path):
    at = F.lit(dt.datetime(2024, 1, 1)) + F.make_dt_interval(days=(F.col("id") % 40).cast("int"))
    rows = spark.range(0, 200_000, numPartitions=1).select(F.col("id").alias("event_id"), at.cast("timestamp_ntz").alias("event_time"), (F.col("id") % 16).alias("company_id"), F.lit("act").alias("action"))
    files_module.write_audit(rows.limit(100).where("event_time < '2024-02-01'"), str(tmp_path / "small"))
    given = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # as if they were large
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        files_module.write_audit(rows, str(tmp_path / "large"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    large = spark.read.parquet(str(tmp_path / "large"))
    assert large.count() == large.distinct().count() == 200_000 and large.columns == [*rows.columns, "month"]
    assert 20 <= len(large.inputFiles()) <= 25 and len(spark.read.parquet(str(tmp_path / "small")).inputFiles()) == 1
    # a company's rows of a month lie in few of them
    spread = large.groupBy("month", "company_id").agg(F.count_distinct("_metadata.file_path").alias("n")).agg(F.max("n").alias("n")).first()
    assert spread.n <= 3


def test_bitmaps_hold_the_trigrams_of_odd_texts(spark, tmp_path):
    store, sidecar = str(tmp_path / "audit"), str(tmp_path / "index")
    texts = ["one\ntwo\r\n", "x\U0001f600y\U0001f600\U0001f600z", "ÀÉÎ", "ab", "", None, "a\u0085b"]
    rows = [(k, dt.datetime(2024, 1 + k, 1), 1, t, None) for k, t in enumerate(texts)]
    files_module.write_audit(spark.createDataFrame(rows, "event_id long, event_time timestamp_ntz, company_id long, action string, details string"), store)
    assert audit_index.update(spark, store, sidecar) == len(texts) and audit_index.update(spark, store, sidecar) == 0
    got = {month: set() for _, month in {(r.file, r.month) for r in spark.read.parquet(sidecar).collect()}}
    for r in spark.read.parquet(sidecar).where("part IS NOT NULL").collect():
        got[r.month] |= {(r.part << 15) + k for k in range(1 << 15) if r.bits[k >> 3] >> (k & 7) & 1}
    want = {}
    for k, t in enumerate(texts):
        three = sorted({t.lower()[i : i + 3] for i in range(len(t) - 2)}) if t else []
        want[f"2024-{1 + k:02}"] = {r.p for r in spark.createDataFrame([(x,) for x in three], "x string").select(F.xxhash64("x").bitwiseAND(F.lit((1 << 18) - 1)).alias("p")).collect()}
    assert got == want


def test_bounds_of_a_skewed_key_are_found(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = [(1 if k % 3 else k * 1000, f"s{k % 97:03}", k) for k in range(3000)] + [(None, "x", -1), (None, "y", -2)]
    spark.createDataFrame(rows, "A int, B string, C int").coalesce(1).write.jdbc(url, "t", "append", {"createTableColumnTypes": "B varchar(5)"})
    df = files_module.read_jdbc(spark, url, "t", keys=["A", "B"], parts=6)
    sizes = [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3002 and sorted(r.C for r in df.collect()) == sorted(r[2] for r in rows)
    assert len(sizes) == 7 and min(sizes) == 2 and max(sizes) <= 2 * sorted(sizes)[1]
    assert files_module.read_jdbc(spark, url, query="SELECT * FROM t WHERE C < 0", keys=["A", "B"], parts=4).count() == 2
    assert "ROW_NUMBER() OVER (ORDER BY a, b)" in files_module.bounds_sql("t", ["a", "b"], 4, "jdbc:postgresql://x")
