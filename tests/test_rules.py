"""Edge rules on tiny frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retailops.functions import exprs
from retailops.operators import feed, graph, ingest, inventory, kpi, oos, sales, security, status, tables
from retailops.plans.steps import Step, order, run, with_parameters

D = dt.date


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_half_even_ratio_and_zero_division(spark):
    r = one(spark, exprs.ratio(F.lit(5.0), F.lit(2.0), 1, 0), exprs.ratio(F.lit(1.0), F.lit(0.0)), exprs.change(F.lit(5), F.lit(0)), exprs.change(F.lit(0), F.lit(0)), exprs.change(F.lit(5), F.lit(4)))
    assert tuple(r) == (2.0, None, 100.0, 0.0, 25.0)


def test_hours_count_boundaries(spark):
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    assert one(spark, exprs.hours_between(t("2024-01-01 00:59:00"), t("2024-01-01 01:01:00")))[0] == 1


def test_labels_and_names(spark):
    assert tuple(one(spark, exprs.label(F.lit(""), F.lit(None)), exprs.label(F.lit("  "), F.lit("b"), trim=True), exprs.label(F.lit(" ")))) == ("Unknown", "b", " ")
    assert exprs.normal_name("Mrp (LBP)") == "mrp__lbp_" and exprs.column_name("1st") == "col_1st" and exprs.column_name("Sr.No") == "sr_no"
    assert [exprs.column_name(x) for x in ("", "Total Sales", "_x")] == ["column", "total_sales", "_x"]
    assert [exprs.type_by_name(x) for x in ("unit_rate", "Active", "note", "this_year", "is_new", "percent_off", "qty")] == ["decimal(18,3)", "boolean", "string", "string", "boolean", "decimal(18,3)", "string"]
    assert [exprs.table_name(x) for x in ("", "2024 Sales.csv", "Äb", "_ok", "Orders")] == ["imported_table", "table_2024_sales_csv", "_b", "_ok", "orders"]
    assert exprs.type_by_name("unit_price") == "decimal(18,3)" and exprs.type_by_name("ship_date") == "timestamp"
    assert tuple(one(spark, exprs.month_number(F.lit("SEPTEMBER")), exprs.month_number(F.lit("xx")))) == (9, None)
    assert tuple(one(spark, exprs.kpi_unit(F.lit("Return Rate")), exprs.kpi_unit(F.lit("Lead Time")), exprs.kpi_direction(F.lit("Return Rate")), exprs.kpi_direction(F.lit("Sales")))) == ("%", "days", "down", "up")


def test_comparison_windows():
    w = sales.comparison_windows(D(2024, 3, 31), "MTD")
    assert w["val"] == (D(2024, 3, 1), D(2024, 3, 31)) and w["lm"] == (D(2024, 2, 1), D(2024, 2, 29)) and w["ly"] == (D(2023, 3, 1), D(2023, 3, 31))
    assert sales.comparison_windows(D(2024, 2, 29), "Day", "ToDate")["ly"] == (D(2023, 2, 28), D(2023, 2, 28))
    day = sales.comparison_windows(D(2024, 3, 31), "Day", "Day")
    assert all(a.weekday() == D(2024, 3, 31).weekday() for a, _ in day.values())
    assert sales.overview_windows(D(2024, 1, 10), 0) == ((D(2024, 1, 10), D(2024, 1, 10)), (D(2024, 1, 9), D(2024, 1, 9)))


SALE = "company_id string, store_code long, pos_number string, transaction_no long, receipt_no long, item_no long, date date, quantity double, net_amount_acy double, total_discount_acy double"


def test_baskets_with_nulls_count(spark):
    rows = [("A", 1, None, 1, 1, 1, D(2024, 1, 5), 1.0, 10.0, 1.0), ("A", 1, None, 1, 1, 2, D(2024, 1, 5), 1.0, 5.0, 0.0), ("A", 1, "x", 1, 1, 2, D(2024, 1, 5), 1.0, 5.0, 0.0), ("B", 1, "x", 9, 9, 2, D(2024, 1, 5), 1.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, SALE)
    r = sales.headline(df, "A", D(2024, 1, 5), 1).first()
    assert r.baskets == 2 and r.revenue == 20.0 and r.prev_baskets == 0 and r.revenue_change == 100.0
    assert sales.headline(df, "none", D(2024, 1, 5)).first().avg_basket == 0.0


def test_drilldown_totals_equal_the_rollup(spark):
    at = "/root/testdata/sf0.001"
    from retailops.sources.roles import role

    s, st, it = (role(spark, at, r) for r in ("sales_line", "store", "item_details"))
    top = sales.grand_totals(sales.drilldown(s, st, it, "A", D(2000, 6, 30))).first()
    all_rows = sales.drilldown_rollup(s, st, "A", D(2000, 6, 30)).where("level = 3").first()
    assert (top.val_sales, top.val_tx) == (all_rows.val_sales, all_rows.val_tx)


def test_first_inventory_week_has_eight_days(spark):
    end = D(2024, 3, 31)
    assert [(b - a).days + 1 for a, b in inventory.weeks(end)] == [8, 7, 7, 7, 7, 7]
    loc = spark.createDataFrame([(1, 1), (2, 1)], "item_no long, location_code long")
    led = spark.createDataFrame([(1, 1, "SALES", -2.0, end), (1, 1, "SALES", -3.0, end - dt.timedelta(7)), (1, 1, "SALES", -4.0, end - dt.timedelta(8)), (1, 1, "PURCHASE", 20.0, D(2020, 1, 1)), (1, 1, "SALES", -9.0, end + dt.timedelta(1))], "item_no long, location_code long, entry_type string, quantity double, posting_date date")
    a, b = inventory.daily_inventory(loc, led, end).orderBy("item_no").collect()
    assert (a.stock_on_hand, a.week1_qty, a.week2_qty) == (11.0, -5.0, -4.0) and b.stock_on_hand == 0.0


def test_kpi_periods_go_by_the_calendar(spark):
    df = spark.createDataFrame([("d", "k", 2024, 1, 10.0, 9.0), ("d", "k", 2023, 12, 8.0, 9.0), ("d", "k", 2023, 1, 7.0, 9.0), ("d", "k", 2022, 1, 1.0, 9.0), ("d", " ", 2024, 1, 1.0, 1.0)], "department string, kpi string, year int, month_no int, value double, target double")
    (c,) = kpi.cards(df).collect()
    assert (c.current, c.prev_month, c.prev_year, c.year, c.month) == (10.0, 8.0, 7.0, 2024, 1)
    assert [r.label for r in kpi.trend(df.where("kpi = 'k'")).orderBy("year", "month_no").collect()] == ["Dec '23", "Jan '24"]


HISTORY = "entity_id long, id long, checked_at timestamp_ntz, status string, response_time double"


def history(spark, *steps):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(e, k, t0 + dt.timedelta(hours=h), s, 1.0) for k, (e, h, s) in enumerate(steps)], HISTORY)


def test_incidents_open_and_resolve(spark):
    h = history(spark, (1, 0, "Online"), (1, 1, "Error"), (1, 2, "Offline"), (1, 3, "Online"), (1, 4, "Offline"), (2, 0, "Error"), (2, 1, "Online"))
    ents = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, False)], "entity_id long, entity_type long, is_critical boolean")
    rows = status.incidents(h, ents).orderBy("opened_at").collect()
    assert [(r.severity, r.opened_at.hour, r.resolved_at and r.resolved_at.hour) for r in rows] == [("Critical", 1, 3), ("High", 4, None)]
    assert {r.status: r.n for r in status.current_counts(ents, h).collect()} == {"Offline": 1, "Online": 1, "Unknown": 1}
    assert [r.entity_id for r in status.due(ents, h, dt.datetime(2024, 1, 1, 4, 10)).collect()] == [3, 2]
    assert [r.status for r in status.changes(h).where("entity_id = 1").orderBy("checked_at").collect()] == ["Online", "Error", "Offline", "Online", "Offline"]
    cells = status.grid(ents, h, D(2024, 1, 2), 2)
    assert cells.count() == 6 and {r.entity_id: (r.uptime, r.current) for r in status.grid_uptime(cells).collect()} == {1: (0.0, "Offline"), 2: (100.0, "Online"), 3: (None, "Unknown")}


def test_walks_end_on_cycles_and_diamonds(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4)], "entity_id long, depends_on long")
    found = {(r.node, r.level) for r in graph.reach(edges, spark.createDataFrame([(1,)], "entity_id long")).collect()}
    assert found == {(1, 0), (2, 1), (3, 1), (4, 2)}


def test_newest_feed_rows_with_ties_and_time_zones(spark):
    rows = [("s", 1, "d", "c", 1, 5.0, 1, dt.datetime(2024, 1, 1, 23, 30)), ("s", 1, "d", "c", 1, 6.0, 1, dt.datetime(2024, 1, 2, 1, 0)), ("s", 1, "d", "c", 2, 7.0, 1, dt.datetime(2024, 1, 2, 1, 0)), ("s", None, " ", "c", 2, 7.0, 1, dt.datetime(2024, 1, 2, 1, 0))]
    df = spark.createDataFrame(rows, "scheme string, store_code long, division_name string, category_name string, hour int, net_amount_acy double, total_transactions long, received_at timestamp_ntz")
    assert feed.current(df, D(2024, 1, 2)).count() == 3
    assert feed.current(df, D(2024, 1, 1)).count() == 1
    assert feed.current(df, D(2024, 1, 2), "Asia/Beirut").where("net_amount_acy = 5").count() == 0
    assert {r.division_name for r in feed.rollup(df, "division_name").collect()} == {"d", "unknown"}


def test_online_orders(spark):
    pages = spark.createDataFrame([([("W1", 89700.0, ("LBP", "o1")), ("W1", 2.0, ("USD", "o1"))],)], "value array<struct<ShippingWarehouseId string, LineAmount double, SalesOrderHeader struct<CurrencyCode string, SalesOrderNumber string>>>")
    assert tuple(feed.online_orders(feed.order_lines(pages)).first()) == ("W1", 3.0, 1)


def test_oos_trend_is_null_after_the_day(spark):
    df = spark.createDataFrame([(D(2024, 1, 1),), (D(2024, 1, 1),), (D(2024, 1, 2),)], "as_of_date date")
    rows = oos.trend(df, D(2024, 2, 1), 100).collect()
    assert [r.this_year for r in rows[:3]] == [1.5, 0.0, None] and rows[11].prior_year == 0.0


def test_upsert_rules(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    staged = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (None, "m")], "k long, v string")
    assert sorted(map(tuple, ingest.upsert(target, staged, ["k"]).collect()), key=str) == sorted([(1, "a"), (None, "n"), (2, "x"), (2, "y"), (3, "z"), (None, "m")], key=str)
    assert tuple(ingest.upsert_counts(target, staged, ["k"]).first()) == (3, 1)
    unique = staged.where("k = 3")
    once = ingest.upsert(target, unique, ["k"])
    assert sorted(map(tuple, ingest.upsert(once, unique, ["k"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_validation_and_typing(spark):
    staged = spark.createDataFrame([("1", "x"), ("2", "3"), (None, None)], "`A B` string, n string")
    kind = StructType.fromDDL("a_b bigint, n int")
    assert {r.column_name: (r.n_bad, r.samples) for r in ingest.validate(staged, kind).collect()} == {"a_b": (0, []), "n": (1, ["x"])}
    assert sorted(map(tuple, ingest.typed(staged, kind).collect()), key=str) == [(2, 3), (None, None)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ingest.typed(staged, kind, strict=True).collect()


def test_change_sets(spark):
    target = spark.createDataFrame([(1, 5.0, "a"), (2, 6.0, "b")], "k long, x double, s string")
    new = spark.createDataFrame([(1, "", None), (3, "7", "c")], "k long, x string, s string")
    assert sorted(map(tuple, ingest.apply_changes(target, "k", new).collect())) == [(1, None, None), (2, 6.0, "b")]
    some = spark.createDataFrame([(1, None, "z", ["s"], 1), (1, "8", "y", ["x"], 2), (2, "1", "q", None, 1)], "k long, x string, s string, given array<string>, step int")
    assert sorted(map(tuple, ingest.apply_changes(target, "k", some, order="step", assigned="given").collect())) == [(1, 8.0, "a"), (2, 6.0, "b")]
    with pytest.raises(Exception, match="several updates"):
        ingest.apply_changes(target, "k", some.select("k", "x")).collect()


def test_inspection_of_an_upload(spark):
    staged = spark.createDataFrame([(str(k % 90), f"bad{k % 20:02}", "q") for k in range(1000)], "`A B` string, n string, other string")
    seen = ingest.inspect(staged, StructType.fromDDL("a_b bigint, n int, gone string"), 7)
    assert {r.column_name: (r.n_bad, r.samples) for r in seen.columns.collect()} == {"a_b": (0, []), "n": (1000, [f"bad{k:02}" for k in range(5)])}
    assert (seen.missing, seen.extra, seen.total, seen.preview.count()) == (["gone"], ["other"], 1000, 0)
    kinds, rows, first = ingest.peek(staged, 3)
    assert kinds["n"] == "string" and rows == 1000 and first.count() == 3


def test_tables_are_replaced_by_what_reads_them(spark):
    ingest.load(spark.range(10).withColumnRenamed("id", "k"), "t_self")
    ingest.load(spark.table("t_self").where("k > 3"), "t_self", "replace")
    assert spark.table("t_self").count() == 6
    assert ingest.refresh(spark, "SELECT k + 1 AS k FROM t_self", "t_self") == {"inserted": 6, "updated": 0}
    assert ingest.refresh(spark, "SELECT k FROM t_self WHERE k < 7", "t_self", "upsert", ["k"]) == {"inserted": 0, "updated": 2}
    assert sorted(r.k for r in spark.table("t_self").collect()) == [5, 6, 7, 8, 9, 10]
    with pytest.raises(ValueError):
        ingest.refresh(spark, "SELECT 1 AS k", "t_none", create=False)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("t_self")] == ["t_self"]


def test_audit_search_includes_its_end(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    df = spark.createDataFrame([(k, at(k), 1, f"user{k}", "q" if k == 3 else None) for k in (1, 2, 3)], "event_id long, event_time timestamp_ntz, company_id int, user_name string, query_text string")
    assert [r.event_id for r in tables.audit_search(df, 1, start=at(1), end=at(2)).collect()] == [2, 1]
    assert [r.event_id for r in tables.audit_search(df, 1, "USER2").collect()] == [2] and [r.event_id for r in tables.audit_search(df, 1, "Q").collect()] == [3]
    assert [r.event_id for r in tables.audit_search(df, 1, page=2, page_size=2).collect()] == [1]


def test_utc_windows_of_local_days(spark):
    for day, zone, want in (
        (D(2024, 7, 1), "Asia/Beirut", ("2024-06-30 21:00", "2024-07-01 21:00")),
        (D(2024, 1, 1), "Asia/Beirut", ("2023-12-31 22:00", "2024-01-01 22:00")),
        (D(2024, 3, 31), "Europe/Berlin", ("2024-03-30 23:00", "2024-03-31 22:00")),
        (D(2024, 10, 27), "Europe/Berlin", ("2024-10-26 22:00", "2024-10-27 23:00")),
        (D(2024, 7, 1), "UTC", ("2024-07-01 00:00", "2024-07-02 00:00")),
    ):
        assert tuple(one(spark, *(F.date_format(c, "yyyy-MM-dd HH:mm") for c in exprs.utc_window(day, zone)))) == want


def test_audience_of_a_closure(spark):
    closure = spark.createDataFrame([(1, 1), (1, 2)], "root long, node long")
    contacts = spark.createDataFrame([(1, " A@x ", True), (2, "a@X", True), (2, "b@x", False), (2, " ", True)], "entity_id long, email string, is_active boolean")
    assert [r.email for r in graph.audience(closure, contacts).collect()] == ["a@x"]


def test_tables_load_and_swap(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert ingest.load(df, "t_load") == {"inserted": 2, "updated": 0}
    assert ingest.load(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), "t_load", "upsert", ["k"]) == {"inserted": 1, "updated": 1}
    assert {tuple(r) for r in spark.table("t_load").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    ingest.move(spark, "t_load", "t_moved")
    assert not spark.catalog.tableExists("t_load") and spark.table("t_moved").count() == 3
    with pytest.raises(ValueError):
        ingest.load(df, "no-name")
    path = str(tmp_path / "swap")
    ingest.swap_in(df, path)
    ingest.swap_in(spark.read.parquet(path).where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception):  # noqa: B017  a failed write leaves the table
        ingest.swap_in(df.select(F.raise_error(F.lit("no")).alias("k")), path)
    assert spark.read.parquet(path).count() == 1


def test_security(spark):
    df = spark.createDataFrame([("a", 1, 9), ("b", 2, 9)], "Seg string, id int, hidden int")
    assert security.secured(df, ["SEG", "id"], {"seg": ["a"]}).collect() == [("a", 1)]
    assert security.secured(df, ["id"], {"seg": []}).count() == 0
    assert security.secured(df, ["id"], {"seg": ["a", *map(str, range(300))]}).count() == 1
    for bad in ("{", '{"a": 1}', "[[1]]", "[null]"):
        with pytest.raises(PermissionError):
            security.allowed_values(bad)
    with pytest.raises(PermissionError):
        security.secured(df, ["nothing"], {})
    with pytest.raises(PermissionError):
        security.run_secured(spark, "SELECT id AS hidden FROM sec_t", {"sec_t": df}, {"sec_t": ["id"]}, {}, ["hidden"])


def test_table_queries(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, "x"), (4, None)], "k long, v string")
    assert [r.v for r in tables.sorted_as_numbers(df, "v").collect()] == ["9", "10", "x", None]
    by = lambda *given: [r.k for r in tables.metric_filters(df, [dict(zip(("column", "operator", "value", "default"), g)) for g in given]).collect()]
    assert by(("k", "BETWEEN", "1")) == by(("k", "IN", ";")) == by(("v", "=", " ", "9")) == [1, 2, 3, 4]
    assert by(("v", "=", None, "9")) == by(("v", "unheard of", "9")) == [2] and by(("k", "=", 0)) == [] and by(("k", ">", 0)) == [1, 2, 3, 4]
    assert by(("v", "LIKE", "1")) == [] and by(("v", "LIKE", "1%")) == [1] and by(("v", "NOT LIKE", "1_")) == [2, 3] and by(("v", "=", "9;10")) == []
    assert tables.audit_search(df, "").count() == 0
    some = [{"column": "k", "operator": "IN", "value": "1;; 3;"}]
    assert [r.k for r in tables.metric_filters(df, some).collect()] == [1, 3]
    assert tables.metric_filters(df, [{"column": "k", "operator": "BETWEEN", "value": "1;2;"}]).count() == 2
    assert tables.column_difference(df.select("k"), df) == (["v"], [])
    many = spark.range(1000).select((F.col("id") % 100).alias("d"), F.lit(1).alias("x"))
    assert [r.running for r in tables.running_total(many, "d", "x").orderBy("d").collect()] == [10 * (k + 1) for k in range(100)]


def test_steps(spark, tmp_path):
    steps = [Step("c", "SELECT sum(x) AS s FROM b", ("b",)), Step("a", "SELECT explode(sequence(1, {{n}})) AS x"), Step("b", "SELECT x * 2 AS x FROM a", ("a",))]
    assert [s.name for s in order(steps)] == ["a", "b", "c"]
    assert [(o.status, o.rows) for o in run(spark, steps, {"n": 3})] == [("done", 3), ("done", 3), ("done", 1)]
    written = [Step("w", "SELECT uuid() AS u"), Step("x", "SELECT u FROM w", ("w",))]
    assert [o.rows for o in run(spark, written, folder=str(tmp_path))] == [1, 1] and spark.table("w").first() == spark.table("x").first()
    bad = [Step("a", "SELECT nothing"), Step("b", "SELECT 1", ("a",))]
    assert [o.status for o in run(spark, bad)] == ["failed", "skipped"]
    with pytest.raises(ValueError, match="cycle"):
        order([Step("a", "", ("b",)), Step("b", "", ("a",))])
    with pytest.raises(KeyError):
        with_parameters(spark, "SELECT {{x}}", {})
