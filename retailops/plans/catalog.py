"""The registered retail queries and their DuckDB twins, at fixed dates of the shared tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import feed, graph, ingest, inventory, kpi, oos, pages, sales, security, status, tables
from ..operators.buckets import Bucketed
from ..session import shared_folder
from ..sources import audit_index, files
from ..sources.roles import ROLES, ctes, role
from . import report_twins, reports
from .twins import plain_types

AS_OF, DAY, CO = dt.date(2000, 6, 30), dt.date(2024, 1, 30), "A"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (role by name) under a name, with its twin."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _plain(f(lambda r: _read(spark, sf_dir, r)))
        if sql:
            SQL[name] = plain_types(sql)
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role, or a table as it is."""
    return role(spark, sf_dir, name) if name in ROLES else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _bucketed(df: DataFrame, key: str) -> Bucketed:
    table = Bucketed.create(df.sparkSession, _folder(df, "buckets"), df.schema, [key], 8)
    table.load(df)
    return table


def _plain(df: DataFrame) -> DataFrame:
    """Sums are exact decimals; results are doubles."""
    return df.withColumns({c: F.col(c).cast("double") for c, k in df.dtypes if k.startswith("decimal")})


for _name, _spec in reports.REPORTS.items():
    QUERIES[_name] = lambda spark, sf_dir, spec=_spec: _plain(reports.run(spark, sf_dir, spec))
    SQL[_name] = plain_types(report_twins.SQL[_name])

# --- sales ---------------------------------------------------------------------------------------------------------------

_BASKET = "(store_code, pos_number, transaction_no, receipt_no)"
_JUNE = "company_id = 'A' AND date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'"


@query(
    "a1_a2_headline",
    f"""{ctes("sales_line")}, t AS (SELECT
  coalesce(sum(net_amount_acy) FILTER (date >= DATE '2000-06-01'), 0) AS r, coalesce(sum(quantity) FILTER (date >= DATE '2000-06-01'), 0) AS u,
  count(DISTINCT {_BASKET}) FILTER (date >= DATE '2000-06-01') AS b, coalesce(sum(total_discount_acy) FILTER (date >= DATE '2000-06-01'), 0) AS d,
  coalesce(sum(net_amount_acy) FILTER (date < DATE '2000-06-01'), 0) AS pr, count(DISTINCT {_BASKET}) FILTER (date < DATE '2000-06-01') AS pb
  FROM sales_line WHERE company_id = 'A' AND date BETWEEN DATE '2000-05-02' AND DATE '2000-06-30')
SELECT round(r, 2) AS revenue, round(u, 2) AS units, b AS baskets, round(d, 2) AS discount, round(CASE WHEN b > 0 THEN r / b ELSE 0 END, 2) AS avg_basket,
  round(CASE WHEN r + d > 0 THEN d * 100 / (r + d) ELSE 0 END, 2) AS discount_pct, round(pr, 2) AS prev_revenue, pb AS prev_baskets,
  round(CASE WHEN pr > 0 THEN (r - pr) / pr * 100 WHEN r > 0 THEN 100 ELSE 0 END, 2) AS revenue_change,
  round(CASE WHEN pb > 0 THEN (b - pb) * 100.0 / pb WHEN b > 0 THEN 100 ELSE 0 END, 2) AS baskets_change FROM t""",
)
def _(t):
    return sales.headline(t("sales_line"), CO, AS_OF)


@query("a3_daily_trend", f"{ctes('sales_line')} SELECT date, round(sum(net_amount_acy), 2) AS revenue, round(sum(quantity), 2) AS units, count(DISTINCT {_BASKET}) AS baskets FROM sales_line WHERE {_JUNE} GROUP BY date")
def _(t):
    return sales.daily_trend(t("sales_line"), CO, AS_OF)


@query("a4_by_store", f"{ctes('sales_line', 'store')} SELECT coalesce(nullif(store, ''), CAST(store_code AS VARCHAR)) AS store, round(sum(net_amount_acy), 2) AS revenue FROM sales_line LEFT JOIN store ON store_code = code WHERE {_JUNE} GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 20")
def _(t):
    return sales.by_store(t("sales_line"), t("store"), CO, AS_OF)


_CATEGORY = """SELECT coalesce(nullif(category, ''), nullif(i.category_code, ''), 'Unknown') AS category, round(sum(net_amount_acy), 2) AS revenue FROM sales_line s
  LEFT JOIN item_details i ON s.item_no = i.item_no LEFT JOIN {h} h ON h.category_code = i.category_code WHERE {j} GROUP BY 1 ORDER BY revenue DESC, 1 LIMIT 12"""


@query("a5_by_category", f"{ctes('sales_line', 'item_details', 'product_hierarchy')} " + _CATEGORY.format(h="(SELECT category_code, min(category) AS category FROM product_hierarchy GROUP BY 1)", j=_JUNE))
def _(t):
    return sales.by_category(t("sales_line"), t("item_details"), t("product_hierarchy"), CO, AS_OF)


@query("a5_by_category_fan_out", f"{ctes('sales_line', 'item_details', 'product_hierarchy')} " + _CATEGORY.format(h="product_hierarchy", j=_JUNE))
def _(t):
    return sales.by_category(t("sales_line"), t("item_details"), t("product_hierarchy"), CO, AS_OF, dedupe=False)


@query("a6_by_hour", f"{ctes('feed')} SELECT hour(received_at) AS hour, round(sum(net_amount_acy), 2) AS revenue, count(*) AS lines FROM feed GROUP BY 1")
def _(t):
    return sales.by_hour(t("feed"))


@query("a7_payment_mix", f"{ctes('sales_header')} SELECT coalesce(nullif(payment_method, ''), 'Unknown') AS method, count(*) AS orders, round(sum(delivery_charge), 2) AS charges FROM sales_header WHERE company_id = 'F' AND date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' GROUP BY 1 ORDER BY orders DESC, 1 LIMIT 12")
def _(t):
    return sales.payment_mix(t("sales_header"), "F", (dt.date(2000, 1, 1), AS_OF))


@query("a8_top_items", f"{ctes('sales_line', 'item_details')}, b AS (SELECT item_no, round(sum(net_amount_acy), 2) AS revenue, round(sum(quantity), 2) AS units FROM sales_line WHERE {_JUNE} GROUP BY 1 ORDER BY revenue DESC, item_no LIMIT 15) SELECT b.item_no, coalesce(nullif(description, ''), CAST(b.item_no AS VARCHAR)) AS item, revenue, units FROM b JOIN item_details i ON b.item_no = i.item_no")
def _(t):
    return sales.top_items(t("sales_line"), t("item_details"), CO, AS_OF)


def _four_sql(key: str, joins: str, scope: str = "MTD", view: str = "ToDate", where: str = "TRUE", roles: tuple[str, ...] = ("sales_line", "store", "item_details")) -> str:
    w = {k: f"date BETWEEN DATE '{a}' AND DATE '{b}'" for k, (a, b) in sales.comparison_windows(AS_OF, scope, view).items()}
    cols = ", ".join(f"round(coalesce(sum(net_amount_acy) FILTER ({c}), 0), 2) AS {k}_sales, count(DISTINCT {_BASKET}) FILTER ({c}) AS {k}_tx" for k, c in w.items())
    return f"{ctes(*roles)} SELECT {key} AS label, {cols} FROM sales_line l {joins} WHERE company_id = 'A' AND ({' OR '.join(w.values())}) AND {where} GROUP BY 1"


_ST, _IT = "LEFT JOIN store s ON l.store_code = s.code", "LEFT JOIN item_details i ON l.item_no = i.item_no"
_SCHEME = "coalesce(nullif(store_scheme, ''), 'Unknown')"


def _drill(name: str, sql: str, **how) -> None:
    @query(name, sql)
    def _(t):
        return sales.drilldown(t("sales_line"), t("store"), t("item_details"), CO, AS_OF, **how)


_drill("a9_drilldown_scheme", _four_sql(_SCHEME, _ST))
_drill("a9_drilldown_store", _four_sql("coalesce(nullif(store, ''), CAST(store_code AS VARCHAR))", _ST, where=f"{_SCHEME} = 'NATION_3'"), level="store", scheme="NATION_3")
_drill("a9_drilldown_division_ytd", _four_sql("coalesce(nullif(division_code, ''), 'Unknown')", _IT, "YTD"), level="division", scope="YTD")
_drill("a9_drilldown_category_day", _four_sql("coalesce(nullif(category_code, ''), 'Unknown')", _IT, "MTD", "Day", "division_code = 'ECONOMY'"), level="category", view="Day", division="ECONOMY")
_drill("a10_single_day", _four_sql(_SCHEME, _ST, "Day", "Day"), scope="Day", view="Day")

_SUM = ", ".join(f"round(sum({w}_sales), 2) AS {w}_sales" for w in ("val", "lm", "ly")) + ", " + ", ".join(f"CAST(sum({w}_tx) AS BIGINT) AS {w}_tx" for w in ("val", "lm", "ly"))
_VS = "CASE WHEN {b} <= 0 AND val_sales > 0 THEN 'new' WHEN {b} <= 0 THEN 'flat' WHEN abs((val_sales - {b}) / {b} * 100) < 0.05 THEN 'flat' WHEN val_sales > {b} THEN 'up' ELSE 'down' END"


@query("a11_grand_totals", f"SELECT *, round(CASE WHEN val_tx > 0 THEN val_sales / val_tx ELSE 0 END, 2) AS avg_basket, {_VS.format(b='lm_sales')} AS vs_lm, {_VS.format(b='ly_sales')} AS vs_ly FROM (SELECT {_SUM} FROM ({_four_sql(_SCHEME, _ST)}))")
def _(t):
    return sales.grand_totals(sales.drilldown(t("sales_line"), t("store"), t("item_details"), CO, AS_OF))


@query("a42_rollup", f"SELECT scheme, store, CAST(grouping(scheme) * 2 + grouping(store) AS BIGINT) AS level, {_SUM} FROM ({_four_sql(_SCHEME, _ST).replace(' AS label,', ' AS scheme, store,', 1).replace('GROUP BY 1', 'GROUP BY 1, 2')}) GROUP BY ROLLUP (scheme, store)")
def _(t):
    return sales.drilldown_rollup(t("sales_line"), t("store"), CO, AS_OF)


# --- inventory -----------------------------------------------------------------------------------------------------------

_WEEKS = ", ".join(f"round(coalesce(sum(l.quantity) FILTER (entry_type = 'SALES' AND posting_date BETWEEN DATE '{a}' AND DATE '{b}'), 0), 2) AS week{k}_qty" for k, (a, b) in enumerate(inventory.weeks(AS_OF), 1))
_INV = f"""SELECT il.item_no, il.location_code, round(coalesce(sum(l.quantity), 0), 2) AS stock_on_hand, {_WEEKS} FROM item_location il
  LEFT JOIN (SELECT * FROM ledger WHERE posting_date <= DATE '2000-06-30') l ON il.item_no = l.item_no AND il.location_code = l.location_code"""


@query("a12_daily_inventory", f"{ctes('item_location', 'ledger')} {_INV} GROUP BY 1, 2")
def _(t):
    return inventory.daily_inventory(t("item_location"), t("ledger"), AS_OF)


@query("a12_inventory_with_stock_page", f"{ctes('item_location', 'ledger')} SELECT * FROM ({_INV} WHERE il.location_code IN (1, 2, 3, 4, 5) GROUP BY 1, 2) WHERE stock_on_hand > 0 ORDER BY item_no, location_code LIMIT 50 OFFSET 10")
def _(t):
    return inventory.page(inventory.daily_inventory(t("item_location"), t("ledger"), AS_OF, at=[1, 2, 3, 4, 5], has_stock=True), inventory.KEYS, 50, 10)


@query("a12_inventory_with_sales", f"{ctes('item_location', 'ledger')} SELECT * FROM ({_INV} WHERE contains(CAST(il.item_no AS VARCHAR), '7') GROUP BY 1, 2) WHERE week1_qty <> 0 OR week2_qty <> 0 OR week3_qty <> 0 OR week4_qty <> 0 OR week5_qty <> 0 OR week6_qty <> 0")
def _(t):
    return inventory.daily_inventory(t("item_location"), t("ledger"), AS_OF, contains="7", has_sales=True)


@query("a13_locations", f"{ctes('store')} SELECT code, store FROM store WHERE code IS NOT NULL")
def _(t):
    return inventory.locations(t("store"))


@query("j4_item_details", f"{ctes('item_details', 'item_location')} SELECT item_no, description, category_code FROM item_details WHERE item_no IN (SELECT item_no FROM item_location WHERE location_code = 7)")
def _(t):
    return inventory.details(t("item_details"), t("item_location").where("location_code = 7"), ["description", "nothing", "category_code", "description"])


# --- feed ----------------------------------------------------------------------------------------------------------------

_STATE = f"{ctes('feed')}, st AS (SELECT * FROM feed WHERE day = DATE '2024-01-29' QUALIFY rank() OVER (PARTITION BY store_code, scheme, division_name, category_name ORDER BY received_at DESC) = 1)"
_NOW = dt.date(2024, 1, 29)


def _state(t) -> DataFrame:
    return feed.current(t("feed"), _NOW)


@query("a17_current_state", f"{_STATE} SELECT event_id, scheme, store_code, net_amount_acy FROM st")
def _(t):
    return _state(t).select("event_id", "scheme", "store_code", "net_amount_acy")


@query("a18_feed_kpis", f"{_STATE} SELECT round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, count(DISTINCT store_code) AS stores, count(DISTINCT scheme) AS schemes, max(received_at) AS updated FROM st")
def _(t):
    return feed.kpis(_state(t))


@query("a18_banner_rollup", f"{_STATE} SELECT scheme, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, count(*) AS n FROM st GROUP BY 1")
def _(t):
    return feed.rollup(_state(t), "scheme")


@query("a19_feed_totals", f"{ctes('feed')} SELECT CAST(store_code AS VARCHAR) AS store_code, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, count(*) AS n FROM feed WHERE hour BETWEEN 8 AND 20 GROUP BY 1")
def _(t):
    return feed.rollup(feed.select(t("feed"), hours=(8, 20)), "store_code")


@query("a20_rollups", f"{_STATE} SELECT CAST(division_name AS VARCHAR) AS division_name, CAST(category_name AS VARCHAR) AS category_name, CAST(store_code AS VARCHAR) AS store_code, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, CAST(grouping(division_name) * 4 + grouping(category_name) * 2 + grouping(store_code) AS BIGINT) AS level FROM st GROUP BY GROUPING SETS ((division_name), (category_name), (division_name, category_name), (store_code))")
def _(t):
    return feed.rollups(_state(t))


@query("a21_day_snapshot", f"{_STATE} SELECT scheme, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, round(coalesce(sum(net_amount_acy) / nullif(sum(total_transactions), 0), 0), 2) AS avg_basket, count(DISTINCT store_code) AS stores, max(hour) AS last_hour FROM st GROUP BY 1")
def _(t):
    return feed.day_snapshot(t("feed"), _NOW)


_LINES = "SELECT l_suppkey AS store_no, p_brand AS item_category_code, CAST(l_linenumber AS VARCHAR) AS pos_terminal_no, l_orderkey AS transaction_no, l_partkey % 24 AS hour, l_extendedprice AS net_amount FROM {a} JOIN {b} ON l_partkey = p_partkey"


@query(
    "a14_live_store_sales",
    f"WITH good AS (SELECT * FROM ({_LINES.format(a='lineitem', b='part')}) WHERE pos_terminal_no <> '3'), s AS (SELECT store_no, count(DISTINCT transaction_no) AS tx, count(DISTINCT item_category_code) AS c FROM good GROUP BY 1), "
    "r AS (SELECT o_totalprice AS market FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) SELECT g.store_no, item_category_code, max(hour) AS hour, round(-sum(net_amount) / CASE WHEN g.store_no = 1 THEN max(market) ELSE 89700 END, 4) AS net_amount_acy, round(max(tx) / max(c), 4) AS store_transactions, count(*) AS lines FROM good g JOIN s USING (store_no), r GROUP BY 1, 2",
)
def _(t):
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_suppkey AS store_no", "p_brand AS item_category_code", "CAST(l_linenumber AS string) AS pos_terminal_no", "l_orderkey AS transaction_no", "l_partkey % 24 AS hour", "l_extendedprice AS net_amount")
    terminals = lines.selectExpr("pos_terminal_no AS no", "CASE WHEN pos_terminal_no = '3' THEN 'KIOSK' ELSE 'TILL' END AS hardware_profile").distinct()
    rates = t("orders").select(F.struct("o_orderdate", "o_orderkey").alias("date"), F.col("o_totalprice").alias("rate"))
    return feed.live_store_sales(lines, terminals, rates, 1, "KIOSK")


# --- out of stock --------------------------------------------------------------------------------------------------------

_LATEST = f"{ctes('oos')}, o AS (SELECT * FROM oos WHERE as_of_date = (SELECT max(as_of_date) FROM oos))"


@query("a22_latest_snapshot", f"{_LATEST} SELECT item_no, store, days_out, lost, state FROM o")
def _(t):
    return oos.latest(t("oos")).select("item_no", "store", "days_out", "lost", "state")


@query(
    "a23_trend",
    f"""{ctes("oos")}, d AS (SELECT as_of_date, count(*) AS n FROM oos WHERE year(as_of_date) IN (1999, 2000) GROUP BY 1),
m AS (SELECT month(as_of_date) AS month, avg(n) FILTER (year(as_of_date) = 2000) AS a, avg(n) FILTER (year(as_of_date) = 1999) AS b FROM d GROUP BY 1)
SELECT CAST(k AS INTEGER) AS month, CASE WHEN k <= 6 THEN round_even(coalesce(a, 0) / 2000.0 * 100, 2) END AS this_year, round_even(coalesce(b, 0) / 2000.0 * 100, 2) AS prior_year FROM range(1, 13) x(k) LEFT JOIN m ON m.month = k""",
)
def _(t):
    return oos.trend(t("oos"), AS_OF, 2000)


@query("a24_summary", f"{_LATEST} SELECT count(*) AS n, round_even(count(*) * 100.0 / 2000.0, 2) AS rate, round(coalesce(sum(lost), 0), 2) AS lost, count(DISTINCT store) AS stores FROM o WHERE state = 'out'")
def _(t):
    return oos.summary(oos.filtered(oos.latest(t("oos")), state="out"), 2000)


@query("a24_suppliers", f"{_LATEST} SELECT supplier, count(*) AS n, round(sum(lost), 2) AS lost, round(coalesce(avg(days_out) FILTER (state <> 'low'), 0), 4) AS days_out, CAST(coalesce(min(fill_rate), 90) AS DOUBLE) AS fill_rate FROM o GROUP BY 1")
def _(t):
    return oos.suppliers(oos.latest(t("oos")))


@query("a24_top_stores", f"{_LATEST} SELECT store, round(sum(lost), 2) AS lost FROM o GROUP BY 1 ORDER BY lost DESC, store LIMIT 10")
def _(t):
    return oos.top_stores(oos.latest(t("oos")))


@query("a24_by_warehouse", f"{_LATEST} SELECT warehouse, count(*) AS n FROM o GROUP BY 1")
def _(t):
    return oos.counts(oos.latest(t("oos")), "warehouse")


@query("a25_filter_values", f"{_LATEST} SELECT DISTINCT category FROM o WHERE trim(category) <> ''")
def _(t):
    return oos.values(oos.latest(t("oos")), "category")


# --- KPIs ----------------------------------------------------------------------------------------------------------------

_CARDS = f"""{ctes("kpi")}, r AS (SELECT *, year * 12 + month_no AS p FROM kpi), l AS (SELECT department, kpi, max(p) AS latest FROM r GROUP BY 1, 2),
cards AS (SELECT r.department, r.kpi, 'num' AS unit, CASE WHEN contains(lower(r.kpi), 'return') THEN 'down' ELSE 'up' END AS direction, max(value) FILTER (p = latest) AS current, max(target) FILTER (p = latest) AS target, max(value) FILTER (p = latest - 1) AS prev_month,
  max(value) FILTER (p = latest - 12) AS prev_year, CAST(floor((max(latest) - 1) / 12) AS INTEGER) AS year, CAST(max(latest) - floor((max(latest) - 1) / 12) * 12 AS INTEGER) AS month FROM r JOIN l USING (department, kpi) GROUP BY 1, 2)"""


@query("a26_kpi_cards", f"{_CARDS} SELECT * FROM cards")
def _(t):
    return kpi.cards(t("kpi"))


@query("a27_kpi_trend", f"{ctes('kpi')}, l AS (SELECT department, kpi, max(year * 12 + month_no) AS latest, max(year) AS y FROM kpi GROUP BY 1, 2) SELECT department, kpi, year, month_no, strftime(make_date(year, month_no, 1), '%b ''%y') AS label, value, target FROM kpi JOIN l USING (department, kpi) WHERE year * 12 + month_no BETWEEN y * 12 AND latest")
def _(t):
    return kpi.trend(t("kpi"))


@query("a28_kpi_status", f"{_CARDS}, p AS (SELECT CASE WHEN target > 0 THEN current / target * 100 WHEN current > 0 THEN 100 ELSE 0 END AS pct FROM cards) SELECT CASE WHEN pct >= 100 THEN 'good' WHEN pct >= 90 THEN 'warn' ELSE 'bad' END AS status, count(*) AS n FROM p GROUP BY 1")
def _(t):
    return kpi.status_counts(kpi.cards(t("kpi")))


_VALUES = "SELECT o_orderkey AS value_id, o_orderpriority AS metric_id, CAST(o_orderdate AS DATE) AS period_date, o_totalprice AS numeric_value FROM {o}"
_TARGETS = "SELECT o_orderpriority AS metric_id, CAST(min(o_orderdate) AS DATE) AS start_date, CASE WHEN year(o_orderdate) = 2001 THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS end_date, round(avg(o_totalprice), 2) AS target, year(o_orderdate) <> 1998 AS is_active FROM {o} GROUP BY o_orderpriority, year(o_orderdate)"


@query("j8_active_target", f"WITH v AS ({_VALUES.format(o='orders')}), g AS ({_TARGETS.format(o='orders')}) SELECT v.*, target, start_date AS target_start FROM v LEFT JOIN g ON v.metric_id = g.metric_id AND is_active AND start_date <= period_date AND (end_date IS NULL OR end_date >= period_date) QUALIFY row_number() OVER (PARTITION BY value_id ORDER BY start_date DESC, target DESC) = 1")
def _(t):
    o = t("orders")
    return kpi.active_target(o.sparkSession.sql(_VALUES, o=o), o.sparkSession.sql(_TARGETS, o=o))


# --- status --------------------------------------------------------------------------------------------------------------

_H = ctes("status_history", "entity")
_LAST = f"{_H}, last AS (SELECT * FROM status_history QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY checked_at DESC, id DESC) = 1)"


@query("w1_latest_status", f"{_LAST} SELECT entity_id, checked_at, status FROM last")
def _(t):
    return status.latest(t("status_history")).select("entity_id", "checked_at", "status")


@query("a30_current_counts", f"{_LAST} SELECT coalesce(status, 'Unknown') AS status, count(*) AS n FROM entity LEFT JOIN last USING (entity_id) GROUP BY 1")
def _(t):
    return status.current_counts(t("entity"), t("status_history"))


@query("a29_status_counts", f"{_H} SELECT entity_id, status, count(*) AS n FROM status_history GROUP BY 1, 2")
def _(t):
    return status.status_counts(t("status_history"))


@query("a31_due", f"{_H} SELECT entity_id, max(checked_at) AS last_check FROM entity LEFT JOIN status_history USING (entity_id) GROUP BY 1 HAVING max(checked_at) IS NULL OR max(checked_at) < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 15 MINUTE")
def _(t):
    return status.due(t("entity"), t("status_history"), dt.datetime(2024, 1, 29, 12))


@query("a34_entity_stats", f"{_H} SELECT entity_id, count(*) AS checks, round(coalesce(avg(response_time), 0), 4) AS response, round_even(count_if(status = 'Online') * 100.0 / count(*), 1) AS uptime, count_if(status IN ('Offline', 'Error')) AS incidents, count_if(status = 'Degraded') AS degraded FROM status_history GROUP BY 1")
def _(t):
    return status.per_entity(t("status_history")).select("entity_id", "checks", "response", "uptime", "incidents", "degraded")


_GRID = f"""{_H}, days AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2024-01-17', DATE '2024-01-31', INTERVAL 1 DAY) x(d)),
seen AS (SELECT entity_id, CAST(checked_at AS DATE) AS day, status FROM status_history QUALIFY row_number() OVER (PARTITION BY entity_id, CAST(checked_at AS DATE) ORDER BY checked_at DESC, id DESC) = 1),
cells AS (SELECT e.entity_id, d.day, status FROM entity e CROSS JOIN days d LEFT JOIN seen s ON s.entity_id = e.entity_id AND s.day = d.day)"""


@query("a32_status_grid", f"{_GRID} SELECT * FROM cells")
def _(t):
    return status.grid(t("entity"), t("status_history"), DAY, 14)


@query("a32_grid_uptime", f"{_GRID} SELECT entity_id, count(status) AS days, round_even(count_if(status = 'Online') * 100.0 / nullif(count(status), 0), 1) AS uptime, coalesce(arg_max(status, day) FILTER (status IS NOT NULL), 'Unknown') AS current FROM cells GROUP BY 1")
def _(t):
    return status.grid_uptime(status.grid(t("entity"), t("status_history"), DAY, 14))


@query("a33_groups", f"{_LAST} SELECT entity_type, count(*) AS n, arg_max(coalesce(status, 'Unknown'), CASE coalesce(status, 'Unknown') WHEN 'Error' THEN 5 WHEN 'Offline' THEN 5 WHEN 'Degraded' THEN 4 WHEN 'Maintenance' THEN 3 WHEN 'Unknown' THEN 2 ELSE 1 END) AS worst FROM entity LEFT JOIN last USING (entity_id) GROUP BY 1")
def _(t):
    return status.groups(t("entity"), t("status_history"))


@query(
    "a35_hourly_status",
    f"{_H}, b AS (SELECT date_trunc('hour', checked_at) AS hour, arg_max(status, CASE status WHEN 'Error' THEN 6 WHEN 'Offline' THEN 5 WHEN 'Degraded' THEN 4 WHEN 'Maintenance' THEN 3 WHEN 'Online' THEN 2 ELSE 1 END) AS status, count(*) AS checks FROM status_history GROUP BY 1) SELECT h AS hour, status, coalesce(checks, 0) AS checks FROM range(TIMESTAMP '2024-01-28 00:00:00', TIMESTAMP '2024-01-31 00:00:00', INTERVAL 1 HOUR) x(h) LEFT JOIN b ON b.hour = h",
)
def _(t):
    return status.hourly(t("status_history"), dt.datetime(2024, 1, 28), 72)


_FRESH = "TIMESTAMP '2024-01-31 00:00:00'"


_FRESHNESS = f"""SELECT 'events' AS table_name, count(*) AS n_rows, CAST(floor((epoch({_FRESH}) - floor(epoch(max(ts)))) / 60) AS BIGINT) AS age_minutes, CASE WHEN floor((epoch({_FRESH}) - floor(epoch(max(ts)))) / 60) > 60 THEN 'Degraded' ELSE 'Online' END AS state FROM events
UNION ALL SELECT 'orders', count(*), CAST(floor((epoch({_FRESH}) - epoch(max(o_orderdate))) / 60) AS BIGINT), CASE WHEN floor((epoch({_FRESH}) - epoch(max(o_orderdate))) / 60) > 100000000 THEN 'Degraded' ELSE 'Online' END FROM orders
UNION ALL SELECT 'no_times', count(*), NULL, 'Degraded' FROM customer UNION ALL SELECT 'no_column', NULL, NULL, 'Error'"""


@query("a36_freshness", _FRESHNESS)
def _(t):
    untimed = t("customer").select(F.lit(None).cast("timestamp_ntz").alias("at"))
    return status.freshness({"events": (t("events"), "ts", 60), "orders": (t("orders"), "o_orderdate", 100000000), "no_times": (untimed, "at", 60), "no_column": (t("part"), "at", 60)}, dt.datetime(2024, 1, 31))


@query("a36_freshness_from_footers", _FRESHNESS)
def _(t):
    untimed = t("customer").select("c_custkey", F.lit(None).cast("timestamp_ntz").alias("at"))
    events, orders, no_times, no_column = (_bucketed(df, key) for df, key in ((t("events"), "event_id"), (t("orders"), "o_orderkey"), (untimed, "c_custkey"), (t("part"), "p_partkey")))
    return status.freshness({"events": (events, "ts", 60), "orders": (orders, "o_orderdate", 100000000), "no_times": (no_times, "at", 60), "no_column": (no_column, "at", 60)}, dt.datetime(2024, 1, 31))


@query("a37_stale_runs", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-10 00:00:00' THEN 'Failed' WHEN event_type = 'view' THEN 'Running' ELSE 'Done' END AS status FROM events")
def _(t):
    runs = t("events").selectExpr("event_id", "CASE WHEN event_type = 'view' THEN 'Running' ELSE 'Done' END AS status", "ts AS started_at")
    return status.fail_stale(runs, dt.datetime(2024, 1, 10)).select("event_id", "status")


@query("w2_last_of_day", f"{_GRID} SELECT entity_id, day, status FROM seen WHERE day = DATE '2024-01-20'")
def _(t):
    return status.grid(t("entity"), t("status_history"), dt.date(2024, 1, 20), 1).where("status IS NOT NULL")


@query("w3_status_changes", f"{_H} SELECT * FROM (SELECT entity_id, checked_at, lag(status) OVER (PARTITION BY entity_id ORDER BY checked_at, id) AS before, status FROM status_history) WHERE before IS NULL OR before <> status")
def _(t):
    return status.changes(t("status_history"))


@query(
    "w5_incidents",
    f"""{_H}, s AS (SELECT entity_id, checked_at, status, lag(status, 1, 'Unknown') OVER w AS before, min(CASE WHEN status = 'Online' THEN checked_at END) OVER (PARTITION BY entity_id ORDER BY checked_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resolved_at
  FROM status_history WINDOW w AS (PARTITION BY entity_id ORDER BY checked_at, id))
SELECT entity_id, checked_at AS opened_at, resolved_at, status, CASE WHEN status = 'Error' THEN 'Critical' WHEN status = 'Offline' AND is_critical THEN 'High' WHEN status = 'Maintenance' THEN 'Low' ELSE 'Medium' END AS severity FROM s LEFT JOIN entity USING (entity_id) WHERE before = 'Online' AND status <> 'Online'""",
)
def _(t):
    return status.incidents(t("status_history"), t("entity"))


# --- dependencies --------------------------------------------------------------------------------------------------------

_DEP = ctes("dependency", "status_history", "entity").replace("WITH ", "WITH RECURSIVE ", 1)
_UP = "up(root, node, level) AS (SELECT entity_id, entity_id, 0 FROM entity UNION SELECT root, depends_on, level + 1 FROM up JOIN dependency d ON d.entity_id = node WHERE level < {d}), upm AS (SELECT root, node, min(level) AS level FROM up GROUP BY 1, 2)"


@query("j10_closure", f"{_DEP}, {_UP.format(d=10)} SELECT root, node, CAST(level AS INTEGER) AS level FROM upm")
def _(t):
    return graph.reach(t("dependency"), t("entity").select("entity_id"))


@query(
    "j12_impact",
    f"""{_DEP}, {_UP.format(d=5)}, down(root, node, level) AS (SELECT entity_id, entity_id, 0 FROM entity UNION SELECT root, d.entity_id, level + 1 FROM down JOIN dependency d ON d.depends_on = node WHERE level < 5),
last AS (SELECT * FROM status_history QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY checked_at DESC, id DESC) = 1),
f AS (SELECT e.entity_id AS node, is_critical, coalesce(status IN ('Offline', 'Error', 'Degraded'), FALSE) AS ill FROM entity e LEFT JOIN last USING (entity_id)),
u AS (SELECT root, count(*) AS upstream, count_if(ill) AS root_causes FROM upm JOIN f USING (node) WHERE level > 0 GROUP BY 1),
w AS (SELECT root, count(*) AS downstream, count_if(is_critical) AS critical, count_if(ill) AS unhealthy FROM (SELECT root, node, min(level) AS level FROM down GROUP BY 1, 2) JOIN f USING (node) WHERE level > 0 GROUP BY 1)
SELECT entity_id, coalesce(upstream, 0) AS upstream, coalesce(root_causes, 0) AS root_causes, coalesce(downstream, 0) AS downstream, coalesce(critical, 0) AS critical, coalesce(unhealthy, 0) AS unhealthy
FROM entity LEFT JOIN u ON u.root = entity_id LEFT JOIN w ON w.root = entity_id""",
)
def _(t):
    return graph.impact(t("dependency"), t("entity"), status.latest(t("status_history")))


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("j1_star_join", f"{ctes('sales_line', 'store')} SELECT store_scheme, count(*) AS n, round(sum(net_amount_acy), 2) AS revenue FROM sales_line LEFT JOIN store ON store_code = code GROUP BY 1")
def _(t):
    return t("sales_line").join(sales.small(t("store")), F.expr("store_code = code"), "left").groupBy("store_scheme").agg(F.count("*").alias("n"), F.round(F.sum("net_amount_acy"), 2).alias("revenue"))


@query("j3_anti_join", "SELECT count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(t):
    bad = t("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return t("lineitem").join(bad, "l_suppkey", "left_anti").agg(F.count("*").alias("n"))


_MONTH = "CAST(date_trunc('month', date) AS DATE)"


@query(
    "c31_target_vs_actual",
    f"""{ctes("target", "sales_line", "store")}, a AS (SELECT store_scheme, {_MONTH} AS period, sum(target) AS target FROM target GROUP BY 1, 2),
b AS (SELECT store_scheme, {_MONTH} AS period, sum(net_amount_acy) AS actual FROM sales_line JOIN store ON store_code = code WHERE company_id = 'A' GROUP BY 1, 2)
SELECT coalesce(a.store_scheme, b.store_scheme) AS store_scheme, coalesce(a.period, b.period) AS period, round(target, 2) AS target, round(actual, 2) AS actual, round(coalesce(actual, 0) * 100 / nullif(target, 0), 2) AS achieved
FROM a FULL JOIN b ON a.store_scheme = b.store_scheme AND a.period = b.period""",
)
def _(t):
    sold = t("sales_line").where("company_id = 'A'").join(sales.small(t("store")), F.expr("store_code = code"))
    return kpi.target_vs_actual(t("target"), sold)


@query("c38_forecast_vs_actual", f"{ctes('forecast', 'sales_line', 'store')}, a AS (SELECT store_scheme, date, sum(net_amount_acy) AS actual FROM sales_line JOIN store ON store_code = code GROUP BY 1, 2) SELECT f.store_scheme, f.date, round(try_cast(net AS DOUBLE), 2) AS forecast, round(try_cast(net_lower AS DOUBLE), 2) AS lower_bound, try_cast(net_upper AS DOUBLE) AS upper_bound, round(actual, 2) AS actual FROM forecast f LEFT JOIN a ON a.store_scheme = f.store_scheme AND a.date = f.date")
def _(t):
    return kpi.forecast_vs_actual(t("forecast"), t("sales_line").join(sales.small(t("store")), F.expr("store_code = code")))


# --- tables --------------------------------------------------------------------------------------------------------------


@query("f1_table_query", "SELECT p_partkey, p_name, p_size FROM part WHERE p_name LIKE '%ring%' AND p_size > 10 AND p_brand LIKE 'Brand#1%' ORDER BY p_size DESC, p_partkey LIMIT 20 OFFSET 20")
def _(t):
    return tables.table_query(t("part"), ["p_partkey", "p_name", "p_size"], [("p_name", "contains", "ring"), ("p_size", "greaterthan", "10"), ("p_brand", "startswith", "Brand#1"), ("p_type", "equals", "")], [("p_size", True), ("p_partkey", False)], 2, 20)


@query("f2_filtered_count", "SELECT count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'MACHINERY'")
def _(t):
    return tables.filtered_count(t("customer"), [("c_acctbal", "lessthan", 0), ("c_mktsegment", "is", "MACHINERY")])


@query(
    "f3_metric_filters",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 100000 AND o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus NOT IN ('P')
AND o_orderpriority LIKE '_-%' AND o_orderpriority NOT LIKE 'LOW' AND o_custkey <> 7 AND o_orderkey >= 0 GROUP BY 1""",
)
def _(t):
    given = [("o_totalprice", "BETWEEN", "1000;100000"), ("o_orderpriority", "IN", "1-URGENT; 5-LOW"), ("o_orderpriority", "LIKE", "_-%"), ("o_orderpriority", "NOT LIKE", "LOW"), ("o_custkey", "<>", 7), ("o_orderkey", ">=", 0), ("o_orderkey", "=", ""), ("o_totalprice", "BETWEEN", "5")]
    filters = [{"column": c, "operator": o, "value": v} for c, o, v in given] + [{"column": "o_orderstatus", "operator": "NOT IN", "default": "P"}]
    return tables.metric_filters(t("orders"), filters).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("f3_metric_equality", "SELECT p_partkey, p_brand FROM part WHERE p_size = 5 AND p_partkey <> 1")
def _(t):
    return tables.metric_filters(t("part"), [{"column": "p_size", "operator": "sounds like", "value": 5}, {"column": "p_partkey", "operator": "<>", "value": "1"}]).select("p_partkey", "p_brand")


@query("f4_audit_store_search", f"{ctes('audit')} SELECT event_id, action FROM audit WHERE company_id = 1 AND event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 00:00:00' AND (lower(action) LIKE '%purch%' OR lower(details) LIKE '%purch%' OR CAST(user_id AS VARCHAR) LIKE '%purch%')")
def _(t):
    log = t("audit")
    store, sidecar, spark = _folder(log, "audit"), _folder(log, "audit-index"), log.sparkSession
    files.write_audit(log, store)
    audit_index.update(spark, store, sidecar)
    return audit_index.search(spark, store, sidecar, 1, "Purch", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)).select("event_id", "action")


@query("f4_audit_search", f"{ctes('audit')} SELECT event_id, action FROM audit WHERE company_id = 1 AND success AND event_time >= TIMESTAMP '2024-01-05 00:00:00' AND event_time <= TIMESTAMP '2024-01-20 00:00:00' AND (lower(action) LIKE '%click%' OR lower(details) LIKE '%click%' OR CAST(user_id AS VARCHAR) LIKE '%click%')")
def _(t):
    return tables.audit_search(t("audit"), 1, "CLICK", {"success": True}, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)).select("event_id", "action")


@query("a41_audit_stats", f"{ctes('audit')} SELECT count(*) AS n, count_if(NOT success) AS failures, count(DISTINCT user_id) AS users, round(avg(duration_ms), 2) AS mean_ms FROM audit")
def _(t):
    return tables.audit_stats(t("audit"))


@query("f11_grid_search", "SELECT c_custkey FROM customer WHERE lower(CAST(c_custkey AS VARCHAR)) LIKE '%build%' OR lower(c_name) LIKE '%build%' OR lower(c_mktsegment) LIKE '%build%'")
def _(t):
    return tables.search(t("customer").select("c_custkey", "c_name", "c_mktsegment"), "Build").select("c_custkey")


@query("f9_secured_query", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def _(t):
    c, o = t("customer"), t("orders")
    return security.run_secured(c.sparkSession, "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM secured_customer JOIN secured_orders ON c_custkey = o_custkey GROUP BY 1", {"secured_customer": c, "secured_orders": o}, {"secured_customer": ["c_custkey", "C_MKTSEGMENT"], "secured_orders": ["o_custkey", "o_totalprice"]}, {"c_mktsegment": security.allowed_values('["BUILDING", "MACHINERY"]')}, ["c_acctbal"])


@query("s1_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("s2_value_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return tables.value_counts(t("part"), "p_brand")


@query("s3_date_range_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' GROUP BY 1")
def _(t):
    return t("orders").where(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-06-30").cast("timestamp_ntz"))).join(t("customer"), F.expr("o_custkey = c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("s4_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t("part").select("p_brand", "p_type").distinct()


_PAGE = "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 30 OFFSET 60"


@query("s5_page_by_range", _PAGE)
def _(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return pages.build(c, ["c_acctbal", "c_custkey"], _folder(c, "pages"), 8).page(3, 30)


@query("s5_page", _PAGE)
def _(t):
    return inventory.page(t("customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"], 30, 60)


@query("a40_statistics", "SELECT 'orders' AS table_name, count(*) AS n_rows, 6 AS n_columns, '2 text · 3 num · 1 date' AS types FROM orders UNION ALL SELECT 'part', count(*), 6, '3 text · 3 num' FROM part")
def _(t):
    return tables.statistics({"orders": t("orders"), "part": t("part")})


@query("w6_running_total", "SELECT o_orderdate, round(sum(v) OVER (ORDER BY o_orderdate), 2) AS running FROM (SELECT o_orderdate, sum(o_totalprice) AS v FROM orders GROUP BY 1)")
def _(t):
    return tables.running_total(t("orders"), "o_orderdate", "o_totalprice").select("o_orderdate", F.round("running", 2).alias("running"))


@query("w6_running_total_by_key", "SELECT o_orderstatus, o_orderdate, round(sum(v) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate), 2) AS running FROM (SELECT o_orderstatus, o_orderdate, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)")
def _(t):
    return tables.running_total(t("orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"]).select("o_orderstatus", "o_orderdate", F.round("running", 2).alias("running"))


@query("w7_share_of_total", "SELECT o_orderpriority, round(sum(o_totalprice) * 100 / sum(sum(o_totalprice)) OVER (), 4) AS share FROM orders GROUP BY 1")
def _(t):
    return tables.share_of_total(t("orders"), "o_orderpriority", "o_totalprice")


# --- loading -------------------------------------------------------------------------------------------------------------

_DELTA = "SELECT o_orderkey + CASE WHEN o_orderkey % 20 = 0 THEN 100000000 ELSE 0 END AS o_orderkey, o_custkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate, o_orderpriority FROM {o} WHERE o_orderkey % 10 = 0"


def _delta(t) -> tuple[DataFrame, DataFrame]:
    o = t("orders")
    return o, o.sparkSession.sql(_DELTA, o=o)


_UPSERTED = f"WITH d AS ({_DELTA.format(o='orders')}) SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM d) UNION ALL SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) FROM d"


@query("io13_upsert", _UPSERTED)
def _(t):
    o, d = _delta(t)
    return ingest.upsert(o, d, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("io13_bucket_upsert", _UPSERTED)
def _(t):
    o, d = _delta(t)
    table = _bucketed(o, "o_orderkey")
    table.load(d, "upsert")
    return table.rows().select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


@query("io13_upsert_counts", f"WITH d AS ({_DELTA.format(o='orders')}), u AS (SELECT count(*) AS updated FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM d)) SELECT greatest(0, (SELECT count(*) FROM d) - updated) AS inserted, updated FROM u")
def _(t):
    o, d = _delta(t)
    return ingest.upsert_counts(o, d, ["o_orderkey"])


_CHANGED = """SELECT c_custkey, CASE c_custkey % 10 WHEN 1 THEN 'NEW' WHEN 4 THEN NULL WHEN 5 THEN '' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 10 IN (1, 4) THEN NULL WHEN c_custkey % 10 = 5 THEN 2.5 ELSE c_acctbal END AS c_acctbal
FROM customer WHERE c_custkey % 10 <> 2 UNION ALL SELECT c_custkey + 1000000, c_mktsegment, NULL FROM customer WHERE c_custkey % 10 = 3"""


def _changes(t) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    c = t("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    last = F.expr("CASE c_custkey % 10 WHEN 1 THEN 'NEW' WHEN 5 THEN '' END")
    updates = c.where("c_custkey % 10 IN (1, 4, 5)").select("c_custkey", last.alias("c_mktsegment"), F.expr("CASE c_custkey % 10 WHEN 1 THEN '' WHEN 5 THEN '2.5' END").alias("c_acctbal"), F.lit(1).alias("nothing"), F.lit(2).alias("step"))
    before = updates.withColumns({"c_mktsegment": F.lit("OLD"), "step": F.lit(1)})
    inserts = c.where("c_custkey % 10 = 3").select((F.col("c_custkey") + 1000000).alias("c_custkey"), "c_mktsegment", F.lit("").alias("c_acctbal"))
    return c, before.unionByName(updates), c.where("c_custkey % 10 = 2"), inserts


@query("io17_change_set", _CHANGED)
def _(t):
    c, updates, deletes, inserts = _changes(t)
    return ingest.apply_changes(c, "c_custkey", updates, deletes, inserts, order="step")


@query("io17_bucket_changes", _CHANGED)
def _(t):
    c, updates, deletes, inserts = _changes(t)
    table = _bucketed(c, "c_custkey")
    table.change(updates, deletes, inserts, order="step")
    return table.rows()


@query("io10_incremental", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000")
def _(t):
    return ingest.newer_than(t("orders"), "o_orderkey", "1000").select("o_orderkey")


@query("io11_watermark", "SELECT CAST(max(o_orderkey) AS VARCHAR) AS watermark FROM orders")
def _(t):
    return ingest.watermark(t("orders"), "o_orderkey")


_TEXT = "SELECT CAST(p_partkey AS STRING) AS P_PartKey, CASE WHEN p_partkey % 9 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS `P Size`, p_name AS extra FROM {p}"
_TARGET = "p_partkey bigint, p_size int, p_missing string"


@query("a38_validation", "SELECT 'p_partkey' AS column_name, CAST(0 AS BIGINT) AS n_bad, CAST([] AS VARCHAR[]) AS samples UNION ALL SELECT 'p_size', count(*), ['n/a'] FROM part WHERE p_partkey % 9 = 0")
def _(t):
    return ingest.validate(_staged(t), _schema())


@query("x4_typed_rows", "SELECT p_partkey, p_size FROM part WHERE p_partkey % 9 <> 0")
def _(t):
    return ingest.typed(_staged(t), _schema())


def _staged(t) -> DataFrame:
    p = t("part")
    return p.sparkSession.sql(_TEXT, p=p)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(_TARGET)


# --- scalar functions ----------------------------------------------------------------------------------------------------


@query("x1_labels", "SELECT coalesce(nullif(name, ''), 'Unknown') AS label, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS name FROM supplier) GROUP BY 1")
def _(t):
    return t("vendor").groupBy(exprs.label(F.col("name")).alias("label")).agg(F.count("*").alias("n"))


@query("x7_months", "SELECT o_orderkey, month(o_orderdate) AS month_no FROM orders")
def _(t):
    return t("orders").select("o_orderkey", exprs.month_number(F.date_format("o_orderdate", "MMMM")).alias("month_no"))


@query(
    "x8_kpi_names",
    f"""{ctes("kpi_name")} SELECT p_partkey, CASE WHEN regexp_matches(lower(kpi), '%|ratio|margin|contribution|rate|percent') THEN '%' WHEN regexp_matches(lower(kpi), 'time|days|delivery') THEN 'days' ELSE 'num' END AS unit,
CASE WHEN p_partkey % 16 IN (2, 3, 4, 6, 7, 8, 9, 10, 11, 12) THEN 'down' ELSE 'up' END AS direction FROM kpi_name""",
)
def _(t):
    return t("kpi_name").select("p_partkey", exprs.kpi_unit(F.col("kpi")).alias("unit"), exprs.kpi_direction(F.col("kpi")).alias("direction"))


@query("g3_hours_between", "SELECT event_id, date_diff('hour', ts, ts + INTERVAL 90 MINUTE) AS hrs FROM events")
def _(t):
    return t("events").select("event_id", exprs.hours_between(F.col("ts"), F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("hrs"))


@query("x10_ratios", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_discount * 100 / nullif(l_tax, 0), 2) AS pct FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", exprs.ratio(F.col("l_discount"), F.col("l_tax"), 100, 2).alias("pct"))


@query("x13_export_fields", "SELECT event_id, CASE WHEN hour(ts) + minute(ts) + second(ts) = 0 THEN strftime(ts, '%d/%m/%Y') ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS at FROM events UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') FROM orders")
def _(t):
    from ..sources.files import export_text

    e = t("events").select("event_id", export_text(F.col("ts"), "timestamp_ntz").alias("at"))
    return e.unionByName(t("orders").select(F.col("o_orderkey").alias("event_id"), export_text(F.col("o_orderdate"), "timestamp_ntz").alias("at")))


@query("t3_hourly_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(t):
    from ..streaming.jobs import hourly_sales

    return hourly_sales(t("events"))


# --- searches ------------------------------------------------------------------------------------------------------------

_NEWEST = "last AS (SELECT entity_id, status FROM status_history QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY checked_at DESC, id DESC) = 1)"


@query(
    "f5_entity_search",
    f"""{ctes("asset", "status_history")}, {_NEWEST} SELECT a.entity_id, name, coalesce(status, 'Unknown') AS status FROM asset a LEFT JOIN last USING (entity_id) WHERE NOT is_deleted AND is_active
AND (lower(name) LIKE '%7%' OR lower(coalesce(description, '')) LIKE '%7%' OR lower(owner) LIKE '%7%' OR lower(location) LIKE '%7%')""",
)
def _(t):
    return status.entity_search(t("asset"), t("status_history"), " 7 ", active=True).select("entity_id", "name", "status")


@query("f5_entities_of_a_status", f"{ctes('asset', 'status_history')}, {_NEWEST} SELECT a.entity_id FROM asset a LEFT JOIN last USING (entity_id) WHERE NOT is_deleted AND is_critical AND entity_type = 2 AND coalesce(status, 'Unknown') = 'Online' ORDER BY name DESC, entity_id LIMIT 10 OFFSET 10")
def _(t):
    return status.entity_search(t("asset"), t("status_history"), kind=2, critical=True, state="Online", descending=True, page=2, page_size=10).select("entity_id")


@query(
    "f6_incident_search",
    f"""{ctes("asset_incident", "asset")} SELECT incident_id, name AS entity_name FROM asset_incident LEFT JOIN asset USING (entity_id) WHERE NOT asset_incident.is_deleted AND status <> 'Resolved' AND severity = 'High' AND entity_type = 3
AND (lower(title) LIKE '%error%' OR lower(asset_incident.description) LIKE '%error%' OR lower(name) LIKE '%error%')""",
)
def _(t):
    return status.incident_search(t("asset_incident"), t("asset"), "Error", True, "High", kind=3).select("incident_id", "entity_name")


@query("f8_live_history", f"{ctes('status_history')} SELECT id, entity_id FROM status_history WHERE id % 10 <> 0 AND status = 'Error' AND checked_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def _(t):
    marked = t("status_history").withColumn("is_deleted", F.expr("CASE WHEN id % 10 = 0 THEN true WHEN id % 10 = 1 THEN NULL ELSE false END"))
    return status.history_rows(marked, start=dt.datetime(2024, 1, 5), end=dt.datetime(2024, 1, 25), state="Error").select("id", "entity_id")


@query("j14_metric_values", f"{ctes('metric', 'metric_value')} SELECT metric_id, metric_name, period_date, value FROM metric_value JOIN metric USING (metric_id) WHERE company_id = 1 AND period_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def _(t):
    return kpi.metric_values(t("metric_value"), t("metric"), 1, start=dt.date(1997, 1, 1), end=dt.date(1997, 3, 31)).select("metric_id", "metric_name", "period_date", "value")


@query("f11_column_filters", "SELECT c_custkey FROM customer WHERE (lower(c_name) LIKE '%1%' OR lower(c_mktsegment) LIKE '%1%') AND lower(c_mktsegment) LIKE '%build%' AND CAST(c_nationkey AS VARCHAR) LIKE '%2%'")
def _(t):
    return tables.search(t("customer"), "1", ["c_name", "c_mktsegment"], {"c_mktsegment": "Build", "c_nationkey": "2", "c_name": " "}).select("c_custkey")


# --- more of the feed, tills and orders ------------------------------------------------------------------------------------


@query(
    "a15_chain_sales",
    f"""{ctes("till_line", "till_header", "till_category")} SELECT store_no, division_name, category_name, max(hour) AS hour, round(-sum(net_amount / rate), 4) AS net_amount_acy, count(*) AS lines
FROM till_line JOIN till_header USING (store_no, pos_terminal_no, transaction_no) LEFT JOIN till_category USING (item_category_code) WHERE wastage = 0 AND transaction_type = 2 GROUP BY 1, 2, 3""".replace("net_amount / rate", "CAST(net_amount AS DOUBLE) / rate"),
)
def _(t):
    lines = t("till_line").withColumn("net_amount", F.col("net_amount").cast("double"))
    return feed.chain_sales(lines, t("till_header"), t("till_category"))


@query("a16_online_orders", f"{ctes('order_line')} SELECT scheme, store, hour, round(sum(CASE WHEN currency = 'LBP' THEN amount / 89700.0 ELSE amount END), 2) AS net, count(DISTINCT order_no) AS orders FROM order_line GROUP BY 1, 2, 3")
def _(t):
    return feed.online_orders(t("order_line"), "scheme", "store", "hour")


_FEED_STATE = "cur AS (SELECT * FROM feed WHERE day = DATE '2024-01-30' QUALIFY rank() OVER (PARTITION BY store_code, scheme, division_name, category_name ORDER BY received_at DESC) = 1)"


@query("a20_store_in_focus", f"{ctes('feed')}, {_FEED_STATE}, s AS (SELECT CAST(division_name AS VARCHAR) AS division_name, CAST(category_name AS VARCHAR) AS category_name, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, count(*) AS n FROM cur WHERE store_code = (SELECT min(store_code) FROM cur) GROUP BY 1, 2) SELECT * FROM s WHERE division_name = (SELECT division_name FROM s GROUP BY 1 ORDER BY sum(sales) DESC, 1 LIMIT 1)")
def _(t):
    state = feed.current(t("feed"), DAY)
    first = state.agg(F.min("store_code").alias("store_code"))
    return feed.store_in_focus(state.join(F.broadcast(first), "store_code", "left_semi"), F.col("store_code"))


@query("a21_last_hour_rows", f"{ctes('feed')}, {_FEED_STATE} SELECT store_code, scheme, hour, round(sum(net_amount_acy), 2) AS sales, CAST(sum(total_transactions) AS BIGINT) AS tx, round(sum(net_amount_acy) / sum(total_transactions), 4) AS avg_basket FROM (SELECT *, max(hour) OVER (PARTITION BY store_code, scheme) AS last FROM cur) WHERE hour = last GROUP BY 1, 2, 3")
def _(t):
    return feed.last_hour_rows(t("feed"), DAY)


@query("f7_feed_rows", f"{ctes('feed')} SELECT event_id FROM feed WHERE scheme = 'click' AND hour BETWEEN 8 AND 12 AND store_code % 4 = 1 AND event_id % 3 <> 0")
def _(t):
    rows = t("feed").withColumns({"company_id": F.expr("store_code % 4"), "is_processed": F.expr("CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END")})
    return feed.select(rows, scheme="click", hours=(8, 12), company=1, unprocessed=True).select("event_id")


@query(
    "a37_failed_sources",
    f"""{ctes("ingestion_source", "ingestion_run")}, n AS (SELECT source_id, max(started_at) AS t FROM ingestion_run WHERE status = 'Running' AND started_at < TIMESTAMP '2024-01-25' GROUP BY 1)
SELECT source_id, CASE WHEN t IS NOT NULL AND (last_run_at IS NULL OR last_run_at <= t) THEN TIMESTAMP '2024-02-01' ELSE last_run_at END AS last_run_at, CASE WHEN t IS NOT NULL AND (last_run_at IS NULL OR last_run_at <= t) THEN 'Failed' ELSE last_status END AS last_status FROM ingestion_source LEFT JOIN n USING (source_id)""",
)
def _(t):
    return status.fail_sources(t("ingestion_source"), t("ingestion_run"), dt.datetime(2024, 1, 25), dt.datetime(2024, 2, 1))


@query(
    "j11_dependency_tree",
    f"""{ctes("critical_dependency", "entity", "status_history").replace("WITH ", "WITH RECURSIVE ", 1)}, {_NEWEST},
up(root, node, level) AS (SELECT entity_id, entity_id, 0 FROM entity WHERE entity_id <= 50 UNION SELECT root, depends_on, level + 1 FROM up JOIN critical_dependency d ON d.entity_id = node WHERE level < 6),
down(root, node, level) AS (SELECT entity_id, entity_id, 0 FROM entity WHERE entity_id <= 50 UNION SELECT root, d.entity_id, level + 1 FROM down JOIN critical_dependency d ON d.depends_on = node WHERE level < 6),
u AS (SELECT root, node, min(level) AS level FROM up GROUP BY 1, 2), w AS (SELECT root, node, min(level) AS level FROM down GROUP BY 1, 2),
x AS (SELECT a.root, 'dependency' AS direction, a.node AS entity_id, a.level - 1 AS level, bool_or(d.is_critical) AS is_critical FROM u a JOIN critical_dependency d ON d.depends_on = a.node JOIN u b ON b.root = a.root AND b.node = d.entity_id AND b.level = a.level - 1 GROUP BY 1, 2, 3, 4
UNION ALL SELECT a.root, 'dependent', a.node, a.level - 1, bool_or(d.is_critical) FROM w a JOIN critical_dependency d ON d.entity_id = a.node JOIN w b ON b.root = a.root AND b.node = d.depends_on AND b.level = a.level - 1 GROUP BY 1, 2, 3, 4)
SELECT root, direction, x.entity_id, CAST(level AS INTEGER) AS level, entity_type, coalesce(status, 'Unknown') AS status, x.is_critical FROM x JOIN entity USING (entity_id) LEFT JOIN last USING (entity_id)""",
)
def _(t):
    return graph.tree(t("critical_dependency"), t("entity"), status.latest(t("status_history")), t("entity").where("entity_id <= 50").select("entity_id"))


@query("io19_inventory_export", f"{ctes('item_location', 'item_details')} SELECT item_no, location_code, description, category_code FROM item_location LEFT JOIN item_details USING (item_no) ORDER BY item_no, location_code LIMIT 1000000")
def _(t):
    return inventory.export_rows(t("item_location"), t("item_details"), ["description", "category_code"])


@query("a40_dataset_totals", "SELECT CAST(2 AS BIGINT) AS n_tables, (SELECT count(*) FROM orders) + (SELECT count(*) FROM part) AS n_rows, CAST(12 AS BIGINT) AS n_columns, 'ready' AS state")
def _(t):
    return tables.dataset_totals(tables.statistics({"orders": t("orders"), "part": t("part")}))
