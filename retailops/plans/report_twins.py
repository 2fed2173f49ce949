"""The DuckDB twins of the reports, each written by hand over the tables and not derived from the reports' own expressions."""

from __future__ import annotations

_SALES = """(SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, l_partkey, l_linestatus, l_orderkey, l_quantity, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net,
CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS off FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= DATE '2000-06-01' AND l_shipdate < DATE '2000-07-01') s"""
_PROFIT = """(SELECT CAST(l_shipdate AS DATE) AS day, l_partkey, l_suppkey, l_extendedprice AS sales, CAST(l_extendedprice * (0.4 - l_discount) * 0.7 AS DECIMAL(18,6)) AS front, CAST(l_extendedprice * (0.4 - l_discount) * 0.3 AS DECIMAL(18,6)) AS back,
CAST(l_extendedprice * (0.4 - l_discount) AS DECIMAL(18,6)) AS gross, CAST(l_extendedprice * (0.4 - l_discount - l_tax) AS DECIMAL(18,6)) AS net FROM lineitem WHERE l_shipdate >= DATE '2000-04-01' AND l_shipdate < DATE '2000-07-01') x"""
_OOS = """(SELECT p_brand AS category, s_suppkey AS store, s_suppkey % 5 AS region, l_partkey AS item_no, last_day(CAST(l_shipdate AS DATE)) AS day, max(l_linenumber) AS days_out,
round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS lost, min(100 - 5 * l_linenumber) AS fill, min(l_returnflag) = 'A' AS gone FROM lineitem, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey GROUP BY ALL) o"""
_LAST = "day = (SELECT max(last_day(CAST(l_shipdate AS DATE))) FROM lineitem)"
_QUARTER = "l_shipdate >= DATE '2000-04-01' AND l_shipdate < DATE '2000-07-01'"
_MOVES = f"(SELECT l_suppkey % 20 AS a, c_nationkey AS b, l_quantity AS shipped, if(l_linestatus = 'F', l_quantity, 0) AS received FROM lineitem, orders, customer WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND {_QUARTER}) t"
_WORK = "(SELECT user_id, event_type, CAST(ts AS DATE) AS day, value, CAST(if(event_type IN ('click', 'purchase'), value, value / 2) AS DECIMAL(18,4)) AS picked FROM events) w"
_PAID = "value * if(user_id % 3 = 0, 1, 2)"
_CARDS = "customer LEFT JOIN (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS since FROM orders GROUP BY 1) f ON o_custkey = c_custkey"

SQL: dict[str, str] = {
    "c1_daily_revenue": f"SELECT day AS date, CAST(round(sum(net), 2) AS DOUBLE) AS revenue, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS units, count(DISTINCT (l_suppkey, l_linestatus, l_orderkey)) AS baskets, round(CAST(round(sum(net), 2) AS DOUBLE) / count(DISTINCT (l_suppkey, l_linestatus, l_orderkey)), 2) AS avg_basket FROM {_SALES} GROUP BY 1",
    "c2_stores": f"SELECT s_name AS store_name, CAST(round(sum(net), 2) AS DOUBLE) AS revenue, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS units, CAST(round(sum(off), 2) AS DOUBLE) AS discount FROM {_SALES} LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "c3_categories": f"SELECT coalesce(p_brand, 'Unknown') AS category, CAST(round(sum(net), 2) AS DOUBLE) AS revenue, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS units FROM {_SALES} LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "c4_hours": "SELECT hour(ts) AS hr, round(sum(value), 2) AS revenue, count(*) AS n FROM events GROUP BY 1",
    "c5_payments": "SELECT o_orderpriority AS method, count(*) AS orders, round(sum(o_totalprice), 2) AS charges FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "c6_top_items": f"SELECT l_partkey AS item_no, any_value(p_name) AS description, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS units, CAST(round(sum(net), 2) AS DOUBLE) AS revenue FROM {_SALES} LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 20",
    "c7_profit_layers": f"SELECT day AS posting_date, round(sum(sales), 2) AS amount, CAST(round(sum(front), 2) AS DOUBLE) AS front, CAST(round(sum(back), 2) AS DOUBLE) AS back, CAST(round(sum(gross), 2) AS DOUBLE) AS gross, CAST(round(sum(net), 2) AS DOUBLE) AS net, round(CAST(round(sum(net), 2) AS DOUBLE) * 100 / round(sum(sales), 2), 2) AS net_margin FROM {_PROFIT} GROUP BY 1",
    "c8_gross_margin": f"SELECT coalesce(p_brand, 'Unknown') AS category, round(sum(sales), 2) AS amount, CAST(round(sum(gross), 2) AS DOUBLE) AS gross, round(CAST(round(sum(gross), 2) AS DOUBLE) * 100 / round(sum(sales), 2), 2) AS margin FROM {_PROFIT} LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "c9_locations": f"SELECT l_suppkey AS location_code, round(sum(sales), 2) AS amount, CAST(round(sum(net), 2) AS DOUBLE) AS net, round(CAST(round(sum(net), 2) AS DOUBLE) * 100 / round(sum(sales), 2), 2) AS net_margin FROM {_PROFIT} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20",
    "c10_least_profitable": f"SELECT l_partkey AS item_no, round(sum(sales), 2) AS amount, CAST(round(sum(net), 2) AS DOUBLE) AS net FROM {_PROFIT} GROUP BY 1 HAVING sum(sales) > 0 ORDER BY 3, 1 LIMIT 20",
    "c11_fill_rate": f"SELECT day AS as_of_date, round(avg(fill), 3) AS fill, CAST(round(sum(lost), 2) AS DOUBLE) AS lost, count(*) FILTER (gone) AS out_lines FROM {_OOS} WHERE day >= DATE '2000-01-01' GROUP BY 1",
    "c12_oos_region": f"SELECT region, store, round(avg(fill), 3) AS fill, count(*) FILTER (gone) AS out_items, CAST(round(sum(lost), 2) AS DOUBLE) AS lost FROM {_OOS} WHERE {_LAST} GROUP BY 1, 2 ORDER BY 5 DESC, 1, 2 LIMIT 30",
    "c13_oos_items": f"SELECT item_no, category, store AS supplier, CAST(round(sum(lost), 2) AS DOUBLE) AS lost, CAST(max(days_out) AS BIGINT) AS longest FROM {_OOS} WHERE {_LAST} AND gone GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 25",
    "c14_days_out": f"SELECT if(days_out = 0, '0', if(days_out <= 2, '1-2', if(days_out <= 7, '3-7', if(days_out <= 14, '8-14', '15+')))) AS bucket, count(*) AS n FROM {_OOS} WHERE {_LAST} GROUP BY 1",
    "c15_movements": f"SELECT if(l_returnflag = 'N', 'SALES', 'PURCHASE') AS entry_type, round(sum(if(l_returnflag = 'N', -1, 1) * l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS cost, count(*) AS n FROM lineitem WHERE {_QUARTER} GROUP BY 1",
    "c16_daily_cost": "SELECT CAST(l_shipdate AS DATE) AS posting_date, coalesce(p_brand, 'Unknown') AS category, round(sum(l_extendedprice), 2) AS cost FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= DATE '2000-06-24' AND l_shipdate < DATE '2000-07-01' GROUP BY 1, 2",
    "c17_vendors": f"SELECT coalesce(if(s_suppkey % 10 = 0, '', s_name), CAST(l_suppkey AS VARCHAR)) AS vendor, round(sum(l_extendedprice), 2) AS amount, round(sum(if(l_linestatus = 'F', l_quantity, 0)), 2) AS received FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE {_QUARTER} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "c18_fulfilment": f"SELECT coalesce(if(s_suppkey % 10 = 0, '', s_name), CAST(l_suppkey AS VARCHAR)) AS vendor, round(sum(l_quantity), 2) AS ordered, round(sum(if(l_linestatus = 'F', l_quantity, 0)), 2) AS received, round(round(sum(if(l_linestatus = 'F', l_quantity, 0)), 2) * 100 / round(sum(l_quantity), 2), 1) AS pct FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE {_QUARTER} GROUP BY 1 HAVING sum(l_quantity) > 0 ORDER BY 4, 1 LIMIT 25",
    "c19_receiving": f"SELECT CAST(l_shipdate AS DATE) AS posting_date, round(sum(l_extendedprice), 2) AS amount, count(DISTINCT l_orderkey) AS documents FROM lineitem WHERE {_QUARTER} GROUP BY 1",
    "c20_routes": f"SELECT a AS transfer_from, b AS transfer_to, round(sum(shipped), 2) AS shipped, round(sum(received), 2) AS received FROM {_MOVES} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30",
    "c21_in_transit": f"SELECT b AS transfer_to, round(sum(shipped) - sum(received), 2) AS gap FROM {_MOVES} GROUP BY 1 HAVING sum(shipped) > sum(received)",
    "c22_pickers": f"SELECT user_id, count(*) AS n_lines, CAST(round(sum(picked), 2) AS DOUBLE) AS units, round(avg(value * 3), 6) AS mean_time, count(*) FILTER (event_type = 'error') AS skipped FROM {_WORK} GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25",
    "c23_pick_rate": f"SELECT day AS created_on, round(sum(value), 2) AS allocated, CAST(round(sum(picked), 2) AS DOUBLE) AS picked, round(CAST(round(sum(picked), 2) AS DOUBLE) * 100 / round(sum(value), 2), 1) AS rate FROM {_WORK} GROUP BY 1",
    "c24_work_status": "SELECT event_type AS line_status, count(*) AS n FROM events GROUP BY 1",
    "c25_incidents": f"SELECT event_type AS category, if(user_id % 2 = 0, 'Open', 'Closed') AS status, count(*) AS n, round(sum({_PAID}), 2) AS compensation FROM events GROUP BY 1, 2",
    "c26_compensation": f"SELECT CAST(ts AS DATE) AS created_day, count(*) AS n, round(sum({_PAID}), 2) AS compensation, count(*) FILTER (user_id % 10 = 0) AS vips FROM events GROUP BY 1",
    "c27_resolution": "SELECT event_type AS category, count(*) AS resolved, round(avg(date_diff('hour', ts, ts + INTERVAL 90 MINUTE)), 1) AS hrs FROM events GROUP BY 1",
    "c28_new_customers": f"SELECT CAST(date_trunc('month', since) AS DATE) AS created_month, count(*) AS n FROM {_CARDS} WHERE since >= DATE '1995-01-01' GROUP BY 1",
    "c29_classification": "SELECT c_mktsegment AS customer_classification, CAST(c_nationkey AS VARCHAR) AS customer_type, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS blocked FROM customer GROUP BY 1, 2",
    "c30_loyalty": "SELECT count(*) FILTER (c_custkey % 3 <> 0) AS members, count(*) FILTER (c_custkey % 3 = 0) AS others, count(*) AS total FROM customer",
    "c32_elasticity": "SELECT p_brand AS elasticity_class, count(*) AS n, round(avg(p_size) FILTER (p_partkey % 7 <> 0), 3) AS mean FROM part GROUP BY 1",
    "c33_pack_mix": "SELECT p_type AS ppa_class, count(*) AS n, round(sum(p_retailprice), 2) AS revenue FROM part GROUP BY 1",
    "c34_associations": "SELECT p_brand AS antecedents, p_type AS consequents, round(avg(p_size) / 20, 3) AS lift, CAST(count(*) AS DOUBLE) AS support FROM part GROUP BY 1, 2 HAVING max(p_size) <> 50 AND avg(p_size) / 20 > 1 ORDER BY 3 DESC, 1, 2 LIMIT 30",
    "c35_pairs": "SELECT if(p_partkey % 7 = 0, 'Unknown', if(p_size > 25, 'substitute', 'complement')) AS relationship, count(*) AS n FROM part GROUP BY 1",
    "c36_promotions": "SELECT CAST(o_orderdate AS DATE) AS from_date, count(*) AS n, count(DISTINCT o_custkey) AS items FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1",
    "c37_rates": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS currency_code, round(avg(o_totalprice), 6) AS black, round(avg(o_totalprice * 0.9), 6) AS official FROM orders WHERE o_orderdate >= DATE '2000-06-01' AND o_orderdate < DATE '2000-07-01' GROUP BY 1, 2",
}
