"""The retail roles that the registered queries read, as views over the star-schema tables.

Operators take DataFrames and know nothing of this module: a warehouse brings its own tables. Each role is one SELECT, used by
Spark over the Parquet tables and by the DuckDB twins as a common table expression.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

ROLES: dict[str, str] = {
    "sales_line": """SELECT l_returnflag AS company_id, l_suppkey AS store_code, l_linestatus AS pos_number, l_orderkey AS transaction_no,
        l_orderkey AS receipt_no, l_partkey AS item_no, CAST(l_shipdate AS DATE) AS date, l_quantity AS quantity,
        CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS net_amount_acy, CAST(l_extendedprice * l_discount AS DECIMAL(18,4)) AS total_discount_acy FROM {lineitem}""",
    "store": """SELECT s_suppkey AS code, s_name AS store, n_name AS store_scheme, r_name AS region
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "item_details": "SELECT p_partkey AS item_no, p_name AS description, p_brand AS category_code, p_type AS division_code FROM {part}",
    "item_dim": "SELECT p_partkey AS dim_item_no, p_name AS description, p_brand AS category_code, p_type AS division_code FROM {part}",
    "vendor_dim": "SELECT s_suppkey AS dim_vendor_no, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS name FROM {supplier}",
    "product_hierarchy": "SELECT DISTINCT p_type AS division_code, p_type AS division, p_brand AS category_code, p_brand AS category FROM {part}",
    "sales_header": "SELECT o_orderstatus AS company_id, o_orderpriority AS payment_method, CAST(o_orderdate AS DATE) AS date, o_totalprice AS delivery_charge FROM {orders}",
    "ledger": """SELECT l_partkey AS item_no, l_suppkey AS location_code, CASE WHEN l_returnflag = 'N' THEN 'SALES' ELSE 'PURCHASE' END AS entry_type,
        CASE WHEN l_returnflag = 'N' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice AS cost_amount_ac, CAST(l_shipdate AS DATE) AS posting_date FROM {lineitem}""",
    "item_location": "SELECT DISTINCT l_partkey AS item_no, l_suppkey AS location_code FROM {lineitem}",
    "profitability": """SELECT CAST(l_shipdate AS DATE) AS posting_date, l_partkey AS item_no, l_suppkey AS location_code, l_extendedprice AS amount_ac,
        CAST(l_extendedprice * (0.4 - l_discount) AS DECIMAL(18,6)) AS gross_profit, CAST(l_extendedprice * (0.4 - l_discount) * 0.7 AS DECIMAL(18,6)) AS front_profit,
        CAST(l_extendedprice * (0.4 - l_discount) * 0.3 AS DECIMAL(18,6)) AS back_profit, CAST(l_extendedprice * (0.4 - l_discount - l_tax) AS DECIMAL(18,6)) AS net_profit FROM {lineitem}""",
    "receipt_line": """SELECT CAST(l_shipdate AS DATE) AS posting_date, l_orderkey AS document_no, l_suppkey AS vendor_no, l_extendedprice AS amount_lc,
        l_quantity AS quantity_ordered, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS quantity_received FROM {lineitem}""",
    "vendor": "SELECT s_suppkey AS vendor_no, CASE WHEN s_suppkey % 10 = 0 THEN '' ELSE s_name END AS name FROM {supplier}",
    "transfer": """SELECT CAST(l_shipdate AS DATE) AS posting_date, l_suppkey % 20 AS transfer_from, c_nationkey AS transfer_to, l_quantity AS quantity_shipped,
        CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS quantity_received FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey""",
    "work": """SELECT CAST(ts AS DATE) AS created_on, user_id, value AS quantity_allocated, CAST(CASE WHEN event_type IN ('click', 'purchase') THEN value ELSE value / 2 END AS DECIMAL(18,4)) AS quantity_picked,
        value * 3 AS actual_time, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_skipped, event_type AS line_status FROM {events}""",
    "incident": """SELECT ts AS created_on, ts + INTERVAL 90 MINUTE AS resolved_on, event_type AS category, CASE WHEN user_id % 2 = 0 THEN 'Open' ELSE 'Closed' END AS status, value AS compensate_amount,
        CASE WHEN user_id % 3 = 0 THEN NULL ELSE 2.0 END AS exchange_rate, CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END AS is_vip_customer FROM {events}""",
    "customer_card": """SELECT c_custkey, c_mktsegment AS customer_classification, c_nationkey AS customer_type, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS is_blocked,
        CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'GOLD' END AS club_code, first_order AS customer_creation_date
        FROM {customer} LEFT JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_order FROM {orders} GROUP BY o_custkey) o ON o_custkey = c_custkey""",
    "elasticity": "SELECT p_brand AS elasticity_class, CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(p_size AS STRING) END AS elasticity, p_type AS ppa_class, CAST(p_retailprice AS STRING) AS total_revenue FROM {part}",
    "association": """SELECT CAST(x.p_brand AS STRING) AS antecedents, CAST(x.p_type AS STRING) AS consequents, CAST(count(*) AS STRING) AS support,
        CASE WHEN max(x.p_size) = 50 THEN 'bad' ELSE CAST(avg(x.p_size) / 20 AS STRING) END AS lift FROM {part} x GROUP BY x.p_brand, x.p_type""",
    "promotion": "SELECT CAST(o_orderdate AS DATE) AS from_date, o_custkey AS item_no FROM {orders}",
    "rates": "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS currency_code, o_totalprice AS black_market_rate, o_totalprice * 0.9 AS official_rate FROM {orders}",
    "forecast": "SELECT n_name AS store_scheme, CAST(o_orderdate AS DATE) AS date, CAST(sum(o_totalprice) AS STRING) AS net, CAST(sum(o_totalprice) * 0.8 AS STRING) AS net_lower, 'n/a' AS net_upper FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name, CAST(o_orderdate AS DATE)",
    "target": "SELECT n_name AS store_scheme, CAST(o_orderdate AS DATE) AS date, o_totalprice AS target FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    "feed": """SELECT event_id, event_type AS scheme, user_id AS store_code, user_id % 5 AS division_name, user_id % 7 AS category_name, hour(ts) AS hour, value AS net_amount_acy,
        CAST(1 + user_id % 3 AS BIGINT) AS total_transactions, ts AS received_at, CAST(ts AS DATE) AS day FROM {events}""",
    "status_history": """SELECT event_id AS id, user_id AS entity_id, ts AS checked_at, value AS response_time,
        CASE event_type WHEN 'signup' THEN 'Degraded' WHEN 'error' THEN 'Error' ELSE 'Online' END AS status FROM {events}""",
    "entity": "SELECT DISTINCT user_id AS entity_id, user_id % 7 + 1 AS entity_type, user_id % 3 = 0 AS is_critical FROM {events}",
    "dependency": """SELECT user_id AS entity_id, user_id // 2 AS depends_on FROM (SELECT DISTINCT user_id FROM {events}) a WHERE user_id > 0
        UNION SELECT user_id, user_id // 3 FROM (SELECT DISTINCT user_id FROM {events}) b WHERE user_id > 0""",
    "kpi": """SELECT o_orderstatus AS department, o_orderpriority AS kpi, year(o_orderdate) AS year, month(o_orderdate) AS month_no, round(sum(o_totalprice), 2) AS value, round(sum(o_totalprice) * 1.05, 2) AS target
        FROM {orders} GROUP BY o_orderstatus, o_orderpriority, year(o_orderdate), month(o_orderdate)""",
    "oos": """SELECT p_brand AS category, s_suppkey % 5 AS region, s_suppkey AS store, s_suppkey AS supplier, s_suppkey % 3 AS warehouse, s_suppkey % 4 AS store_group, l_partkey AS item_no,
        last_day(CAST(l_shipdate AS DATE)) AS as_of_date, CAST(max(l_linenumber) AS BIGINT) AS days_out, CAST(round(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))), 2) AS DOUBLE) AS lost, min(100 - 5 * l_linenumber) AS fill_rate,
        CASE min(l_returnflag) WHEN 'A' THEN 'out' WHEN 'R' THEN 'low' ELSE 'restocking' END AS state
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY p_brand, s_suppkey, l_partkey, last_day(CAST(l_shipdate AS DATE))""",
    "asset": """SELECT user_id AS entity_id, concat('Asset ', user_id) AS name, CASE WHEN user_id % 4 = 0 THEN NULL ELSE concat('Runs ', user_id % 9) END AS description, concat('Team ', user_id % 5) AS owner,
        CASE WHEN user_id % 6 = 0 THEN 'Plant 7' ELSE 'Office' END AS location, user_id % 7 + 1 AS entity_type, user_id % 8 <> 0 AS is_active, user_id % 3 = 0 AS is_critical, user_id % 11 = 0 AS is_deleted FROM (SELECT DISTINCT user_id FROM {events})""",
    "asset_incident": """SELECT event_id AS incident_id, user_id AS entity_id, concat('Check of ', event_type) AS title, CASE WHEN value > 50 THEN 'Slow answer' ELSE 'No answer' END AS description, ts AS started_at,
        CASE WHEN user_id % 2 = 0 THEN 'Open' WHEN user_id % 5 = 0 THEN 'Investigating' ELSE 'Resolved' END AS status, CASE WHEN value > 80 THEN 'High' ELSE 'Medium' END AS severity, event_id % 13 = 0 AS is_deleted FROM {events}""",
    "metric": "SELECT c_nationkey AS metric_id, concat('Metric ', c_nationkey) AS metric_name, c_nationkey % 3 AS company_id FROM {customer} GROUP BY c_nationkey",
    "metric_value": "SELECT c_nationkey AS metric_id, CAST(o_orderdate AS DATE) AS period_date, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS value FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(o_orderdate AS DATE)",
    "till_line": """SELECT l_suppkey AS store_no, l_linestatus AS pos_terminal_no, l_orderkey AS transaction_no, l_partkey % 12 AS item_category_code, l_linenumber + 8 AS hour,
        CAST(-l_extendedprice AS DECIMAL(18,4)) AS net_amount FROM {lineitem}""",
    "till_header": """SELECT DISTINCT l_suppkey AS store_no, l_linestatus AS pos_terminal_no, o_orderkey AS transaction_no, o_orderkey % 9 = 0 AS is_waste, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END AS wastage,
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END AS transaction_type, 1000 + o_custkey % 7 AS rate FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey""",
    "till_category": "SELECT p_partkey % 12 AS item_category_code, concat('Category ', p_partkey % 12) AS category_name, concat('Division ', p_partkey % 12 % 3) AS division_name FROM {part} WHERE p_partkey % 12 <> 5 GROUP BY p_partkey % 12",
    "order_line": """SELECT n_name AS scheme, l_suppkey AS store, hour(l_shipdate) AS hour, CASE WHEN l_returnflag = 'N' THEN 'LBP' ELSE 'USD' END AS currency, l_extendedprice AS amount, l_orderkey AS order_no
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "ingestion_run": "SELECT event_id AS run_id, user_id AS source_id, ts AS started_at, CASE WHEN event_type = 'click' THEN 'Running' ELSE 'Success' END AS status FROM {events}",
    "ingestion_source": "SELECT user_id AS source_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE max(ts) END AS last_run_at, 'Success' AS last_status FROM {events} WHERE event_type <> 'click' OR user_id % 2 = 0 GROUP BY user_id",
    "critical_dependency": """SELECT user_id AS entity_id, user_id // 2 AS depends_on, user_id % 4 = 0 AS is_critical FROM (SELECT DISTINCT user_id FROM {events}) a WHERE user_id > 0 AND user_id <= 200
        UNION SELECT user_id, user_id // 3, user_id % 6 = 0 FROM (SELECT DISTINCT user_id FROM {events}) b WHERE user_id > 0 AND user_id <= 200""",
    "kpi_name": """SELECT p_partkey, concat(CASE p_partkey % 16 WHEN 0 THEN 'Gross Margin ' WHEN 1 THEN 'Growth % ' WHEN 2 THEN 'Lead Time ' WHEN 3 THEN 'Days of Stock ' WHEN 4 THEN 'Unit Cost ' WHEN 5 THEN 'Delivery Delay ' WHEN 6 THEN 'Return Ratio '
        WHEN 7 THEN 'Wastage ' WHEN 8 THEN 'Shrinkage ' WHEN 9 THEN 'Staff Turnover ' WHEN 10 THEN 'Downtime ' WHEN 11 THEN 'Complaint Count ' WHEN 12 THEN 'Stock IN TRANSIT ' WHEN 13 THEN 'Contribution ' WHEN 14 THEN 'Fill Percent ' ELSE 'Sales ' END, p_partkey) AS kpi FROM {part}""",
    "audit": """SELECT event_id, ts AS event_time, user_id, event_type AS action, event_type <> 'error' AS success, value AS duration_ms, props AS details, user_id % 4 AS company_id FROM {events}""",
}
_DIALECT = ((r"//", " div "),)


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The role as a DataFrame over the Parquet tables of sf_dir."""
    sql = ROLES[name]
    for a, b in _DIALECT:
        sql = sql.replace(a, b)
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))})


def ctes(*names: str) -> str:
    """WITH list for the DuckDB twin."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', ROLES[n])})" for n in names)
