"""The report cookbook: filter, join, group, having, order, limit, declared once and run by one builder.

Expressions are Spark SQL. Ratios divide by nullif(x, 0). Every top-k ends with a key, so ties are settled. The twins are written
apart (`report_twins`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.roles import role


@dataclass(frozen=True)
class Report:
    role: str
    keys: dict[str, str]
    measures: dict[str, str]
    where: str = "true"
    joins: tuple[tuple[str, str, str], ...] = ()  # (role, condition on both, kind)
    having: str | None = None
    order: tuple[tuple[str, bool], ...] = ()  # (column, descending)
    top: int | None = None
    newest: str | None = None  # only rows of the greatest value of this column
    extra: dict[str, str] = field(default_factory=dict)  # columns over keys and measures


def report(rows: DataFrame, spec: Report) -> DataFrame:
    """The report over rows that are joined already."""
    if spec.newest:
        rows = rows.join(F.broadcast(rows.agg(F.max(spec.newest).alias(spec.newest))), spec.newest, "left_semi")
    out = rows.where(spec.where).groupBy(*(F.expr(e).alias(k) for k, e in spec.keys.items())).agg(*(F.expr(e).alias(k) for k, e in spec.measures.items()))
    if spec.extra:
        out = out.withColumns({k: F.expr(e) for k, e in spec.extra.items()})
    if spec.having:
        out = out.where(spec.having)
    if spec.order:
        out = out.orderBy(*(F.desc(c) if d else F.asc(c) for c, d in spec.order))
    return out.limit(spec.top) if spec.top else out


def run(spark: SparkSession, sf_dir: str, spec: Report) -> DataFrame:
    rows = role(spark, sf_dir, spec.role)
    for name, condition, kind in spec.joins:
        rows = rows.join(role(spark, sf_dir, name), F.expr(condition), kind)
    return report(rows, spec)


def money(x: str) -> str:
    return f"CAST(round(sum({x}), 2) AS DOUBLE)"


_SALES = "company_id = 'A' AND date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'"
_QUARTER = "posting_date BETWEEN DATE '2000-04-01' AND DATE '2000-06-30'"
_STORE = (("store", "store_code = code", "left"),)
_BASKETS = "count(DISTINCT struct(store_code, pos_number, transaction_no, receipt_no))"
_ITEM = (("item_dim", "item_no = dim_item_no", "left"),)
_VENDOR = (("vendor_dim", "vendor_no = dim_vendor_no", "left"),)


def _named(column: str) -> str:
    return f"coalesce({column}, 'Unknown')"


REPORTS: dict[str, Report] = {
    "c1_daily_revenue": Report("sales_line", {"date": "date"}, {"revenue": money("net_amount_acy"), "units": money("quantity"), "baskets": _BASKETS}, _SALES, order=(("date", False),), extra={"avg_basket": "round(revenue / nullif(baskets, 0), 2)"}),
    "c2_stores": Report("sales_line", {"store_name": "store"}, {"revenue": money("net_amount_acy"), "units": money("quantity"), "discount": money("total_discount_acy")}, _SALES, _STORE, order=(("revenue", True), ("store_name", False)), top=20),
    "c3_categories": Report("sales_line", {"category": _named("category_code")}, {"revenue": money("net_amount_acy"), "units": money("quantity")}, _SALES, _ITEM, order=(("revenue", True), ("category", False))),
    "c4_hours": Report("feed", {"hr": "hour"}, {"revenue": money("net_amount_acy"), "n": "count(*)"}, order=(("hr", False),)),
    "c5_payments": Report("sales_header", {"method": _named("payment_method")}, {"orders": "count(*)", "charges": money("delivery_charge")}, "company_id = 'F'", order=(("orders", True), ("method", False))),
    "c6_top_items": Report("sales_line", {"item_no": "item_no"}, {"description": "max(description)", "units": money("quantity"), "revenue": money("net_amount_acy")}, _SALES, _ITEM, order=(("revenue", True), ("item_no", False)), top=20),
    "c7_profit_layers": Report("profitability", {"posting_date": "posting_date"}, {"amount": money("amount_ac"), "front": money("front_profit"), "back": money("back_profit"), "gross": money("gross_profit"), "net": money("net_profit")}, _QUARTER, extra={"net_margin": "round(net * 100 / nullif(amount, 0), 2)"}, order=(("posting_date", False),)),
    "c8_gross_margin": Report("profitability", {"category": _named("category_code")}, {"amount": money("amount_ac"), "gross": money("gross_profit")}, _QUARTER, _ITEM, extra={"margin": "round(gross * 100 / nullif(amount, 0), 2)"}, order=(("gross", True), ("category", False))),
    "c9_locations": Report("profitability", {"location_code": "location_code"}, {"amount": money("amount_ac"), "net": money("net_profit")}, _QUARTER, extra={"net_margin": "round(net * 100 / nullif(amount, 0), 2)"}, order=(("net", True), ("location_code", False)), top=20),
    "c10_least_profitable": Report("profitability", {"item_no": "item_no"}, {"amount": money("amount_ac"), "net": money("net_profit")}, _QUARTER, having="amount > 0", order=(("net", False), ("item_no", False)), top=20),
    "c11_fill_rate": Report("oos", {"as_of_date": "as_of_date"}, {"fill": "round(avg(fill_rate), 3)", "lost": money("lost"), "out_lines": "count_if(state = 'out')"}, "as_of_date >= DATE '2000-01-01'", order=(("as_of_date", False),)),
    "c12_oos_region": Report("oos", {"region": "region", "store": "store"}, {"fill": "round(avg(fill_rate), 3)", "out_items": "count_if(state = 'out')", "lost": money("lost")}, newest="as_of_date", order=(("lost", True), ("region", False), ("store", False)), top=30),
    "c13_oos_items": Report("oos", {"item_no": "item_no", "category": "category", "supplier": "supplier"}, {"lost": money("lost"), "longest": "max(days_out)"}, "state = 'out'", newest="as_of_date", order=(("lost", True), ("item_no", False), ("category", False), ("supplier", False)), top=25),
    "c14_days_out": Report("oos", {"bucket": "CASE WHEN days_out = 0 THEN '0' WHEN days_out <= 2 THEN '1-2' WHEN days_out <= 7 THEN '3-7' WHEN days_out <= 14 THEN '8-14' ELSE '15+' END"}, {"n": "count(*)"}, newest="as_of_date", order=(("n", True), ("bucket", False))),
    "c15_movements": Report("ledger", {"entry_type": _named("entry_type")}, {"qty": money("quantity"), "cost": money("cost_amount_ac"), "n": "count(*)"}, _QUARTER, order=(("n", True), ("entry_type", False))),
    "c16_daily_cost": Report("ledger", {"posting_date": "posting_date", "category": _named("category_code")}, {"cost": money("cost_amount_ac")}, "posting_date BETWEEN DATE '2000-06-24' AND DATE '2000-06-30'", _ITEM, order=(("posting_date", False), ("cost", True), ("category", False))),
    "c17_vendors": Report("receipt_line", {"vendor": "coalesce(name, CAST(vendor_no AS STRING))"}, {"amount": money("amount_lc"), "received": money("quantity_received")}, _QUARTER, _VENDOR, order=(("amount", True), ("vendor", False)), top=25),
    "c18_fulfilment": Report("receipt_line", {"vendor": "coalesce(name, CAST(vendor_no AS STRING))"}, {"ordered": money("quantity_ordered"), "received": money("quantity_received")}, _QUARTER, _VENDOR, extra={"pct": "round(received * 100 / nullif(ordered, 0), 1)"}, having="ordered > 0", order=(("pct", False), ("vendor", False)), top=25),
    "c19_receiving": Report("receipt_line", {"posting_date": "posting_date"}, {"amount": money("amount_lc"), "documents": "count(DISTINCT document_no)"}, _QUARTER, order=(("posting_date", False),)),
    "c20_routes": Report("transfer", {"transfer_from": "transfer_from", "transfer_to": "transfer_to"}, {"shipped": money("quantity_shipped"), "received": money("quantity_received")}, _QUARTER, order=(("shipped", True), ("transfer_from", False), ("transfer_to", False)), top=30),
    "c21_in_transit": Report("transfer", {"transfer_to": "transfer_to"}, {"gap": money("quantity_shipped - quantity_received")}, _QUARTER, having="gap > 0", order=(("gap", True), ("transfer_to", False))),
    "c22_pickers": Report("work", {"user_id": "user_id"}, {"n_lines": "count(*)", "units": money("quantity_picked"), "mean_time": "round(avg(actual_time), 6)", "skipped": "count_if(is_skipped = 1)"}, order=(("units", True), ("user_id", False)), top=25),
    "c23_pick_rate": Report("work", {"created_on": "created_on"}, {"allocated": money("quantity_allocated"), "picked": money("quantity_picked")}, extra={"rate": "round(picked * 100 / nullif(allocated, 0), 1)"}, order=(("created_on", False),)),
    "c24_work_status": Report("work", {"line_status": _named("line_status")}, {"n": "count(*)"}, order=(("n", True), ("line_status", False))),
    "c25_incidents": Report("incident", {"category": _named("category"), "status": _named("status")}, {"n": "count(*)", "compensation": money("compensate_amount * coalesce(exchange_rate, 1)")}, order=(("n", True), ("category", False), ("status", False))),
    "c26_compensation": Report("incident", {"created_day": "CAST(created_on AS DATE)"}, {"n": "count(*)", "compensation": money("compensate_amount * coalesce(exchange_rate, 1)"), "vips": "count_if(is_vip_customer = 1)"}, order=(("created_day", False),)),
    "c27_resolution": Report("incident", {"category": _named("category")}, {"resolved": "count(*)", "hrs": "round(avg((unix_timestamp(date_trunc('hour', resolved_on)) - unix_timestamp(date_trunc('hour', created_on))) / 3600), 1)"}, "resolved_on IS NOT NULL", order=(("hrs", True), ("category", False))),
    "c28_new_customers": Report("customer_card", {"created_month": "trunc(customer_creation_date, 'MM')"}, {"n": "count(*)"}, "customer_creation_date >= DATE '1995-01-01'", order=(("created_month", False),)),
    "c29_classification": Report("customer_card", {"customer_classification": _named("customer_classification"), "customer_type": _named("CAST(customer_type AS STRING)")}, {"n": "count(*)", "blocked": "count_if(is_blocked = 1)"}, order=(("n", True), ("customer_classification", False), ("customer_type", False))),
    "c30_loyalty": Report("customer_card", {}, {"members": "count_if(club_code <> '' AND club_code IS NOT NULL)", "others": "count_if(club_code = '' OR club_code IS NULL)", "total": "count(*)"}),
    "c32_elasticity": Report("elasticity", {"elasticity_class": _named("elasticity_class")}, {"n": "count(*)", "mean": "round(avg(try_cast(elasticity AS double)), 3)"}, order=(("n", True), ("elasticity_class", False))),
    "c33_pack_mix": Report("elasticity", {"ppa_class": _named("ppa_class")}, {"n": "count(*)", "revenue": "round(sum(try_cast(total_revenue AS double)), 2)"}, order=(("revenue", True), ("ppa_class", False))),
    "c34_associations": Report("association", {"antecedents": "antecedents", "consequents": "consequents"}, {"lift": "round(max(try_cast(lift AS double)), 3)", "support": "round(max(try_cast(support AS double)), 4)"}, "try_cast(lift AS double) > 1", order=(("lift", True), ("antecedents", False), ("consequents", False)), top=30),
    "c35_pairs": Report("elasticity", {"relationship": _named("CASE WHEN try_cast(elasticity AS double) > 25 THEN 'substitute' WHEN try_cast(elasticity AS double) <= 25 THEN 'complement' END")}, {"n": "count(*)"}, order=(("n", True), ("relationship", False))),
    "c36_promotions": Report("promotion", {"from_date": "from_date"}, {"n": "count(*)", "items": "count(DISTINCT item_no)"}, "from_date >= DATE '1998-01-01'", order=(("from_date", False),)),
    "c37_rates": Report("rates", {"date": "date", "currency_code": "currency_code"}, {"black": "round(avg(black_market_rate), 6)", "official": "round(avg(official_rate), 6)"}, "date BETWEEN DATE '2000-06-01' AND DATE '2000-06-30'", order=(("date", False), ("currency_code", False))),
}
