"""The live feed of cumulative sales rows: current state and rollups.

Columns: scheme, store_code, division_name, category_name, hour, net_amount_acy, total_transactions, received_at.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import label, utc_window

KEY = ("store_code", "scheme", "division_name", "category_name")


def current(feed: DataFrame, day: dt.date, zone: str = "UTC") -> DataFrame:
    """The rows of each key at its newest arrival of a local day; rows that tie are all kept."""
    start, end = utc_window(day, zone)
    at = F.col("received_at").cast("timestamp")
    newest = F.rank().over(Window.partitionBy(*KEY).orderBy(F.desc("received_at")))
    return feed.where((at >= start) & (at < end)).withColumn("_r", newest).where("_r = 1").drop("_r")


def kpis(state: DataFrame) -> DataFrame:
    """Sums, distinct stores and schemes, and the last arrival. Rows become one for each (store, scheme) first; of these one kind is counted at a time."""
    pairs = state.groupBy("store_code", "scheme").agg(F.sum("net_amount_acy").alias("net"), F.sum("total_transactions").alias("tx"), F.max("received_at").alias("at"))
    totals = pairs.agg(F.round(F.sum("net"), 2).alias("sales"), F.sum("tx").alias("tx"), F.count_distinct("store_code").alias("stores"), F.max("at").alias("updated"))
    schemes = pairs.agg(F.count_distinct("scheme").alias("schemes"))
    return totals.crossJoin(schemes).select("sales", "tx", "stores", "schemes", "updated")  # one row by one row


def rollup(state: DataFrame, *by: str) -> DataFrame:
    """Sales and transactions by dimensions; blank values are 'unknown'."""
    keys = [label(F.col(b).cast("string"), default="unknown", trim=True).alias(b) for b in by]
    return state.groupBy(*keys).agg(F.round(F.sum("net_amount_acy"), 2).alias("sales"), F.sum("total_transactions").alias("tx"), F.count("*").alias("n"))


def rollups(state: DataFrame) -> DataFrame:
    """By division, by category, by both and by store in one pass."""
    dims = ["division_name", "category_name", "store_code"]
    tidy = state.withColumns({d: label(F.col(d).cast("string"), default="unknown", trim=True) for d in dims})
    sets = [[F.col("division_name")], [F.col("category_name")], [F.col("division_name"), F.col("category_name")], [F.col("store_code")]]
    return tidy.groupingSets(sets, *dims).agg(F.round(F.sum("net_amount_acy"), 2).alias("sales"), F.sum("total_transactions").alias("tx"), F.grouping_id().cast("long").alias("level"))


def store_in_focus(state: DataFrame, store) -> DataFrame:
    """The division that sells most in a store, and its categories, the best first."""
    own = rollup(state.where(F.col("store_code") == store), "division_name", "category_name")
    best = own.groupBy("division_name").agg(F.sum("sales").alias("s")).orderBy(F.desc("s"), "division_name").limit(1).select("division_name")
    return own.join(F.broadcast(best), "division_name", "left_semi").orderBy(F.desc("sales"), "category_name")


def select(feed: DataFrame, store=None, scheme: str | None = None, hours: tuple[int, int] | None = None, company=None, unprocessed: bool = False, newest_first: bool = False) -> DataFrame:
    """Feed rows by company, store, scheme, hours and whether they were processed, by hour or by arrival, newest first."""
    for column, value in (("company_id", company), ("store_code", store), ("scheme", scheme)):
        feed = feed.where(F.col(column) == value) if value is not None else feed
    if hours is not None:
        feed = feed.where(F.col("hour").between(*hours))
    if unprocessed:
        feed = feed.where(~F.coalesce(F.col("is_processed"), F.lit(False)))
    return feed.orderBy(F.desc("received_at")) if newest_first else feed.orderBy("hour")


def last_hour_rows(feed: DataFrame, day: dt.date, zone: str = "UTC") -> DataFrame:
    """For each store and scheme of a local day: sales, transactions and average basket at the last hour that it has rows of."""
    state = current(feed, day, zone)
    last = state.groupBy("store_code", "scheme").agg(F.max("hour").alias("hour"))
    at = state.join(last, (state["store_code"].eqNullSafe(last["store_code"])) & (state["scheme"].eqNullSafe(last["scheme"])) & (state["hour"] == last["hour"]), "left_semi")
    tx = F.sum("total_transactions")
    return at.groupBy("store_code", "scheme", "hour").agg(F.round(F.sum("net_amount_acy"), 2).alias("sales"), tx.alias("tx"), F.round(F.coalesce(F.sum("net_amount_acy") / F.nullif(tx, F.lit(0)), F.lit(0.0)), 4).alias("avg_basket"))


def day_snapshot(feed: DataFrame, day: dt.date, zone: str = "UTC") -> DataFrame:
    """By scheme: sales, transactions, average basket, stores and the last hour that has sales."""
    state = current(feed, day, zone)
    return state.groupBy("scheme").agg(
        F.round(F.sum("net_amount_acy"), 2).alias("sales"), F.sum("total_transactions").alias("tx"),
        F.round(F.coalesce(F.sum("net_amount_acy") / F.nullif(F.sum("total_transactions"), F.lit(0)), F.lit(0.0)), 2).alias("avg_basket"), F.count_distinct("store_code").alias("stores"), F.max("hour").alias("last_hour"),
    )


def live_store_sales(lines: DataFrame, terminals: DataFrame, rates: DataFrame, store_at_market: str, profile: str, divisor: float = 89700.0) -> DataFrame:
    """Sales by store and category from till lines: unwanted tills dropped, amounts negated and converted.

    One store is converted at the latest market rate, the others by a fixed divisor. A store's transactions are spread evenly
    over its categories; lines are counted, not distinct transactions.
    """
    rate = F.broadcast(rates.agg(F.max_by("rate", "date").alias("market")))
    bad = terminals.where(F.col("hardware_profile") == profile).select(F.col("no").alias("pos_terminal_no"))
    good = lines.where(F.trim("pos_terminal_no") != "").join(bad, "pos_terminal_no", "left_anti")
    transactions = good.groupBy("store_no", "transaction_no").agg(F.lit(1).alias("one")).groupBy("store_no").agg(F.count("transaction_no").alias("tx"))
    by = good.groupBy("store_no", "item_category_code").agg(F.max("hour").alias("hour"), F.sum("net_amount").alias("net"), F.count("*").alias("lines"))
    stores = by.groupBy("store_no").agg(F.count("item_category_code").alias("categories")).join(transactions, "store_no")
    used = F.when(F.col("store_no") == store_at_market, F.col("market")).otherwise(F.lit(divisor))
    return by.join(stores, "store_no").crossJoin(rate).select("store_no", "item_category_code", "hour", F.round(-F.col("net") / used, 4).alias("net_amount_acy"), F.round(F.col("tx") / F.col("categories"), 4).alias("store_transactions"), "lines")


def chain_sales(lines: DataFrame, headers: DataFrame, categories: DataFrame) -> DataFrame:
    """Sales of a chain by store and category, each line converted by its header's rate.

    Headers of wasted goods or of other kinds than 2 are left out, and lines without a header with them; amounts are negated and
    lines counted.
    """
    key = ["store_no", "pos_terminal_no", "transaction_no"]
    own = headers.where("wastage = 0 AND transaction_type = 2").select(*key, "rate")
    named = lines.join(own, key).join(categories.select("item_category_code", "category_name", "division_name"), "item_category_code", "left")
    return named.groupBy("store_no", "division_name", "category_name").agg(F.max("hour").alias("hour"), F.round(-F.sum(F.col("net_amount") / F.col("rate")), 4).alias("net_amount_acy"), F.count("*").alias("lines"))


def order_lines(pages: DataFrame) -> DataFrame:
    """The lines of landed JSON pages (array `value` of lines with a header struct): store, currency, amount, order, created_at."""
    return pages.select(F.explode("value").alias("l")).select(F.col("l.ShippingWarehouseId").alias("store"), F.col("l.SalesOrderHeader.CurrencyCode").alias("currency"), F.col("l.LineAmount").alias("amount"), F.col("l.SalesOrderHeader.SalesOrderNumber").alias("order_no"))


def online_orders(lines: DataFrame, *by: str, divisor: float = 89700.0, local: str = "LBP") -> DataFrame:
    """Net and distinct orders by store, or by other columns such as scheme, store and hour; local currency is converted."""
    net: Column = F.when(F.col("currency") == local, F.col("amount") / divisor).otherwise(F.col("amount"))
    return lines.groupBy(*(by or ("store",))).agg(F.round(F.sum(net), 2).alias("net"), F.count_distinct("order_no").alias("orders"))
