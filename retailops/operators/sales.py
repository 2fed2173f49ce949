"""Sales overviews and the daily drill-down with comparison windows.

Column names are those of the roles: company_id, store_code, pos_number, transaction_no, receipt_no, item_no, date, quantity,
net_amount_acy, total_discount_acy; stores have code, store, store_scheme; items have item_no, category_code, division_code.
A basket is the tuple (store, till, transaction, receipt), counted exactly, nulls included.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import change, change_label, label

BASKET = ("store_code", "pos_number", "transaction_no", "receipt_no")


def basket() -> Column:
    return F.struct(*BASKET)


def small(df: DataFrame, limit_mb: int = 64) -> DataFrame:
    """df marked for broadcast if the optimizer's size estimate is within the limit; else the join is left to Catalyst."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit_mb << 20 else df


def between(days: tuple[dt.date, dt.date], column: str = "date") -> Column:
    return F.col(column).between(F.lit(days[0]), F.lit(days[1]))


def overview_windows(as_of: dt.date, days: int) -> tuple[tuple[dt.date, dt.date], tuple[dt.date, dt.date]]:
    """The last `days` days (1 to 365) and as many before."""
    days = min(max(days, 1), 365)
    start = as_of - dt.timedelta(days=days - 1)
    return (start, as_of), (start - dt.timedelta(days=days), start - dt.timedelta(days=1))


def in_window(sales: DataFrame, company: str, window: tuple[dt.date, dt.date]) -> DataFrame:
    return sales.where((F.col("company_id") == company) & between(window))


def headline(sales: DataFrame, company: str, as_of: dt.date, days: int = 30) -> DataFrame:
    """Totals of the window and of the one before, with changes, in one scan.

    Baskets are first reduced to one row each with a flag for each window, so that exact counts need no Expand.
    """
    now, before = overview_windows(as_of, days)
    rows = sales.where((F.col("company_id") == company) & (between(now) | between(before)))
    cond = {"": between(now), "prev_": between(before)}
    per = [F.sum(F.when(c, F.col(x))).alias(f"{p}{y}") for p, c in cond.items() for x, y in (("net_amount_acy", "revenue"), ("quantity", "units"), ("total_discount_acy", "discount"))]
    one = rows.groupBy(*BASKET).agg(*per, *(F.max(c.cast("int")).alias(f"{p}in") for p, c in cond.items()))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    out = one.agg(*(total(f"{p}{y}").alias(f"{p}{y}") for p in cond for y in ("revenue", "units", "discount")), *(F.coalesce(F.sum(f"{p}in"), F.lit(0)).alias(f"{p}baskets") for p in cond))
    c = lambda x: F.col(x).cast("double")
    return out.select(
        F.round("revenue", 2).alias("revenue"), F.round("units", 2).alias("units"), "baskets", F.round("discount", 2).alias("discount"),
        F.round(F.when(c("baskets") > 0, c("revenue") / F.nullif(c("baskets"), F.lit(0))).otherwise(0.0), 2).alias("avg_basket"),
        F.round(F.when(c("revenue") + c("discount") > 0, c("discount") * 100 / F.nullif(c("revenue") + c("discount"), F.lit(0.0))).otherwise(0.0), 2).alias("discount_pct"),
        F.round("prev_revenue", 2).alias("prev_revenue"), "prev_baskets",
        F.round(change(c("revenue"), c("prev_revenue")), 2).alias("revenue_change"),
        F.round(change(c("baskets"), c("prev_baskets")), 2).alias("baskets_change"),
    )


def daily_trend(sales: DataFrame, company: str, as_of: dt.date, days: int = 30) -> DataFrame:
    rows = in_window(sales, company, overview_windows(as_of, days)[0])
    return rows.groupBy("date").agg(F.round(F.sum("net_amount_acy"), 2).alias("revenue"), F.round(F.sum("quantity"), 2).alias("units"), F.count_distinct(basket()).alias("baskets")).orderBy("date")


def by_store(sales: DataFrame, stores: DataFrame, company: str, as_of: dt.date, days: int = 30, top: int = 20) -> DataFrame:
    """Revenue by store, the highest first; a store without a name goes by its code."""
    rows = in_window(sales, company, overview_windows(as_of, days)[0]).groupBy("store_code").agg(F.sum("net_amount_acy").alias("revenue"))
    named = rows.join(small(stores), rows.store_code == stores.code, "left")
    return named.groupBy(label(F.col("store"), F.col("store_code").cast("string")).alias("store")).agg(F.round(F.sum("revenue"), 2).alias("revenue")).orderBy(F.desc("revenue"), "store").limit(top)


def with_items(sales: DataFrame, items: DataFrame, hierarchy: DataFrame, dedupe: bool = True) -> DataFrame:
    """sales with division_code, category_code, division and category.

    The hierarchy may have a category several times; dedupe takes the least label, without it the rows fan out.
    """
    if dedupe:
        hierarchy = hierarchy.groupBy("category_code").agg(F.min("category").alias("category"))
    else:
        hierarchy = hierarchy.select("category_code", "category")
    return sales.join(items, "item_no", "left").join(small(hierarchy), "category_code", "left")


def by_category(sales: DataFrame, items: DataFrame, hierarchy: DataFrame, company: str, as_of: dt.date, days: int = 30, top: int = 12, dedupe: bool = True) -> DataFrame:
    rows = in_window(sales, company, overview_windows(as_of, days)[0]).groupBy("item_no").agg(F.sum("net_amount_acy").alias("revenue"))
    named = with_items(rows, items, hierarchy, dedupe)
    return named.groupBy(label(F.col("category"), F.col("category_code")).alias("category")).agg(F.round(F.sum("revenue"), 2).alias("revenue")).orderBy(F.desc("revenue"), "category").limit(top)


def by_hour(events: DataFrame, time: str = "received_at", amount: str = "net_amount_acy") -> DataFrame:
    return events.groupBy(F.hour(time).alias("hour")).agg(F.round(F.sum(amount), 2).alias("revenue"), F.count("*").alias("lines")).orderBy("hour")


def payment_mix(headers: DataFrame, company: str, window: tuple[dt.date, dt.date], top: int = 12) -> DataFrame:
    rows = in_window(headers, company, window)
    return rows.groupBy(label(F.col("payment_method")).alias("method")).agg(F.count("*").alias("orders"), F.round(F.sum("delivery_charge"), 2).alias("charges")).orderBy(F.desc("orders"), "method").limit(top)


def top_items(sales: DataFrame, items: DataFrame, company: str, as_of: dt.date, days: int = 30, top: int = 15) -> DataFrame:
    """Top items; the description is joined to the few rows that are left."""
    best = in_window(sales, company, overview_windows(as_of, days)[0]).groupBy("item_no").agg(F.round(F.sum("net_amount_acy"), 2).alias("revenue"), F.round(F.sum("quantity"), 2).alias("units")).orderBy(F.desc("revenue"), "item_no").limit(top)
    return F.broadcast(best).join(items.select("item_no", "description"), "item_no", "right").where("revenue IS NOT NULL").select("item_no", label(F.col("description"), F.col("item_no").cast("string")).alias("item"), "revenue", "units")


# --- daily drill-down --------------------------------------------------------------------------------------------------


def scope_window(day: dt.date, scope: str) -> tuple[dt.date, dt.date]:
    """A day, or the part of its month (MTD) or year (YTD) up to it."""
    return {"YTD": day.replace(month=1, day=1), "MTD": day.replace(day=1)}.get(scope, day), day


def months_before(day: dt.date, n: int) -> dt.date:
    """n months earlier, at the month's end if it is shorter."""
    k = day.year * 12 + day.month - 1 - n
    return dt.date(k // 12, k % 12 + 1, min(day.day, calendar.monthrange(k // 12, k % 12 + 1)[1]))


def comparison_windows(as_of: dt.date, scope: str = "Day", view: str = "ToDate") -> dict[str, tuple[dt.date, dt.date]]:
    """val, cur, lm, ly: by view Day the anchors are 28 and 364 days back (same weekday), else a month and a year."""
    lm, ly = (as_of - dt.timedelta(days=28), as_of - dt.timedelta(days=364)) if view == "Day" else (months_before(as_of, 1), months_before(as_of, 12))
    return {"val": scope_window(as_of, scope), "cur": scope_window(as_of, scope), "lm": scope_window(lm, scope), "ly": scope_window(ly, scope)}


LEVELS = {"scheme": "store_scheme", "store": "store", "division": "division_code", "category": "category_code"}


def drilldown(sales: DataFrame, stores: DataFrame, items: DataFrame, company: str, as_of: dt.date, scope: str = "MTD", view: str = "ToDate", level: str = "scheme", scheme: str | None = None, store: str | None = None, division: str | None = None) -> DataFrame:
    """One row for each value of the level with sales and exact baskets in four windows, from one scan.

    The first shuffle is on the basket (and the item's label, if that is asked for), which spreads even a very large store; the
    second only adds up flags. A basket is of one store, so stores are joined to baskets and not to lines.
    """
    rows = _windowed(sales, company, as_of, scope, view)
    if store:
        rows = rows.where(F.col("store_code") == store)
    item = {}
    if level in ("division", "category") or division:
        rows = rows.join(items.select("item_no", "division_code", "category_code"), "item_no", "left")
        rows = rows.where(label(F.col("division_code")) == division) if division else rows
        item = {"_item": label(F.col(LEVELS[level]))} if level in ("division", "category") else {}
    one = _baskets(rows, item)
    if level in ("scheme", "store") or scheme:
        one = one.join(small(stores.select(F.col("code").alias("store_code"), "store", "store_scheme")), "store_code", "left")
        one = one.where(label(F.col("store_scheme")) == scheme) if scheme else one
    key = F.col("_item") if item else label(F.col(LEVELS[level]), F.col("store_code").cast("string")) if level == "store" else label(F.col(LEVELS[level]))
    return _summed(one, {"label": key}).orderBy(F.desc("val_sales"), "label")


def _windowed(sales: DataFrame, company: str, as_of: dt.date, scope: str, view: str) -> DataFrame:
    windows = comparison_windows(as_of, scope, view)
    conds = {w: between(d) for w, d in windows.items()}
    any_of = conds["val"] | conds["lm"] | conds["ly"]
    return sales.where((F.col("company_id") == company) & any_of).withColumns({f"in_{w}": c for w, c in conds.items()})


_FOUR = ("val", "cur", "lm", "ly")


def _baskets(rows: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Sales and a flag in each window by basket and keys."""
    return rows.groupBy(*(c.alias(k) for k, c in keys.items()), *BASKET).agg(
        *(F.sum(F.when(F.col(f"in_{w}"), F.col("net_amount_acy"))).alias(f"{w}_s") for w in _FOUR), *(F.max(F.col(f"in_{w}").cast("int")).alias(f"{w}_t") for w in _FOUR)
    )


def _summed(baskets: DataFrame, keys: dict[str, Column]) -> DataFrame:
    return baskets.groupBy(*(c.alias(k) for k, c in keys.items())).agg(*(F.round(F.coalesce(F.sum(f"{w}_s"), F.lit(0)), 2).alias(f"{w}_sales") for w in _FOUR), *(F.sum(f"{w}_t").cast("long").alias(f"{w}_tx") for w in _FOUR))


def grand_totals(levels: DataFrame) -> DataFrame:
    """Totals over the rows of a drill-down, average basket and how the value compares with last month and last year."""
    out = levels.agg(*(F.round(F.sum(f"{w}_sales"), 2).alias(f"{w}_sales") for w in ("val", "lm", "ly")), *(F.sum(f"{w}_tx").alias(f"{w}_tx") for w in ("val", "lm", "ly")))
    c = lambda x: F.col(x).cast("double")
    return out.withColumns({
        "avg_basket": F.round(F.when(c("val_tx") > 0, c("val_sales") / F.nullif(c("val_tx"), F.lit(0))).otherwise(0.0), 2),
        "vs_lm": change_label(c("val_sales"), c("lm_sales")),
        "vs_ly": change_label(c("val_sales"), c("ly_sales")),
    })


def drilldown_rollup(sales: DataFrame, stores: DataFrame, company: str, as_of: dt.date, scope: str = "MTD", view: str = "ToDate") -> DataFrame:
    """Stores, schemes and the grand total at once. A basket is of one store, so flags of baskets add up at every level."""
    one = _baskets(_windowed(sales, company, as_of, scope, view), {}).join(small(stores.select(F.col("code").alias("store_code"), "store", "store_scheme")), "store_code", "left")
    one = _summed(one, {"scheme": label(F.col("store_scheme")), "store": label(F.col("store"), F.col("store_code").cast("string"))})
    sums = [F.round(F.sum(f"{w}_sales"), 2).alias(f"{w}_sales") for w in ("val", "lm", "ly")] + [F.sum(f"{w}_tx").alias(f"{w}_tx") for w in ("val", "lm", "ly")]
    return one.rollup("scheme", "store").agg(F.grouping_id().cast("long").alias("level"), *sums)
