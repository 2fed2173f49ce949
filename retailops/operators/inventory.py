"""Daily inventory: stock on hand and weekly sales by item and location."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("item_no", "location_code")


def weeks(end: dt.date) -> list[tuple[dt.date, dt.date]]:
    """First and last day of six weeks back from end. The first has eight days, [end - 7, end]; the others seven."""
    day = dt.timedelta(days=1)
    out = [(end - 7 * day, end)]
    for k in range(2, 7):
        out.append((end - 7 * k * day, end - 7 * (k - 1) * day - day))
    return out


def daily_inventory(locations: DataFrame, ledger: DataFrame, end: dt.date, keys: Sequence[str] = KEYS, contains: str | None = None, at: Sequence | None = None, has_stock: bool = False, has_sales: bool = False) -> DataFrame:
    """One row for each (item, location): quantity up to end and the sales of six weeks.

    The ledger is summed up by key before the join, so the join carries one row a key whatever the length of the history.
    """
    if contains:
        locations = locations.where(F.contains(F.lower(F.col(keys[0]).cast("string")), F.lit(contains.lower())))
    if at is not None:
        locations = locations.where(F.col("location_code").isin(list(at)))
    sold = lambda a, b: F.sum(F.when((F.col("entry_type") == "SALES") & F.col("posting_date").between(F.lit(a), F.lit(b)), F.col("quantity")))
    sums = ledger.where(F.col("posting_date") <= F.lit(end)).groupBy(*keys).agg(F.sum("quantity").alias("stock_on_hand"), *(sold(a, b).alias(f"week{k}_qty") for k, (a, b) in enumerate(weeks(end), 1)))
    names = ["stock_on_hand", *(f"week{k}_qty" for k in range(1, 7))]
    out = locations.select(*keys).join(sums, list(keys), "left").withColumns({n: F.round(F.coalesce(n, F.lit(0.0)), 2) for n in names})
    if has_stock:
        out = out.where("stock_on_hand > 0")
    if has_sales:
        out = out.where(" OR ".join(f"week{k}_qty <> 0" for k in range(1, 7)))
    return out


def page(df: DataFrame, keys: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a stable order. For exports take the whole frame; to walk far, filter on key > last instead."""
    return df.orderBy(*keys).offset(offset).limit(limit)


def details(items: DataFrame, wanted: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("item_no",)) -> DataFrame:
    """Chosen detail columns of the items on a page; unknown and repeated columns are dropped."""
    chosen = [c for c in dict.fromkeys(columns) if c in items.columns and c not in keys]
    return items.join(wanted.select(*keys).distinct(), list(keys), "left_semi").select(*keys, *chosen)


def locations(df: DataFrame, code: str = "code", name: str = "store") -> DataFrame:
    return df.where(F.col(code).isNotNull()).select(code, name).orderBy(code)


#: Fixed value: rows of an export at most, as a feature of the export.
EXPORT_ROWS = 1_000_000


def export_rows(stock: DataFrame, details: DataFrame | None = None, columns: Sequence[str] = (), key: Sequence[str] = ("item_no",), rows: int = EXPORT_ROWS) -> DataFrame:
    """The first rows of a stock list by item and location, with columns of the items' details if asked for; for `files.export_csv`."""
    out = stock if details is None or not columns else stock.join(details.select(*key, *columns).dropDuplicates(list(key)), list(key), "left")
    return out.orderBy("item_no", "location_code").limit(rows)
