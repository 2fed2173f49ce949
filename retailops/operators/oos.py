"""Out-of-stock snapshots: items of the latest day, monthly trend and summary tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(oos: DataFrame) -> DataFrame:
    """All rows of the newest snapshot. Its day is asked for first, so that the rows are read, or made, of that day only."""
    newest = oos.agg(F.max("as_of_date")).first()[0]
    return oos.where(F.col("as_of_date") == F.lit(newest)) if newest is not None else oos.limit(0)


def trend(oos: DataFrame, as_of: dt.date, catalogue: int) -> DataFrame:
    """Twelve months: mean daily count as a share of the catalogue, this year (null after as_of) and the year before."""
    daily = oos.where(F.year("as_of_date").isin(as_of.year, as_of.year - 1)).groupBy("as_of_date").agg(F.count("*").alias("n"))
    monthly = daily.groupBy(F.month("as_of_date").alias("month")).agg(*(F.avg(F.when(F.year("as_of_date") == y, F.col("n"))).alias(name) for name, y in (("a", as_of.year), ("b", as_of.year - 1))))
    months = oos.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    share = lambda c: F.bround(F.coalesce(c, F.lit(0.0)) / F.lit(float(max(catalogue, 1))) * 100, 2)
    return months.join(monthly, "month", "left").select("month", F.when(F.col("month") <= as_of.month, share(F.col("a"))).alias("this_year"), share(F.col("b")).alias("prior_year")).orderBy("month")


def filtered(items: DataFrame, category: str | None = None, region=None, state: str | None = None) -> DataFrame:
    for name, value in (("category", category), ("region", region), ("state", state)):
        if value is not None:
            items = items.where(F.col(name) == value)
    return items


def summary(items: DataFrame, catalogue: int) -> DataFrame:
    return items.agg(F.count("*").alias("n"), F.bround(F.count("*") * 100.0 / F.lit(float(max(catalogue, 1))), 2).alias("rate"), F.round(F.coalesce(F.sum("lost"), F.lit(0.0)), 2).alias("lost"), F.count_distinct("store").alias("stores"))


def suppliers(items: DataFrame, default_fill: float = 90.0) -> DataFrame:
    """Count, loss, mean days out of the rows that are not merely low (0 if none) and fill rate of each supplier."""
    return items.groupBy("supplier").agg(
        F.count("*").alias("n"),
        F.round(F.sum("lost"), 2).alias("lost"),
        F.round(F.coalesce(F.avg(F.when(F.col("state") != "low", F.col("days_out"))), F.lit(0.0)), 4).alias("days_out"),
        F.coalesce(F.min("fill_rate").cast("double"), F.lit(default_fill)).alias("fill_rate"),
    )


def counts(items: DataFrame, by: str) -> DataFrame:
    return items.groupBy(by).agg(F.count("*").alias("n"))


def top_stores(items: DataFrame, top: int = 10) -> DataFrame:
    return items.groupBy("store").agg(F.round(F.sum("lost"), 2).alias("lost")).orderBy(F.desc("lost"), "store").limit(top)


def values(items: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that are neither null nor blank."""
    return items.where(F.trim(F.col(column).cast("string")) != "").select(column).distinct().orderBy(column)
