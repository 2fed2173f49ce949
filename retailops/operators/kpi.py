"""KPI cards and trends, attainment, and targets that hold over intervals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import MONTHS, kpi_direction, kpi_unit, period_index


def cards(kpi: DataFrame) -> DataFrame:
    """For each (department, kpi): the newest period and, by the calendar, the month before and the same month a year before.

    Of several rows for a period the largest value counts.
    """
    rows = kpi.where(F.trim("kpi") != "").withColumn("p", period_index(F.col("year"), F.col("month_no")))
    one = rows.groupBy("department", "kpi", "p").agg(F.max(F.struct("value", "target")).alias("v"))
    last = Window.partitionBy("department", "kpi")
    at = one.withColumn("latest", F.max("p").over(last)).where("p IN (latest, latest - 1, latest - 12)")
    pick = lambda back, f: F.max(F.when(F.col("p") == F.col("latest") - back, F.col(f"v.{f}")))
    out = at.groupBy("department", "kpi", "latest").agg(pick(0, "value").alias("current"), pick(0, "target").alias("target"), pick(1, "value").alias("prev_month"), pick(12, "value").alias("prev_year"))
    year = F.floor((F.col("latest") - 1) / 12).cast("int")
    return out.select("department", "kpi", kpi_unit(F.col("kpi")).alias("unit"), kpi_direction(F.col("kpi")).alias("direction"), "current", "target", "prev_month", "prev_year", year.alias("year"), (F.col("latest") - year * 12).cast("int").alias("month"))


def trend(kpi: DataFrame) -> DataFrame:
    """For each series the periods present from December of the year before its latest year to its latest month, labelled Mon 'yy."""
    rows = kpi.withColumn("p", period_index(F.col("year"), F.col("month_no")))
    span = rows.groupBy("department", "kpi").agg(F.max("p").alias("latest"), F.max("year").alias("last_year"))
    names = F.array(*(F.lit(m.capitalize()) for m in MONTHS))
    label = F.concat(F.element_at(names, F.col("month_no").cast("int")), F.lit(" '"), F.lpad((F.col("year") % 100).cast("string"), 2, "0"))
    return rows.join(span, ["department", "kpi"]).where("p <= latest AND p >= last_year * 12").select("department", "kpi", "year", "month_no", label.alias("label"), "value", "target")


def attainment(value: Column, target: Column) -> Column:
    """Percent of the target; without a target 100 if there is something, else 0."""
    return F.when(target > 0, value / F.nullif(target, F.lit(0.0)) * 100).when(value > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def status(percent: Column) -> Column:
    return F.when(percent >= 100, "good").when(percent >= 90, "warn").otherwise("bad")


def status_counts(of_cards: DataFrame) -> DataFrame:
    return of_cards.groupBy(status(attainment(F.col("current"), F.col("target"))).alias("status")).agg(F.count("*").alias("n"))


#: Days are counted from 0001-01-01; so many bits hold those of Spark's dates.
_DAY_BITS = 22


def _day(day: Column) -> Column:
    return F.unix_date(day.cast("date")) + 719162


def active_target(values: DataFrame, targets: DataFrame, by: str = "metric_id", day: str = "period_date") -> DataFrame:
    """Each value with the target that holds on its day; of several the one that starts last, then the largest.

    Intervals are joined by equality: a target lies on the few nodes of a binary tree over days that make up its interval, at most
    two a level, and of the targets on a node only the best one counts. A day has one node a level, and its best target is the best
    one of those. So a metric with very many values and targets costs in proportion to both, not to their product, and its rows are
    dealt by node and by day. Values without a target, or without a metric or day, stay.
    """
    levels = F.sequence(F.lit(0), F.lit(_DAY_BITS))
    first, last = _day(F.col("start_date")), F.coalesce(_day(F.col("end_date")), F.lit((1 << _DAY_BITS) - 1)) + 1

    def on_level(k: Column) -> Column:
        size = F.pow(F.lit(2), k).cast("long")
        a, b = F.ceil(first / size), F.floor(last / size)
        left = F.when((a < b) & (a % 2 == 1), F.struct(k.alias("level"), a.alias("node")))
        right = F.when((a < b) & (b % 2 == 1), F.struct(k.alias("level"), (b - 1).alias("node")))
        return F.array(left, right)

    held = targets.where("is_active AND start_date IS NOT NULL").select(F.col(by).alias("_by"), F.struct("start_date", "target").alias("t"), F.explode(F.array_compact(F.flatten(F.transform(levels, on_level)))).alias("n"))
    best = held.groupBy("_by", "n.level", "n.node").agg(F.max("t").alias("t"))
    days = values.select(F.col(by).alias("_by"), F.col(day).cast("date").alias("_day")).where("_by IS NOT NULL AND _day IS NOT NULL").distinct()
    above = days.select("_by", "_day", F.posexplode(F.transform(levels, lambda k: F.floor(_day(F.col("_day")) / F.pow(F.lit(2), k).cast("long")))).alias("level", "node"))
    found = above.join(best, ["_by", "level", "node"]).groupBy("_by", "_day").agg(F.max("t").alias("_t"))
    joined = values.join(found, (F.col(by) == F.col("_by")) & (F.col(day).cast("date") == F.col("_day")), "left")
    return joined.select(*values.columns, F.col("_t.target").alias("target"), F.col("_t.start_date").alias("target_start"))


def metric_values(values: DataFrame, metrics: DataFrame, company, metric=None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Values of a company's metrics with the metric's name, by period: oldest first in a range, else newest first."""
    own = metrics.where(F.col("company_id") == company).select("metric_id", "metric_name")
    found = values.join(own, "metric_id")
    if metric is not None:
        found = found.where(F.col("metric_id") == metric)
    if start is not None and end is not None:
        return found.where(F.col("period_date").between(F.lit(start), F.lit(end))).orderBy("period_date", "metric_id")
    return found.orderBy(F.desc("period_date"), "metric_id")


def target_vs_actual(targets: DataFrame, sales: DataFrame) -> DataFrame:
    """Targets and sales (store_scheme, date and target or net_amount_acy) by month, also months that only one of them has."""
    month = F.trunc("date", "MM").alias("period")
    a = targets.groupBy("store_scheme", month).agg(F.sum("target").alias("target"))
    b = sales.groupBy("store_scheme", month).agg(F.sum("net_amount_acy").alias("actual"))
    both = a.join(b, ["store_scheme", "period"], "full_outer")
    return both.select("store_scheme", "period", F.round("target", 2).alias("target"), F.round("actual", 2).alias("actual"), F.round(F.coalesce("actual", F.lit(0.0)) * 100 / F.nullif("target", F.lit(0.0)), 2).alias("achieved"))


def forecast_vs_actual(forecast: DataFrame, sales: DataFrame) -> DataFrame:
    """Forecasts (numbers kept as text: net, net_lower, net_upper) by scheme and day with the day's sales."""
    actual = sales.groupBy("store_scheme", "date").agg(F.sum("net_amount_acy").alias("actual"))
    num = lambda c: F.col(c).try_cast("double")
    return forecast.join(actual, ["store_scheme", "date"], "left").select("store_scheme", "date", F.round(num("net"), 2).alias("forecast"), F.round(num("net_lower"), 2).alias("lower_bound"), num("net_upper").alias("upper_bound"), F.round("actual", 2).alias("actual"))
