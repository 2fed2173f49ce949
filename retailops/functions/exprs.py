"""Column expressions with the edge rules that the reports rely on."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def label(*values: Column, default: str = "Unknown", trim: bool = False) -> Column:
    """The first value that is neither null nor blank, else the default."""
    tidy = [F.nullif(F.trim(v) if trim else v, F.lit("")) for v in values]
    return F.coalesce(*tidy, F.lit(default))


def ratio(a: Column, b: Column, scale: float = 1.0, digits: int | None = None) -> Column:
    """scale * a / b, null where b is 0; rounded half to even."""
    out = F.lit(scale) * a / F.nullif(b, F.lit(0))
    return out if digits is None else F.bround(out, digits)


def change(now: Column, before: Column) -> Column:
    """Change in percent; from nothing it is 100 if there is something now, else 0."""
    return F.when(before > 0, (now - before) / F.nullif(before, F.lit(0)) * 100).when(now > 0, F.lit(100.0)).otherwise(F.lit(0.0))


def change_label(now: Column, before: Column, flat: float = 0.05) -> Column:
    """'new', 'flat', 'up' or 'down'."""
    p = (now - before) / F.nullif(before, F.lit(0)) * 100
    return F.when((before <= 0) & (now > 0), "new").when(before <= 0, "flat").when(F.abs(p) < flat, "flat").when(p > 0, "up").otherwise("down")


def hours_between(a: Column, b: Column) -> Column:
    """Hour boundaries crossed from a to b (00:59 to 01:01 is one)."""
    hour = lambda c: F.unix_timestamp(F.date_trunc("hour", c))
    return ((hour(b) - hour(a)) / 3600).cast("long")


def month_number(name: Column) -> Column:
    """1 to 12 from a month's name by its first three letters in any case; null for others."""
    key = F.lower(F.substring(name, 1, 3))
    out = F.when(key == MONTHS[0], 1)
    for k, m in enumerate(MONTHS[1:], 2):
        out = out.when(key == m, k)
    return out


def period_index(year: Column, month: Column) -> Column:
    return year * 12 + month


#: Words in a KPI's name that tell its unit.
PERCENT_WORDS = ("%", "ratio", "margin", "contribution", "rate", "percent")
DAY_WORDS = ("time", "days", "delivery")


def kpi_unit(name: Column) -> Column:
    """'%', 'days' or 'num' by words in a KPI's name."""
    return F.when(_any(name, PERCENT_WORDS), "%").when(_any(name, DAY_WORDS), "days").otherwise("num")


#: Words in a KPI's name that mean that lower is better.
LOWER_IS_BETTER = (
    "wastage", "shrinkage", "return", "cost", "days", "delivery time", "turnover",
    "defect", "variance", "outstanding", "aging", "downtime", "complaint",
    "cycle time", "lead time", "response time", "in transit",
)


def kpi_direction(name: Column) -> Column:
    return F.when(_any(name, LOWER_IS_BETTER), "down").otherwise("up")


def _any(name: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(name), F.lit(w))
    return out


def utc_window(day: dt.date, zone: str) -> tuple[Column, Column]:
    """The UTC instants at which a local day begins and ends."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp_ntz").cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.lit(day + dt.timedelta(days=1)).cast("timestamp_ntz").cast("timestamp"), zone)
    return start, end


def normal_name(name: str) -> str:
    """The key by which columns are matched: other characters as _, lower case."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name.strip()).lower()


def column_name(header: str) -> str:
    """A column name from a file's header: lower case, other characters as _, no digit in front."""
    if not header:
        return "column"
    name = re.sub(r"[^A-Za-z0-9_]", "_", header).lower()
    return name if re.match(r"[a-z_]", name) else f"col_{name}"


def table_name(name: str) -> str:
    """A table name from a file's name, by the same rule."""
    if not name:
        return "imported_table"
    made = re.sub(r"[^A-Za-z0-9_]", "_", name).lower()
    return made if re.match(r"[a-z_]", made) else f"table_{made}"


#: Words in a column's name that tell its type, in the order in which they are tried.
TYPE_WORDS = (
    ("decimal(18,3)", ("price", "amount", "cost", "rate", "percent")),
    ("timestamp", ("date", "time")),
    ("string", ("description", "note", "comment")),
    ("boolean", ("active", "enabled")),
)


def type_by_name(name: str) -> str:
    """A first guess at a column's type from its name; is_ counts at its start only."""
    n = name.lower()
    for kind, words in TYPE_WORDS:
        if any(w in n for w in words):
            return kind
    return "boolean" if n.startswith("is_") else "string"
