"""Loading tables: validation, append, replace, upsert, change sets and incremental reads."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.exprs import normal_name
from ..session import kept, seen


def matched(staged: DataFrame, target: T.StructType) -> dict[str, str]:
    """Target column -> staged column, by normalized name; the first staged column wins."""
    by_key: dict[str, str] = {}
    for c in staged.columns:
        by_key.setdefault(normal_name(c), c)
    return {f.name: by_key[normal_name(f.name)] for f in target.fields if normal_name(f.name) in by_key}


def validate(staged: DataFrame, target: T.StructType, samples: int = 5) -> DataFrame:
    """(column_name, n_bad, samples) for each common column: values that are not null but fail the cast.

    The upload is scanned once: its bad values are counted by value and kept in the shared folder. Each task then ranks `samples` a
    column at most, so a column in which every value is bad is no burden.
    """
    pairs = matched(staged, target)
    spark = staged.sparkSession
    every = spark.createDataFrame([(c,) for c in pairs], "column_name string")
    bad = [F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"`{s}`").isNotNull() & F.col(f"`{s}`").try_cast(target[c].dataType).isNull(), F.col(f"`{s}`").cast("string")).alias("value")) for c, s in pairs.items()]
    values = staged.select(F.explode(F.array(*bad)).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count("*").alias("n")) if bad else spark.createDataFrame([], "column_name string, value string, n long")
    values = kept(values, "bad-values")
    counts = values.groupBy("column_name").agg(F.sum("n").alias("n_bad"))
    first = values.withColumn("r", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("r") <= samples).groupBy("column_name").agg(F.sort_array(F.collect_list("value")).alias("samples"))
    return every.join(counts, "column_name", "left").join(first, "column_name", "left").select("column_name", F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


@dataclass(frozen=True)
class Inspection:
    """What an upload looks like against its target: columns, those missing and extra, rows, a preview of typed rows."""

    columns: DataFrame
    missing: list[str]
    extra: list[str]
    total: int
    preview: DataFrame


def inspect(staged: DataFrame, target: T.StructType, rows: int = 50) -> Inspection:
    """One scan of the upload: bad values and rows are counted together. The preview reads as many rows as are asked of it."""
    known = matched(staged, target)
    extra = [c for c in staged.columns if c not in known.values()]
    rows_seen, total = counted(staged)
    columns = validate(rows_seen, target).collect()  # a row for each column of the target at most
    if not known:
        rows_seen.write.format("noop").mode("overwrite").save()
    listed = staged.sparkSession.createDataFrame([tuple(r) for r in columns], "column_name string, n_bad long, samples array<string>")
    return Inspection(listed, [f.name for f in target.fields if f.name not in known], extra, total(), typed(staged, target).limit(rows))


def counted(df: DataFrame) -> tuple[DataFrame, Callable[[], int]]:
    """df, and its number of rows as seen by the next action that runs it; no read of its own."""
    rows = Observation()
    return df.observe(rows, F.count(F.lit(1)).alias("n")), lambda: seen(rows, "n")


def fits(staged: DataFrame, target: T.StructType) -> Column:
    """Whether every value of a row that goes into the target can be cast to its type."""
    good: Column = F.lit(True)
    for c, s in matched(staged, target).items():
        good = good & (F.col(f"`{s}`").isNull() | F.col(f"`{s}`").try_cast(target[c].dataType).isNotNull())
    return good


def typed(staged: DataFrame, target: T.StructType, strict: bool = False) -> DataFrame:
    """Common columns in the target's types. Rows with any failing value are left out; strict casts fail the job instead."""
    pairs = matched(staged, target)
    if strict:
        return staged.select(*(F.col(f"`{s}`").cast(target[c].dataType).alias(c) for c, s in pairs.items()))
    return staged.where(fits(staged, target)).select(*(F.col(f"`{s}`").try_cast(target[c].dataType).alias(c) for c, s in pairs.items()))


def aligned(rows: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns in its order, from columns of those names (as `typed` gives them); null where there is none."""
    return rows.select(*((F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.fields))


def key_columns(keys: Sequence[str], common: Sequence[str]) -> list[str]:
    """The keys among the columns that file and table have, whatever their case and blanks around them; none is an error."""
    by = {c.lower(): c for c in common}
    found = [by[k.strip().lower()] for k in keys if k and k.strip().lower() in by]
    if not found:
        raise ValueError("an upsert needs a key column that both the file and the table have")
    return list(dict.fromkeys(found))


def upsert(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not staged, and all staged rows. Null keys match nothing; repeated staged keys are all inserted."""
    return target.join(staged.select(*keys).distinct(), list(keys), "left_anti").unionByName(staged, allowMissingColumns=True)


def upsert_counts(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = target.join(staged.select(*keys).distinct(), list(keys), "left_semi").agg(F.count("*").alias("updated"))
    return staged.agg(F.count("*").alias("valid")).crossJoin(hit).select(F.greatest(F.lit(0), F.col("valid") - F.col("updated")).cast("long").alias("inserted"), "updated")


def apply_changes(target: DataFrame, key: str, updates: DataFrame | None = None, deletes: DataFrame | None = None, inserts: DataFrame | None = None, order: str | None = None, assigned: str | None = None) -> DataFrame:
    """Updates, then deletes, then inserts. Unknown columns are ignored; empty text is null in other types.

    An update assigns all of its columns, nulls included; with `assigned`, an array column, each row assigns only the columns
    that it names. Of several updates of one key the last by `order` counts; without an order they are an error.
    """
    out = target
    if updates is not None:
        known = [c for c in updates.columns if c in target.columns and c != key]
        given = lambda c: F.array_contains(assigned, c) if assigned else F.lit(True)
        row = F.struct(*(_value(updates, c, target.schema[c].dataType).alias(c) for c in known), *(given(c).alias(f"_set_{c}") for c in known))
        if order:
            last = updates.groupBy(key).agg(F.max_by(row, order).alias("_new"))
        else:
            several = F.raise_error(F.concat(F.lit("several updates for key "), F.col(key).cast("string")))
            last = updates.groupBy(key).agg(F.count("*").alias("_n"), F.first(row).alias("_new")).select(key, F.when(F.col("_n") > 1, several).otherwise(F.lit(None).cast("void")).alias("_error"), "_new").where("_error IS NULL").drop("_error")
        change = lambda c: F.when(F.coalesce(F.col("_new")[f"_set_{c}"], F.lit(False)), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        out = out.join(last, key, "left").select(*(change(c) if c in known else F.col(c) for c in target.columns))
    if deletes is not None:
        out = out.join(deletes.select(key).distinct(), key, "left_anti").select(*target.columns)
    if inserts is not None:
        out = out.unionByName(inserts.select(*(_value(inserts, c, target.schema[c].dataType).alias(c) for c in target.columns if c in inserts.columns)), allowMissingColumns=True)
    return out


def _value(df: DataFrame, column: str, kind: T.DataType) -> Column:
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType) and not isinstance(kind, T.StringType):
        c = F.nullif(c, F.lit(""))
    return c.try_cast(kind)


def newer_than(df: DataFrame, column: str, last) -> DataFrame:
    """Rows past the watermark, as a comparison that reaches the scan."""
    return df if last is None else df.where(F.col(column) > F.lit(last).cast(df.schema[column].dataType))


def watermark(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).cast("string").alias("watermark"))


def swap_in(df: DataFrame, path: str) -> None:
    """Writes df beside path and swaps the folders by rename, so that a failed write leaves the old table as it was."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(at(new), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"{new} can't be moved")
    fs.delete(at(old), True)


def load(df: DataFrame, table: str, mode: str = "append", keys: Sequence[str] = ()) -> dict[str, int]:
    """append, replace or upsert into a table, which is created if missing; returns inserted and updated.

    A table that exists keeps its columns, their types and their order: df's columns go to those of the same normalized name, cast
    strictly; the table's other columns are null in the new rows and further ones of df are left out. Rows are counted by the
    write itself, and df is read once: an upsert, which needs its rows twice, keeps them in the shared folder first.
    What replaces a table is written beside it first, so it may be made from the table itself; then the old one is renamed away,
    the new one renamed in and the old one dropped. At no time are the rows gone, but between two renames the name is, and a reader
    that comes just then finds no table; `operators.buckets` has tables without that gap.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z_]\w*", table):
        raise ValueError(f"not a table name: {table!r}")
    if not spark.catalog.tableExists(table):
        rows, valid = counted(df)
        rows.write.saveAsTable(table)
        return {"inserted": valid(), "updated": 0}
    target = spark.table(table).schema
    rows = typed(df, target, strict=True)
    if not rows.columns:
        raise ValueError("no column of the source is one of the table's")
    if mode == "upsert":
        keys = key_columns(keys, rows.columns)
        rows, valid = counted(aligned(rows, target))
        rows = kept(rows, "upsert")
        before = spark.table(table).count()  # from the files' footers
        left, stay = counted(spark.table(table).join(rows.select(*keys).distinct(), keys, "left_anti").select(*target.fieldNames()))
        _exchange(left.unionByName(rows), table)
        updated = before - stay()
        return {"inserted": max(0, valid() - updated), "updated": updated}
    rows, valid = counted(aligned(rows, target))
    if mode == "append":
        rows.write.mode("append").saveAsTable(table)
    else:
        _exchange(rows, table)
    return {"inserted": valid(), "updated": 0}


def replace_whole(df: DataFrame, table: str) -> None:
    """A table becomes df, columns included."""
    if df.sparkSession.catalog.tableExists(table):
        _exchange(df, table)
    else:
        df.write.saveAsTable(table)


def _exchange(df: DataFrame, table: str) -> None:
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    df.write.saveAsTable(f"{table}_new_{mark}")
    spark.sql(f"ALTER TABLE {table} RENAME TO {table}_old_{mark}")
    spark.sql(f"ALTER TABLE {table}_new_{mark} RENAME TO {table}")
    spark.sql(f"DROP TABLE {table}_old_{mark}")


def refresh(spark: SparkSession, query: str, table: str, mode: str = "replace", keys: Sequence[str] = (), create: bool = True) -> dict[str, int]:
    """Loads the result of a SELECT, which may read the table itself. A missing table is created only if `create`; one that exists keeps its columns."""
    if not create and not spark.catalog.tableExists(table):
        raise ValueError(f"no such table: {table}")
    return load(spark.sql(query), table, mode, keys)


def move(spark, source: str, to: str) -> None:
    """Copies a table, then drops the source; refuses to overwrite."""
    if spark.catalog.tableExists(to):
        raise ValueError(f"{to} exists")
    spark.table(source).write.saveAsTable(to)
    spark.sql(f"DROP TABLE {source}")


def peek(df: DataFrame, rows: int = 50) -> tuple[dict[str, str], int, DataFrame]:
    """Types by column, row count and a preview."""
    return dict(df.dtypes), df.count(), df.limit(rows)
