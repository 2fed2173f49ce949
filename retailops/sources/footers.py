"""Counts and extremes of Parquet tables from their files' footers, without reading a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose extremes footers hold and the reader takes from there. Times without zone, written by Spark, are 64-bit microseconds.
_PLAIN = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampNTZType)


def can_tell(columns: T.StructType, names: Sequence[str]) -> bool:
    """Whether footers of files with these columns hold the extremes: footers number flat columns by their place."""
    return all(isinstance(f.dataType, T.AtomicType) for f in columns.fields) and all(isinstance(columns[n].dataType, _PLAIN) for n in names)


def extremes(spark: SparkSession, paths: Sequence[str], columns: T.StructType, names: Sequence[str] = ()) -> DataFrame:
    """One row: n_rows, and least_<name> and greatest_<name> of each column; null for a column that is all null.

    For files that Spark has written with exactly these columns in this order, as those of `operators.buckets` are: the reader finds
    a column's figures by its place in the schema. Only such columns as `can_tell` agrees to may be asked for.
    """
    if not can_tell(columns, names):
        raise ValueError(f"footers don't tell the extremes of {list(names)} in {columns.simpleString()}")
    v2 = spark.newSession()  # the setting is of the session that runs the query, which may come later
    v2.conf.set("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text")
    v2.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    times = {n for n in names if isinstance(columns[n].dataType, T.TimestampNTZType)}
    raw = T.StructType([T.StructField(f.name, T.LongType() if f.name in times else f.dataType) for f in columns.fields])
    if not paths:
        found = v2.createDataFrame([], raw).agg(F.count("*").alias("n_rows"), *_ends(names))
    else:
        found = v2.read.schema(raw).parquet(*paths).agg(F.count("*").alias("n_rows"), *_ends(names))
    at = lambda c, n: (F.timestamp_micros(c).cast("timestamp_ntz") if n in times else F.col(c)).alias(c)
    return found.select("n_rows", *(at(f"{end}_{n}", n) for n in names for end in ("least", "greatest")))


def _ends(names: Sequence[str]) -> list:
    return [f(n).alias(f"{end}_{n}") for n in names for end, f in (("least", F.min), ("greatest", F.max))]
