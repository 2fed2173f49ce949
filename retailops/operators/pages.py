"""Pages of a large sorted table by range: the table is sorted once into ranges, and a page reads those that hold it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build(df: DataFrame, order: Sequence[Column | str], path: str, ranges: int) -> Pages:
    """Sorts df into ranges and writes them with the place of each row in its range.

    One sampled range partitioning, no global sort. The order among rows that are equal in it is settled here and stays; add columns
    that tell rows apart to have it the same in another build. A value on very many rows is one range unless such columns split it.
    """
    place = F.monotonically_increasing_id()  # 33 bits for the row within its partition, above them the partition's number
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", place)
    split = placed.withColumns({"in_range": F.shiftright("_place", 33).cast("int"), "at": F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_place")
    split.sortWithinPartitions("in_range", "at").write.partitionBy("in_range").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(split.schema).parquet(f"{path}/rows")
    rows.groupBy("in_range").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/index")
    return Pages(spark, path, df.schema)


class Pages:
    """The index of such a table: one row for each range."""

    def __init__(self, spark: SparkSession, path: str, columns: T.StructType):
        self.rows = spark.read.schema(T.StructType([*columns.fields, T.StructField("at", T.LongType()), T.StructField("in_range", T.IntegerType())])).parquet(f"{path}/rows")
        self.columns = columns.fieldNames()
        self.starts: list[tuple[int, int, int]] = []  # (range, its first row's place in the table, rows)
        before = 0
        for r in sorted(spark.read.parquet(f"{path}/index").collect(), key=lambda r: r.in_range):
            self.starts.append((r.in_range, before, r.n))
            before += r.n
        self.total = before

    def page(self, number: int, size: int) -> DataFrame:
        """A page, counted from 1, in order. Partitions and, in them, places are compared with constants, which prunes both."""
        first, end = (number - 1) * size, number * size
        parts = [(r, max(first - at, 0), min(end - at, n)) for r, at, n in self.starts if at < end and first < at + n]
        here = F.lit(False)
        for r, lo, hi in parts:
            here = here | ((F.col("in_range") == r) & (F.col("at") >= lo) & (F.col("at") < hi))
        return self.rows.where(here & F.col("in_range").isin([r for r, _, _ in parts])).orderBy("in_range", "at").select(*self.columns)
