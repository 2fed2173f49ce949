"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex classes of the two kinds of white space and words in use.
SPACE = r"[\x20\x09-\x0D]"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches of whole texts, and Spark's setting for their size.
BATCH, ARROW_BYTES = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only with a local master, where driver and executors are one process, a temporary folder is made where neither is set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark, "_retailops_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark._retailops_scratch = at
    return at.rstrip("/")


@contextlib.contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Jobs inside send rows to mapInArrow in Arrow batches of about `size` at most; the usual 10,000 texts lie in each task several times, in JVM and Python."""
    usual = spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_BYTES, size)
    try:
        yield
    finally:
        spark.conf.set(ARROW_BYTES, usual)


def cut(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, and a lost executor costs no rerun of what came before.

    batch: the size of the Arrow batches on the way, for functions whose results don't depend on it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/retailops-{name}-{uuid.uuid4().hex}"
    with batches_of(spark, batch) if batch else contextlib.nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._retailops_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `cut` has written; nothing that is still to be computed may read them."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._retailops_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


class Bits:
    """A bitmap of 2**27 hashed keys as a DataFrame of 16 MB at most, which is broadcast whatever the number of keys.

    It tells of each row whether its key may be one of the table's or surely is none. The more keys there are, the more rows may
    hold one, up to all of them; what follows must decide on the keys themselves, so results never depend on it.
    """

    def __init__(self, table: DataFrame, *keys: str):
        at = table.select(self._bucket(keys).alias("bucket"), self._place(keys).alias("place")).repartition("bucket")
        self.bits = at.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))

    @staticmethod
    def _bucket(keys: tuple[str, ...]) -> Column:
        return F.shiftright(F.xxhash64(*keys), 15).bitwiseAND(F.lit(4095))

    @staticmethod
    def _place(keys: tuple[str, ...]) -> Column:
        return F.xxhash64(*keys).bitwiseAND(F.lit(32767))

    def _marked(self, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        place = self._place(keys)
        byte = F.ascii(F.decode(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, 1), "ISO-8859-1"))
        bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), (place.bitwiseAND(F.lit(7)) + 1).cast("int")))
        bits = F.broadcast(self.bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")))
        return rows.join(bits, self._bucket(keys) == F.col("_bucket"), "left").withColumn("_may", F.coalesce(bit != 0, F.lit(False)))

    def may_hold(self, rows: DataFrame, *keys: str) -> DataFrame:
        return self._marked(rows, keys).where("_may").select(*rows.columns)

    def surely_lacks(self, rows: DataFrame, *keys: str) -> DataFrame:
        return self._marked(rows, keys).where("NOT _may").select(*rows.columns)
