"""Text search over an audit store by a sidecar: for each of its files a bitmap of the trigrams of its texts.

A text that a file holds has all its trigrams there; a file that lacks one needn't be read. Bitmaps have 2**18 hashed places, in eight rows
of 4 KB a file at most. Files that the sidecar doesn't know are always read, so that it may be brought up to date at any time; files that
are gone from the store make no difference.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import AUDIT_TEXTS, audit_search
from ..session import hadoop

_BITS = 18
_SIDECAR = "file string, month string, part int, bits binary"


def trigrams(text: Column) -> Column:
    """All trigrams of a text in lower case, in one walk over the text."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1))


def place(trigram: Column) -> Column:
    return F.xxhash64(trigram).bitwiseAND(F.lit((1 << _BITS) - 1))


def _indexed(spark: SparkSession, sidecar: str) -> DataFrame:
    fs, at = hadoop(spark, sidecar)
    return spark.read.schema(_SIDECAR).parquet(sidecar) if fs.exists(at) else spark.createDataFrame([], _SIDECAR)


def update(spark: SparkSession, store: str, sidecar: str, columns: Sequence[str] = AUDIT_TEXTS) -> int:
    """Adds the files that the sidecar doesn't know yet; returns how many."""
    known = {r.file for r in _indexed(spark, sidecar).select("file").distinct().collect()}
    new = sorted(path for path in _files(spark, store) if _within(path) not in known)
    if not new:
        return 0
    rows = spark.read.option("basePath", store).schema(spark.read.parquet(store).schema).parquet(*new)
    name = F.substring_index("_metadata.file_path", "/", -2).alias("file")
    texts = rows.select(name, F.col("month").cast("string").alias("month"), F.explode_outer(F.array(*(F.col(c).cast("string") for c in columns if c in rows.columns))).alias("text"))
    # a file without any trigram has a row, too, so that it is known
    found = texts.select("file", "month", F.explode_outer(trigrams(F.col("text"))).alias("trigram"))
    found = found.select("file", "month", F.when(F.isnotnull("trigram"), place(F.col("trigram"))).alias("place"))
    # Spark makes bitmaps of sorted rows; numbers of 64 places it sums up by hash as it reads, and at most 4096 of these a file are left to sort
    words = found.groupBy("file", "month", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("has"))
    dealt = words.withColumn("part", F.shiftright("word", 9).cast("int")).repartition("file", "month", "part").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63))))
    held = dealt.where(F.isnull("has") | (F.getbit("has", F.col("k")) == 1))
    bits = held.groupBy("file", "month", "part").agg(F.bitmap_construct_agg(F.coalesce((F.col("word") * 64 + F.col("k")).bitwiseAND(F.lit(32767)), F.lit(0))).alias("bits"))
    bits.write.mode("append").parquet(sidecar)
    return len(new)


def _within(path: str) -> str:
    """A file by its month and name, which all ways to spell its path have in common."""
    return "/".join(path.split("/")[-2:])


def _files(spark: SparkSession, store: str) -> list[str]:
    """The store's files, as a listing gives them to every reader."""
    return spark.read.parquet(store).inputFiles()


def candidates(spark: SparkSession, store: str, sidecar: str, text: str | None, months: tuple[str, str] | None = None) -> list[str]:
    """The files that may hold a text, of the months from the first to the last."""
    files = [f for f in _files(spark, store) if months is None or months[0] <= f.split("month=")[1].split("/")[0] <= months[1]]
    places = [] if not text or len(text.strip()) < 3 else spark.range(1).select(F.array_distinct(F.transform(trigrams(F.lit(text)), place)).alias("p")).first().p
    if not places:
        return files
    by_part: dict[int, list[int]] = {}
    for p in places:
        by_part.setdefault(p >> 15, []).append(p & 32767)
    has = F.lit(False)
    for part, own in by_part.items():
        every = F.col("part") == part
        for p in own:
            byte = F.ascii(F.decode(F.substring("bits", (p >> 3) + 1, 1), "ISO-8859-1"))
            every = every & (byte.bitwiseAND(F.lit(1 << (p & 7))) != 0)
        has = has | every
    known = _indexed(spark, sidecar)
    if months:
        known = known.where(F.col("month").between(*months))
    # a driver's list, as the listing of the files is
    per_file = known.groupBy("file").agg(F.count_if(has).alias("n"))
    lacking = {r.file for r in per_file.where(F.col("n") < len(by_part)).collect()}
    return [f for f in files if _within(f) not in lacking]


def search(spark: SparkSession, store: str, sidecar: str, company, text: str | None = None, start=None, end=None, **how) -> DataFrame:
    """`tables.audit_search` over a store, reading the files that may hold the text."""
    months = (f"{start:%Y-%m}" if start else "0000-00", f"{end:%Y-%m}" if end else "9999-99") if start or end else None
    schema = spark.read.parquet(store).schema
    files = candidates(spark, store, sidecar, text, months)
    rows = spark.read.option("basePath", store).schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return audit_search(rows, company, text, start=start, end=end, **how)
