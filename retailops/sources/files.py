"""Reading and writing files: staged text, typed text, JSON documents, Parquet, exports and the audit store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "tsv", "json", "parquet")
#: The date patterns that an export may use; the first is the default.
DATE_PATTERNS = ("dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd", "dd-MM-yyyy", "dd.MM.yyyy")


def file_format(path: str, explicit: str | None = None) -> str:
    """The format by name, else by extension, else csv."""
    for name in (explicit or "", path.rsplit(".", 1)[-1] if "." in path else ""):
        if name.lower() in FORMATS:
            return name.lower()
    return "csv"


#: Encodings that Spark reads without further leave.
_PLAIN = ("utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32", "us-ascii", "iso-8859-1")


def _csv(spark: SparkSession, path: str, kind: str, encoding: str, **how) -> DataFrame:
    if encoding.lower() not in _PLAIN:  # windows-1252 and the like
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"', multiLine=True, encoding=encoding, **how)


def read_staged(spark: SparkSession, path: str, kind: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A file as it is: text columns for csv and tsv, no inference. Quoted fields may hold separators, quotes and line feeds."""
    kind = file_format(path, kind)
    if kind in ("csv", "tsv"):
        return _csv(spark, path, kind, encoding, inferSchema=False)
    if kind == "json":
        return spark.read.json(path, multiLine=True)
    return spark.read.parquet(path)


def read_inferred(spark: SparkSession, path: str, kind: str | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A file with types inferred from all of its rows, for tables that are created from it."""
    kind = file_format(path, kind)
    if kind in ("csv", "tsv"):
        return _csv(spark, path, kind, encoding, inferSchema=True, samplingRatio=1.0)
    return read_staged(spark, path, kind)


def read_json_at(spark: SparkSession, path: str, dotted: str = "") -> DataFrame:
    """The rows at a dotted path of nested JSON documents; a lone object is one row, a missing segment an error."""
    df = spark.read.json(path, multiLine=True)
    kind: T.DataType = df.schema
    for part in [p for p in dotted.split(".") if p]:
        fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
        if part not in fields:
            raise KeyError(f"no {part!r} in {dotted!r}")
        kind = fields[part]
    if not dotted:
        return df
    if isinstance(kind, T.ArrayType):
        rows = df.select(F.explode(F.col(dotted)).alias("r"))
        return rows.select("r.*") if isinstance(kind.elementType, T.StructType) else rows.withColumnRenamed("r", "value")
    return df.select(f"{dotted}.*") if isinstance(kind, T.StructType) else df.select(F.col(dotted).alias("value"))


def jdbc_options(url: str, table: str | None = None, query: str | None = None, timeout_s: int = 3600, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Options of a JDBC read; partition: (column, lower, upper, parts) splits a table into parallel ranges."""
    if (table is None) == (query is None):
        raise ValueError("either a table or a query")
    out = {"url": url, "queryTimeout": str(timeout_s)} | ({"dbtable": table} if table else {"query": query})
    if partition:
        if query:
            out["dbtable"] = f"({out.pop('query')}) AS q"
        out |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, partition), strict=True))
    return out


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, predicates: Sequence[str] = (), properties: dict[str, str] | None = None, keys: Sequence[str] = (), parts: int = 8) -> DataFrame:
    """A table or query of a database, in parallel by ranges of a number, by predicates such as those of `key_ranges`, or by a key.

    With `keys`, which may be several columns of any kinds, the database itself is asked for the bounds of `parts` equal ranges.
    """
    options = jdbc_options(url, table, query, partition=partition)
    source = options.get("dbtable") or f"({options['query']}) AS q"
    if keys:
        predicates = key_ranges(keys, find_bounds(spark, url, source, keys, parts, properties), nulls=True)
    if predicates:
        return spark.read.jdbc(url, source, predicates=list(predicates), properties={k: v for k, v in (properties or {}).items()})
    return spark.read.format("jdbc").options(**options, **(properties or {})).load()


def bounds_sql(source: str, keys: Sequence[str], parts: int, url: str = "") -> str:
    """One query for every n/parts-th key in the order of the keys; rows with a null in the key apart."""
    names, known = ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)
    size = f"(SELECT (COUNT(*) + {parts - 1}) / {parts} FROM {source} WHERE {known})"
    if url.startswith("jdbc:derby"):  # it numbers rows only in the order in which they come
        numbered = f"SELECT ROW_NUMBER() OVER () AS r, s.* FROM (SELECT {names} FROM {source} WHERE {known} ORDER BY {names}) AS s"
    else:
        numbered = f"SELECT {names}, ROW_NUMBER() OVER (ORDER BY {names}) AS r FROM {source} WHERE {known}"
    return f"SELECT DISTINCT {names} FROM ({numbered}) AS n WHERE r > 1 AND MOD(r - 1, {size}) = 0"


def find_bounds(spark: SparkSession, url: str, source: str, keys: Sequence[str], parts: int, properties: dict[str, str] | None = None) -> list[tuple]:
    """The first keys of all ranges but the first, at most parts - 1; keys that many rows share leave fewer."""
    if parts < 2:
        return []
    found = spark.read.jdbc(url, f"({bounds_sql(source, keys, parts, url)}) AS b", properties=properties or {})
    return [tuple(r) for r in found.orderBy(*found.columns).collect()]


def key_ranges(keys: Sequence[str], bounds: Sequence[Sequence], nulls: bool = False) -> list[str]:
    """Predicates that split a table by sorted bounds of a composite key into disjoint ranges, for a parallel JDBC read.

    No range holds rows with a null in the key; with `nulls` they are a part of their own.
    """

    def after(bound: Sequence) -> str:
        options = []
        for k in range(len(keys)):
            equal = [f"{c} = {_literal(v)}" for c, v in zip(keys[:k], bound[:k], strict=True)]
            options.append("(" + " AND ".join([*equal, f"{keys[k]} {'>=' if k + 1 == len(keys) else '>'} {_literal(bound[k])}"]) + ")")
        return "(" + " OR ".join(options) + ")"

    if nulls:
        known = " AND ".join(f"{k} IS NOT NULL" for k in keys)
        return [f"{known} AND ({p})" for p in key_ranges(keys, bounds)] + [" OR ".join(f"{k} IS NULL" for k in keys)]
    if not bounds:
        return ["1 = 1"]
    return [f"NOT {after(bounds[0])}", *(f"{after(a)} AND NOT {after(b)}" for a, b in zip(bounds[:-1], bounds[1:], strict=True)), after(bounds[-1])]


def _literal(v) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def incremental_sql(base: str, column: str, last) -> str:
    """A query for the rows past a watermark: numbers bare, others quoted."""
    return f"SELECT * FROM ({base}) AS base WHERE {column} > {_literal(last)}" if last is not None else base


def export_text(value: Column, kind: str, pattern: str | None = None) -> Column:
    """A field of an export: dates by an allowed pattern, without a time at midnight; null stays empty."""
    pattern = pattern if pattern in DATE_PATTERNS else DATE_PATTERNS[0]
    if kind.startswith("timestamp"):
        midnight = (F.hour(value) == 0) & (F.minute(value) == 0) & (F.second(value) == 0)
        return F.when(midnight, F.date_format(value, pattern)).otherwise(F.date_format(value, f"{pattern} HH:mm:ss"))
    return F.date_format(value, pattern) if kind == "date" else value.cast("string")


def export_csv(df: DataFrame, path: str, pattern: str | None = None) -> None:
    """All fields quoted, nulls empty, one part file for each partition."""
    fields = [export_text(F.col(c), k, pattern).alias(c) for c, k in df.dtypes]
    df.select(*fields).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="")


def write_audit(df: DataFrame, path: str) -> None:
    """Audit rows by month, sorted for the usual search by company and time: over all files of a write, too, whose number grows with the rows."""
    order = ["month", "company_id", "event_time", "action"]
    df.withColumn("month", F.date_format("event_time", "yyyy-MM")).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").partitionBy("month").parquet(path)


def drop_old_months(spark: SparkSession, path: str, as_of: str, keep: int) -> list[str]:
    """Deletes the months of an audit store that `retained_months` does not keep; returns them."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    months = [s.getPath().getName().removeprefix("month=") for s in fs.listStatus(root) if s.getPath().getName().startswith("month=")]
    old = sorted(set(months) - set(retained_months(months, as_of, keep)))
    for m in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/month={m}"), True)
    return old


def retained_months(months: Sequence[str], as_of: str, keep: int) -> list[str]:
    """Of months yyyy-MM those that stay when `keep` months up to as_of are kept."""
    index = lambda m: int(m[:4]) * 12 + int(m[5:7])
    return [m for m in months if index(as_of) - index(m) < keep]
