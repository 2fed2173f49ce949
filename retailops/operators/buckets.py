"""Tables in hash buckets, named by a manifest: a delta rewrites the buckets of its keys and no others.

A table is a folder: `data/<commit>/in_bucket=<k>/*.parquet` and `manifest/<version>.json`. The manifest says which folders hold each
bucket's rows now, and what of each source has been loaded. It is written last, under a name that must not exist yet: a load is
there as a whole or not at all, together with its source's watermark and batch, readers of an older version keep their files
until `vacuum`, and of two writers at once the second fails. Rows lie in the bucket of their key; rows with a null in the key, which no
key matches, in that of all their columns, so that no bucket holds all of them.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop, kept
from ..sources.footers import can_tell, extremes
from .ingest import aligned, apply_changes, counted, key_columns, typed

_BUCKET = "in_bucket"


@dataclass(frozen=True)
class Manifest:
    """Version, schema, keys and number of buckets; the live folders of each bucket; what of each source has been loaded."""

    version: int
    schema: str
    keys: tuple[str, ...]
    buckets: int
    live: dict[str, list[str]] = field(default_factory=dict)
    sources: dict[str, dict] = field(default_factory=dict)

    @property
    def columns(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


class Bucketed:
    """One such table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: T.StructType, keys: Sequence[str], buckets: int = 64) -> Bucketed:
        """An empty table. Choose the buckets so that one is of the size of a good file at the size the table will have."""
        out = cls(spark, path)
        if any(isinstance(columns[k].dataType, (T.FloatType, T.DoubleType)) for k in keys):
            raise ValueError("keys of floating point have no safe buckets")
        if _BUCKET in columns.fieldNames() or not keys:
            raise ValueError(f"a table needs keys and no column named {_BUCKET}")
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in columns.fields])
        out._publish(Manifest(1, columns.json(), tuple(keys), buckets))
        return out

    def exists(self) -> bool:
        return bool(self._versions())

    def manifest(self) -> Manifest:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no table at {self.path}")
        fs, at = hadoop(self.spark, self._manifest_at(versions[-1]))
        stream = fs.open(at)
        made = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        return Manifest(**made | {"keys": tuple(made["keys"])})

    def _manifest_at(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012d}.json"

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if re.fullmatch(r"\d+\.json", n))

    def _names(self, folder: str) -> list[str]:
        fs, at = hadoop(self.spark, f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _publish(self, m: Manifest) -> None:
        """Written aside and then named, so that no reader finds half of one; the name is refused where another writer was first."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        fs, aside = hadoop(self.spark, f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.writeBytes(json.dumps(asdict(m)))
        out.close()
        at = hadoop(self.spark, self._manifest_at(m.version))[1]
        no_overwrite = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, at, no_overwrite)

    def _bucket(self, m: Manifest) -> Column:
        no_key = F.lit(False)
        for k in m.keys:
            no_key = no_key | F.col(f"`{k}`").isNull()
        every = F.xxhash64(*(F.col(f"`{c}`") for c in m.columns.fieldNames()))
        return F.pmod(F.when(no_key, every).otherwise(F.xxhash64(*(F.col(f"`{k}`") for k in m.keys))), F.lit(m.buckets)).cast("int")

    def rows(self, m: Manifest | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the newest one by default, of all buckets or of some."""
        m = m or self.manifest()
        paths = self._paths(m, buckets)
        return self.spark.read.schema(m.columns).parquet(*paths) if paths else self.spark.createDataFrame([], m.columns)

    def _paths(self, m: Manifest, buckets: Iterable[int] | None = None) -> list[str]:
        wanted = m.live if buckets is None else {str(b): m.live.get(str(b), []) for b in buckets}
        return [f"{self.path}/data/{commit}/{_BUCKET}={b}" for b, commits in wanted.items() for commit in commits]

    def extremes(self, *names: str, m: Manifest | None = None) -> Row:
        """n_rows, and least_<name> and greatest_<name> of each column: from footers wherever these tell, else from the rows.

        A file in which a column is all null tells nothing of it.
        """
        m = m or self.manifest()
        if can_tell(m.columns, names):
            try:
                return extremes(self.spark, self._paths(m), m.columns, names).first()
            except Exception as e:  # noqa: BLE001  the reader's own message says which one it is
                if "No min/max found" not in str(e):
                    raise
        ends = [f(n).alias(f"{end}_{n}") for n in names for end, f in (("least", F.min), ("greatest", F.max))]
        return self.rows(m).agg(F.count("*").alias("n_rows"), *ends).first()

    def _write(self, m: Manifest, rows: DataFrame) -> tuple[str, set[str]]:
        """A new folder with the rows by bucket: its name and its buckets."""
        commit = uuid.uuid4().hex
        rows.withColumn(_BUCKET, self._bucket(m)).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{commit}")
        return commit, {n.split("=")[1] for n in self._names(f"data/{commit}") if n.startswith(f"{_BUCKET}=")}

    def _replaced(self, m: Manifest, touched: Sequence[int], made: DataFrame, **source) -> Manifest:
        commit, held = self._write(m, made)
        return self._next(m, {b: c for b, c in m.live.items() if int(b) not in set(touched)} | {b: [commit] for b in held}, **source)

    def _next(self, m: Manifest, live: dict[str, list[str]], source: str | None = None, note: dict | None = None, watermark: str | None = None) -> Manifest:
        out = replace(m, version=m.version + 1, live=live)
        if source:
            mark = {"watermark": self._text(self.extremes(watermark, m=out)[f"greatest_{watermark}"], out.columns[watermark].dataType)} if watermark else {}
            out = replace(out, sources=m.sources | {source: m.sources.get(source, {}) | (note or {}) | mark})
        self._publish(out)
        return out

    def _text(self, value, kind: T.DataType) -> str | None:
        return self.spark.range(1).select(F.lit(value).cast(kind).cast("string")).first()[0]

    def _touched(self, m: Manifest, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket(m).alias("b")).distinct().collect())  # no more than there are buckets

    def load(self, df: DataFrame, mode: str = "append", source: str | None = None, note: dict | None = None, watermark: str | None = None, without: DataFrame | None = None) -> dict[str, int]:
        """append, replace or upsert of rows cast strictly to the table's columns; returns inserted and updated.

        `note`, and the greatest value that the table then has in the column `watermark`, are kept for the source with the load.
        An upsert also removes the rows with the keys in `without`; they count as updated.
        """
        m = self.manifest()
        rows = typed(df, m.columns, strict=True)
        if not rows.columns:
            raise ValueError("no column of the source is one of the table's")
        if mode == "upsert" and set(key_columns(m.keys, rows.columns)) != set(m.keys):
            raise ValueError(f"an upsert needs the keys of the buckets: {m.keys}")
        # read once, whatever reads the rows further
        rows, valid = counted(aligned(rows, m.columns))
        rows = kept(rows, "delta")
        told = {"source": source, "note": note, "watermark": watermark}
        if mode == "upsert":
            leaving = rows.select(*m.keys)
            if without is not None:
                leaving = leaving.unionByName(kept(without.select(*(F.col(k).cast(m.columns[k].dataType).alias(k) for k in m.keys)), "without"))
            touched = sorted({*self._touched(m, rows), *self._touched(m, aligned(leaving, m.columns).dropna(subset=list(m.keys)))})
            old = self.rows(m, touched)
            before = old.count()
            left, stay = counted(old.join(leaving.distinct(), list(m.keys), "left_anti").select(*m.columns.fieldNames()))
            self._replaced(m, touched, left.unionByName(rows), **told)
            updated = before - stay()
            return {"inserted": max(0, valid() - updated), "updated": updated}
        commit, held = self._write(m, rows)
        live = {} if mode == "replace" else dict(m.live)
        self._next(m, live | {b: [*live.get(b, []), commit] for b in held}, **told)
        return {"inserted": valid(), "updated": 0}

    def load_batch(self, source: str, batch: int, df: DataFrame, mode: str = "append", without: DataFrame | None = None, **note) -> dict[str, int] | None:
        """`load` of a batch that may come again, as a stream's does: one that has been loaded for the source is left out (None)."""
        if self.manifest().sources.get(source, {}).get("batch", -1) >= batch:
            return None
        return self.load(df, mode, source, note | {"batch": batch}, without=without)

    def change(self, updates: DataFrame | None = None, deletes: DataFrame | None = None, inserts: DataFrame | None = None, order: str | None = None, assigned: str | None = None) -> None:
        """`ingest.apply_changes` on the buckets of the keys that occur: all updates, then deletes, then inserts, or nothing."""
        m = self.manifest()
        if len(m.keys) != 1:
            raise ValueError("change sets are for tables with one key column")
        key = m.keys[0]
        parts = [self.spark.createDataFrame([], m.columns) if inserts is None else apply_changes(self.spark.createDataFrame([], m.columns), key, inserts=inserts)]
        new = kept(parts[0], "inserts")
        asked = [new] + [df.select(F.col(key).cast(m.columns[key].dataType).alias(key)) for df in (updates, deletes) if df is not None]
        touched = sorted({b for df in asked for b in self._touched(m, aligned(df, m.columns) if df is not new else df)})
        made = apply_changes(self.rows(m, touched), key, updates, deletes, order=order, assigned=assigned)
        self._replaced(m, touched, made.unionByName(new))

    def compact(self, folders: int = 4) -> None:
        """Buckets in more than so many folders become one folder each."""
        m = self.manifest()
        many = [int(b) for b, c in m.live.items() if len(c) > folders]
        if many:
            self._replaced(m, many, self.rows(m, many))

    def vacuum(self, versions: int = 2) -> list[str]:
        """Deletes folders that none of the newest versions names, and the manifests of older ones; returns the folders."""
        known = self._versions()[-versions:]
        used = set()
        for v in known:
            fs, at = hadoop(self.spark, self._manifest_at(v))
            used |= set(self.spark.read.text(at.toString(), wholetext=True).select(F.from_json("value", "live map<string, array<string>>").alias("m")).select(F.explode(F.flatten(F.map_values("m.live"))).alias("c")).distinct().toPandas()["c"])
        gone = [c for c in self._names("data") if c not in used]
        for name in [f"data/{c}" for c in gone] + [f"manifest/{v:012d}.json" for v in self._versions() if v not in known]:
            fs, at = hadoop(self.spark, f"{self.path}/{name}")
            fs.delete(at, True)
        return gone
