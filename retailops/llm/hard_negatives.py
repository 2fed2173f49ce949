"""Hard negatives by blocks along a Hilbert curve and their zone maps.

Candidates are sorted by label and by their place on a Hilbert curve through the dimensions of greatest variance, and are written
as a Parquet table of blocks of at most `BLOCK` rows. A block's zone map holds its labels' and every dimension's least and greatest
value. By interval arithmetic a zone map bounds the scores (inner products of integers) of all rows of its block with an anchor.

A question is an anchor with windows of scores: the k best rows of its label, or of another, in each window. First the block with
the greatest bound is read for each anchor; the k-th score found in a window becomes its lower end. Then every other block whose
bounds meet a window so narrowed is read, and no other. Nothing is estimated, so the result is exact; how many blocks are read
depends on how well the data cluster. Anchors and zone maps meet in groups of at most about a thousand of each; a block that is read
meets the anchors that asked for it in groups of that size.

Defined results: rows take no part if the id, the label or the vector is null, a component is null or so large that a score could
exceed a long, or the number of components isn't the usual one (the most frequent one, the greater of equally frequent ones). Rows
with an anchor's id are neither its positives nor its negatives. Where an id is on several rows, the one with the best score
in the window counts, once; of an anchor's rows the one with the least label, then the least vector, asks. Ties go to the
smaller id. An empty table, or one without anchors, gives an empty result; further columns make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a block at most; dimensions and bits of the curve; anchors, or zone maps, of a group, about.
BLOCK, DIMENSIONS, BITS, GROUP = 2048, 10, 6, 1024
_LONG = 2**63 - 1


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of an array of lists of one length, as longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a and b; in doubles where these are exact."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that each row of q can have with a vector of each box."""
    up, down = np.maximum(q, 0), np.maximum(-q, 0)
    return products(up, lo) - products(down, hi), products(up, hi) - products(down, lo)


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row (coordinates of `bits` bits) on a Hilbert curve, by exchanging and inverting low bits from the highest bit down."""
    x = x.T.astype(np.int64).copy()
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            set_ = (x[i] & bit) != 0
            x[0] = np.where(set_, x[0] ^ low, x[0])
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << b), turn ^ ((1 << b) - 1), turn)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | row >> b & 1
    return key


def usable(rows: DataFrame) -> DataFrame:
    """Rows (id, label, v) that take part."""
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    dim = usual[0].d if usual else 0
    most = isqrt(_LONG // 200 // max(dim, 1))
    return rows.where((F.size("v") == dim) & F.forall("v", lambda x: x.between(-most, most)))


def _spread(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(dimension, least, greatest) of the dimensions of greatest variance, over all rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (v := matrix(b.column(0))).size:
                f = v.astype(np.float64)
                yield pa.RecordBatch.from_pydict({"d": np.arange(v.shape[1], dtype=np.int32), "n": np.full(v.shape[1], len(v)), "lo": v.min(0), "hi": v.max(0), "s": f.sum(0), "ss": (f * f).sum(0)})

    parts = rows.select("v").mapInArrow(of, "d int, n long, lo long, hi long, s double, ss double")
    variance = F.sum("ss") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)
    top = parts.groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), variance.alias("var")).orderBy(F.desc("var"), "d").limit(DIMENSIONS)
    return [(r.d, r.lo, r.hi) for r in top.collect()]


def blocks(rows: DataFrame) -> DataFrame:
    """The table of blocks: (band, block, id, label, v); a band is what one task has sorted."""
    spread = _spread(rows)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for b in batches:
            v = matrix(b.column(2))
            at = [(v[:, d] - lo) * ((1 << BITS) - 1) // max(hi - lo, 1) for d, lo, hi in spread] if v.size else []
            key = hilbert(np.stack(at, 1), BITS) if at else np.zeros(b.num_rows, np.int64)
            # equal places, also those of repeated rows, are dealt by a number that is spread over tasks' rows
            mixed = np.arange(salt, salt + b.num_rows) * 2654435761 % 2**31
            salt += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key), pa.array(mixed)], ["id", "label", "v", "key", "salt"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            block = (np.int64(band) << 32) + np.arange(seen, seen + b.num_rows) // BLOCK
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, band, np.int32)), pa.array(block), *b.columns], ["band", "block", "id", "label", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    keyed = rows.select("id", "label", "v").mapInArrow(placed, f"id long, label long, v {kind}, key long, salt long")
    order = ("label", "key", "salt")
    return cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "label", "v").mapInArrow(numbered, f"band int, block long, id long, label long, v {kind}"), "blocks")


def zone_maps(held: DataFrame) -> DataFrame:
    """(band, block, n, label_lo, label_hi, lo, hi) of each block, from partial ones of the tasks that read it."""
    fields = "band int, block long, n long, label_lo long, label_hi long, lo array<bigint>, hi array<bigint>"
    longs = pa.list_(pa.int64())
    schema = pa.schema([("band", pa.int32()), *((c, pa.int64()) for c in ("block", "n", "label_lo", "label_hi")), ("lo", longs), ("hi", longs)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                band, block, label, v = np.asarray(b.column(0)), np.asarray(b.column(1)), np.asarray(b.column(2)), matrix(b.column(3))
                out = []
                for at in np.split(np.arange(len(block)), np.flatnonzero(np.diff(block)) + 1):
                    out.append((band[at[0]], block[at[0]], len(at), label[at].min(), label[at].max(), v[at].min(0), v[at].max(0)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def whole(t: pa.Table) -> pa.Table:
        one = (t["band"][0].as_py(), t["block"][0].as_py(), sum(t["n"].to_pylist()), min(t["label_lo"].to_pylist()), max(t["label_hi"].to_pylist()), matrix(t["lo"]).min(0), matrix(t["hi"]).max(0))
        return pa.table([pa.array([x], f.type) for x, f in zip(one, schema, strict=True)], schema=schema)

    return cut(held.select("band", "block", "label", "v").mapInArrow(partial, fields).groupBy("block").applyInArrow(whole, fields), "zones")


class Finder:
    """Answers questions over one table of blocks."""

    def __init__(self, rows: DataFrame):
        self.blocks = blocks(rows)
        zones = zone_maps(self.blocks)
        self.groups = max(-(-zones.count() // GROUP), 1)
        self.zones = zones.withColumn("zone_group", F.pmod(F.xxhash64("block"), F.lit(self.groups)))
        self.kind = rows.schema["v"].dataType.simpleString()
        #: What `best` has read, as (anchor, band, block) rows, for those who ask how much was pruned.
        self.read: list[DataFrame] = []

    def _met(self, asked: DataFrame, askers: int, other: bool, seeds: bool) -> DataFrame:
        """(anchor, band, block, upper): blocks whose bounds meet a window of the anchor; with `seeds` the best one of each group of zones."""
        fields = "anchor long, band int, block long, upper long"
        schema = pa.schema([("anchor", pa.int64()), ("band", pa.int32()), ("block", pa.int64()), ("upper", pa.int64())])

        def of(q: pa.Table, z: pa.Table) -> pa.Table:
            if not q.num_rows or not z.num_rows:
                return schema.empty_table()
            label, first, last, block = (np.asarray(x) for x in (q["label"], z["label_lo"], z["label_hi"], z["block"]))
            low, high = bounds(matrix(q["v"]), matrix(z["lo"]), matrix(z["hi"]))
            has = (first[None] != label[:, None]) | (last[None] != label[:, None]) if other else (first[None] <= label[:, None]) & (label[:, None] <= last[None])
            has &= block[None] != np.asarray(q["seed"])[:, None]
            meets = np.zeros(has.shape, bool)
            for i, (los, his) in enumerate(zip(q["los"].to_pylist(), q["his"].to_pylist(), strict=True)):
                for lo, hi in zip(los, his, strict=True):
                    meets[i] |= (high[i] >= lo) & (low[i] <= hi)
            has &= meets
            if seeds:
                best = np.where(has, high, -_LONG).argmax(1)
                has &= np.arange(has.shape[1])[None] == best[:, None]
            a, b = np.nonzero(has)
            return pa.table([np.asarray(q["anchor"])[a], np.asarray(z["band"])[b], block[b], high[a, b]], schema=schema)

        left = asked.select("anchor", "label", "v", "los", "his", "seed", "asker", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.groups - 1).cast("long"))).alias("zone_group"))
        right = self.zones.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(askers - 1).cast("long"))).alias("asker"))
        return left.groupBy("zone_group", "asker").cogroup(right.groupBy("zone_group", "asker")).applyInArrow(of, fields)

    def _answers(self, pairs: DataFrame, asked: DataFrame, k: int, other: bool) -> DataFrame:
        """(anchor, window, id, score): the k best of each block that an anchor reads, for each of its windows."""
        schema = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])

        def of(q: pa.Table, c: pa.Table) -> pa.Table:
            if not q.num_rows or not c.num_rows:
                return schema.empty_table()
            ids, labels = np.asarray(c["id"]), np.asarray(c["label"])
            scores = products(matrix(q["v"]), matrix(c["v"]))
            out: list[tuple[int, int, int, int]] = []
            for i, (anchor, label, los, his) in enumerate(zip(*(q[x].to_pylist() for x in ("anchor", "label", "los", "his")), strict=True)):
                fit = np.flatnonzero(((labels != label) if other else (labels == label)) & (ids != anchor))
                fit = fit[np.lexsort((ids[fit], -scores[i][fit]))]
                own, falling = ids[fit], -scores[i][fit]
                for w, (lo, hi) in enumerate(zip(los, his, strict=True)):
                    chosen: dict[int, int] = {}
                    for j in range(int(np.searchsorted(falling, -hi)), int(np.searchsorted(falling, -lo, side="right"))):
                        chosen.setdefault(int(own[j]), -int(falling[j]))
                        if len(chosen) == k:
                            break
                    out += [(anchor, w, x, s) for x, s in chosen.items()]
            return pa.table([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)

        left = pairs.select("anchor", "block").join(asked.select("anchor", "label", "v", "los", "his", "asker"), "anchor")
        needed = pairs.join(asked.select("anchor", "asker"), "anchor").select("band", "block", "asker").distinct()
        right = self.blocks.join(needed, ["band", "block"])
        right = right.toDF(*right.columns)  # questions may come from the same blocks
        return left.groupBy("block", "asker").cogroup(right.groupBy("block", "asker")).applyInArrow(of, "anchor long, window int, id long, score long")

    def best(self, questions: DataFrame, k: int, other: bool) -> DataFrame:
        """(anchor, window, rank, id, score) for questions (anchor, label, v, los, his): the k best rows of each window, both ends included."""
        askers = max(-(-questions.count() // GROUP), 1)
        asked = questions.withColumns({"asker": F.pmod(F.xxhash64("anchor"), F.lit(askers)), "seed": F.lit(-1).cast("long")})
        first = self._met(asked, askers, other, True).groupBy("anchor").agg(F.max_by(F.struct("band", "block"), F.struct("upper", -F.col("block"))).alias("b"))
        seeds = cut(first.select("anchor", "b.band", "b.block"), "seeds")
        found = cut(self._answers(seeds, asked, k, other), "found")
        kth = found.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("kth"))
        narrowed = asked.drop("seed").join(seeds.select("anchor", F.col("block").alias("seed")), "anchor").join(kth, "anchor", "left")
        narrowed = narrowed.withColumn("los", F.expr("transform(los, (x, i) -> greatest(x, try_element_at(kth, CAST(i AS INT))))")).drop("kth")
        narrowed = cut(narrowed, "narrowed")
        pairs = cut(self._met(narrowed, askers, other, False).select("anchor", "band", "block"), "pairs")
        self.read += [seeds, pairs]
        every = found.unionByName(self._answers(pairs, narrowed, k, other)).groupBy("anchor", "window", "id").agg(F.max("score").alias("score"))
        ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id")))
        return ranked.where(F.col("rank") <= k).select("anchor", "window", "rank", "id", "score")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, v), v being integers.

    Positives are the best rows of the anchor's label; negatives those of other labels whose score is at least `low` percent of
    the positive's and at most equal to it.
    """
    rows = usable(rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<bigint>")))
    finder = Finder(rows)
    asking = finder.blocks.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select(F.col("id").alias("anchor"), "r.label", "r.v")
    asking = cut(asking, "anchors")
    ends = lambda x: F.array(F.lit(x).cast("long"))
    near = cut(finder.best(asking.withColumns({"los": ends(-_LONG), "his": ends(_LONG)}), positives, False), "positives")
    # windows by rank of the positive, as places in the arrays; an empty one has its ends crossed
    floor = F.expr(f"if(score >= 0, ({low} * score + 99) div 100, -(({low} * -score) div 100))")
    windows = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", floor.alias("lo"), F.col("score").alias("hi")))).alias("w"))
    questions = cut(asking.join(windows, "anchor").select("anchor", "label", "v", F.col("w.lo").alias("los"), F.col("w.hi").alias("his")), "questions")
    far = finder.best(questions, negatives, True)
    positive = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(positive, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: negatives of the anchors whose vec_id is divisible by 100, with each seventh label changed."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    # what no long can hold becomes null, and such rows, as those with null or non-finite components, take no part
    whole = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) < F.lit(2.0**53), F.floor(256 * x.cast("double"))))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v")), F.col("id") % 100 == 0)


#: The definition itself, all anchors against all rows.
SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM r a JOIN r c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5
"""
