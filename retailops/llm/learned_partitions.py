"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Fitting uses a sample of at most `SAMPLE` vectors: their neighbour graph is cut into parts of equal size (medians along principal
axes, then moves that cut fewer edges within bounds of size), and a small classifier learns which parts hold a vector's neighbours.
Indexing covers every row: the classifier's most probable part holds it, in chunks of about `CHUNK` rows, so that a part with a
third of all rows is many groups. A query is routed to its most probable parts, up to a share of probability that is set on data:
for at most `JUDGES` queries the true neighbours among all rows are found in one pass, and the least share that reaches `TARGET` of
them is taken. What is routed is compared exactly, part by part, and reranked by the exact distance of the original vectors.

Defined results: rows whose id or vector is null, whose vector is zero, has a null or non-finite component or not the usual number
of components (the most frequent one, the greater of equally frequent ones), take no part. A query is never its own neighbour, and
no row with its id is. Where an id is on several rows, the nearest of them counts, once; a query id on several rows is one query
that is as near to a candidate as its nearest row. Ties go to the smaller id. Squares beyond doubles are infinite.
An empty table, or one without queries, gives an empty result; further columns make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Vectors to fit on, at most.
SAMPLE = 8192
#: Queries whose true neighbours set how far to look, at most; and the share of these that must be found.
JUDGES, TARGET = 256, 0.95
#: Rows and queries of one comparison, about.
CHUNK = 32768
#: Neighbours in the graph, hidden units of the classifier, parts at most.
DEGREE, HIDDEN, PARTS = 10, 128, 256


def usable(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int, int]:
    """(id, v) of the rows that take part, their number and the number of components."""
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0))
    sizes = {r[0]: r[1] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()}
    dim, n = next(iter(sizes.items()), (0, 0))
    return rows.where(F.size("v") == dim), n, dim


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of an array of lists of one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b: by products where these are safe from overflow, else by differences."""
    with np.errstate(over="ignore"):
        a2, b2 = (a * a).sum(1), (b * b).sum(1)
        if len(a2) and len(b2) and not a2.max() + b2.max() < 1e300:
            return np.stack([((b - x) ** 2).sum(1) for x in a])
    return a2[:, None] + b2[None, :] - 2 * (a @ b.T)


def nearest(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, block: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of q, ids, distances) of the k nearest candidates with different ids, none with the query's own, the nearest first."""
    distinct = len(np.unique(c_ids)) == len(c_ids)
    for at in range(0, len(q), block):
        part = q[at : at + block]
        near = squares(part, c)
        near[q_ids[at : at + block, None] == c_ids[None, :]] = np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * ((part * part).sum(1) + (c * c).sum(1).max(initial=0))  # far more than the products' error
        for i, row in enumerate(near):
            other = c_ids != q_ids[at + i]
            if distinct and len(row) > k + 1 and np.isfinite(slack[i]):
                mine = np.flatnonzero((row <= np.partition(row, k - 1)[k - 1] + slack[i]) & other)
            else:
                mine = np.flatnonzero(other)
            with np.errstate(over="ignore"):
                exact = np.sqrt(((c[mine] - part[i]) ** 2).sum(1))
            order = np.lexsort((c_ids[mine], exact))
            if not distinct:
                _, first = np.unique(c_ids[mine][order], return_index=True)
                order = order[np.sort(first)]
            order = order[:k]
            yield at + i, c_ids[mine][order], exact[order]


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """The `degree` nearest others of each row (fewer rows: all)."""
    degree = min(degree, len(x) - 1)
    out = []
    for at in range(0, len(x), 512):
        d = squares(x[at : at + 512], x)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, degree - 1, axis=1)[:, :degree] if degree > 0 else np.zeros((len(d), 0), np.int64))
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """A part for each row: sizes within 10 % of each other's mean, few edges of the graph between parts."""
    part = np.zeros(len(x), np.int64)

    def split(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            part[rows] = first
            return
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        order, left = rows[np.argsort(y @ axis, kind="stable")], len(rows) * (n // 2) // n
        split(order[:left], first, n // 2)
        split(order[left:], first + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    if parts == 1 or not graph.size:
        return part
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    rng, size = np.random.default_rng(seed), np.bincount(part, minlength=parts)
    most, least = int(np.ceil(1.1 * len(x) / parts)), int(0.9 * len(x) / parts)
    for _ in range(rounds):
        links = np.bincount(a * parts + part[b], minlength=len(x) * parts).reshape(len(x), parts)
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        gain[rng.random(len(x)) < 0.5] = 0  # else neighbours change places for ever
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if size[best[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer: the probability of each part to hold a vector's neighbours."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(h - h.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability, and the probability of those before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, 1)
        return order, np.cumsum(sorted_p, 1) - sorted_p


def train(x: np.ndarray, targets: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> Router:
    """Fits the classifier to the targets' distributions by Adam."""
    rng = np.random.default_rng(seed)
    shift, parts = x.mean(0), targets.shape[1]
    scale = float(np.sqrt(((x - shift) ** 2).mean())) or 1.0
    z = (x - shift) / scale
    w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), batch):
            rows = order[at : at + batch]
            a = np.maximum(z[rows] @ w[0] + w[1], 0)
            h = a @ w[2] + w[3]
            e = np.exp(h - h.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - targets[rows]) / len(rows)
            back = (g @ w[2].T) * (a > 0)
            step += 1
            for k, d in enumerate((z[rows].T @ back, back.sum(0), a.T @ g, g.sum(0))):
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] -= rate * (1 - epoch / epochs) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(shift, scale, *w)


def fit(x: np.ndarray, parts: int) -> Router:
    """Graph, parts and classifier of a sample."""
    graph = neighbour_graph(x, DEGREE)
    part = balanced_parts(x, graph, parts)
    held = np.zeros((len(x), parts))
    np.add.at(held, (np.arange(len(x)), part), 1)
    np.add.at(held, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    return train(x, held / held.sum(1, keepdims=True))


@dataclass(frozen=True)
class Index:
    """Every usable row with its part and salt, the router, the chunks of each part and how far a query looks."""

    rows: DataFrame
    router: Router | None
    chunks: dict[int, int]
    share: float


def build(vectors: DataFrame, judges: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10) -> Index:
    """Indexes all rows. The share of probability to look at is set on rows for which `judges` (of the id, as id) holds."""
    rows, n, dim = usable(vectors, vec_id, vector)
    if not n:
        return Index(cut(rows.selectExpr("id", "v", "0 AS part", "0L AS salt"), "vector-index"), None, {}, 1.0)
    million = 1_000_000
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(million)) < int(np.ceil(million * min(1.0, SAMPLE / n)))).limit(SAMPLE)
    sample = matrix(chosen.select("v").toArrow().column(0))
    parts = int(np.clip(round(n**0.5 / 4), 1, min(PARTS, max(len(sample) // 32, 1))))
    router = fit(sample, parts) if len(sample) else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for b in batches:
            if b.num_rows:
                part = router.probabilities(matrix(b.column(1))).argmax(1) if router else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int32)), pa.array(np.arange(salt, salt + b.num_rows))], ["id", "v", "part", "salt"])
                salt += b.num_rows

    kind = rows.schema["v"].dataType.simpleString()
    indexed = cut(rows.mapInArrow(assign, f"id long, v {kind}, part int, salt long"), "vector-index")
    sizes = {r.part: r.n for r in indexed.groupBy("part").agg(F.count("*").alias("n")).collect()}  # PARTS rows at most
    return Index(indexed, router, {p: -(-s // CHUNK) for p, s in sizes.items()}, _share(indexed, router, judges, k))


def _share(indexed: DataFrame, router: Router | None, judges: Column, k: int) -> float:
    """The least share of probability that reaches TARGET of the true neighbours of at most JUDGES queries, found among all rows."""
    asked = indexed.where(judges).orderBy(F.xxhash64("id"), "id").limit(JUDGES).select("id", "v").toArrow()
    if not asked.num_rows or router is None:
        return 1.0
    q, q_ids = matrix(asked.column(1)), np.asarray(asked.column(0))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        for b in batches:
            ids, part = np.asarray(b.column(0)), np.asarray(b.column(2))
            where = dict(zip(ids.tolist(), part.tolist(), strict=True))
            for i, near, far in nearest(q, q_ids, matrix(b.column(1)), ids, k) if b.num_rows else ():
                d, p = np.concatenate([best[i][0], far]), np.concatenate([best[i][1], [where[x] for x in near.tolist()]]).astype(np.int64)
                order = np.argsort(d, kind="stable")[:k]
                best[i] = d[order], p[order]
        rows = [(i, d, p) for i, (ds, ps) in enumerate(best) for d, p in zip(ds.tolist(), ps.tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], pa.int32()), "d": pa.array([r[1] for r in rows], pa.float64()), "p": pa.array([r[2] for r in rows], pa.int32())})

    near = indexed.select("id", "v", "part").mapInArrow(of, "q int, d double, p int")
    true = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "p"))).where(F.col("r") <= k).select("q", "p").toArrow()
    if not true.num_rows:
        return 1.0
    order, before = router.order(q)
    at = np.argsort(order, 1)
    asked_of, held = np.asarray(true.column(0)), np.asarray(true.column(1))
    needed = np.sort(before[asked_of, at[asked_of, held]])
    return float(needed[min(int(np.ceil(TARGET * len(needed))), len(needed)) - 1])


def search(index: Index, queries: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that the index finds of every indexed row for which `queries` holds."""
    spark, router, share = index.rows.sparkSession, index.router, index.share
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = index.rows.schema["v"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order, before = router.order(matrix(b.column(1)))
                parts = [o[x <= share].tolist() for o, x in zip(order, before, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.int32()))], ["id", "v", "parts"])

    asked = index.rows.where(queries)
    groups = F.lit(-(-asked.count() // CHUNK) or 1)
    chunks = F.element_at(F.create_map(*(F.lit(x) for p, c in index.chunks.items() for x in (p, c))), F.col("part"))
    routed = asked.select("id", "v").mapInArrow(route, f"id long, v {kind}, parts array<int>").select("id", "v", F.explode("parts").alias("part"))
    # a part that holds no row has no chunk
    routed = routed.where(F.coalesce(chunks, F.lit(0)) > 0).select("id", "v", "part", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("id"), groups).cast("int").alias("asker"))
    held = index.rows.select("id", "v", "part", F.pmod("salt", chunks).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("asker"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        q_ids, c_ids = np.asarray(left["id"]), np.asarray(right["id"])
        found = [(np.full(len(ids), q_ids[i]), ids, far) for i, ids, far in nearest(matrix(left["v"]), q_ids, matrix(right["v"]), c_ids, k)]
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], schema=schema)

    key = ("part", "chunk", "asker")
    near = routed.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, score double")
    # all that a query has found meets once; at most k rows of each group that it was compared with
    best = near.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: ten neighbours of each vector whose id is divisible by 100."""
    hundredth = F.col("id") % 100 == 0
    return search(build(table(spark, sf_dir, "embeddings"), hundredth), hundredth)
