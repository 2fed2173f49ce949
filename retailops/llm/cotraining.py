"""Quality classifier by co-training.

Two logistic classifiers see a document from different sides: one its text (byte pairs, word shapes and a few ratios), one the
data about it (source, language, length). They start from the same labelled rows. In each round both score all documents
without a label, where these lie, and each gives those that it is surest of, in the proportion of the labels, to the other's
training rows. Each view is then calibrated on labelled rows that it was not trained on (Platt), and the calibrated views are
combined as independent evidence: the sum of their log-odds less those of the labels. All documents are scored.

The driver fits on at most `labelled` rows with a label, chosen by hash of the id, and `2 * per_round` pseudo-labelled ones of
each round; it holds their features only. Candidates cover the whole table: a round's pass returns keys and probabilities,
of which the surest are taken, and only the documents of those keys are read for their features. A view that is sure of
nothing gives nothing. Scoring ships `2 * (dims + 64)` weights.

Defined results: a null text or null metadata count as empty; labels that are null are left out, repeated ones count as often as
they occur; of rows with one id, the one with the least hash of its text is learnt from; documents without an id are scored only;
without labels of both classes every score is the share of good labels (0.5 if there are none); one row comes out for each row
in; empty tables and further columns make no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

DIMS = 1024
_META = 64


def text_features(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Shares of hashed byte pairs (scaled) and ratios that tell prose from junk."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(dims, np.float32)
    n = len(data)
    if n > 1:
        pair = (data[:-1].astype(np.uint32) << 8) | data[1:]
        bins = ((pair * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dims - 16)
        out[16:] = np.sqrt(np.bincount(bins, minlength=dims - 16) / n)
    space = ((data == 32) | ((data >= 9) & (data <= 13))).sum()
    words = max(int(space) + 1, 1)
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    out[0] = 1
    out[1] = letters.sum() / max(n, 1)
    out[2] = ((data >= 65) & (data <= 90)).sum() / max(n, 1)
    out[3] = ((data >= 48) & (data <= 57)).sum() / max(n, 1)
    out[4] = (data >= 128).sum() / max(n, 1)
    out[5] = min(np.isin(data, np.frombuffer(b"#*$%&|<>!", np.uint8)).sum() / words, 3)
    out[6] = np.log1p(words) / 10
    out[7] = min(n / words, 30) / 30
    lines = (text or "").split("\n")
    out[8] = 1 - len(set(lines)) / len(lines)
    out[9] = words < 50
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(_META, np.float32)
    out[0] = 1
    out[1 + _bucket(source, 30)] = 1
    out[31 + _bucket(lang, 15)] = 1
    out[46 + min(int(np.log2(max(n_chars or 0, 0) + 1)), 17)] = 1
    return out


def _bucket(value: str | None, n: int) -> int:
    h = 2166136261
    for b in (value or "").encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h % n


def fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic weights by accelerated gradient descent."""
    n = max(len(y), 1)
    rate = 4.0 / max(float((x * x).sum(axis=1).mean()) if len(x) else 1.0, 1e-6)
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    for t in range(steps):
        g = (probability(x @ v) - y) @ x / np.float32(n) + np.float32(l2) * v
        new = v - np.float32(rate) * g
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w.astype(np.float64)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that make scores log-odds."""
    if not len(z) or z.std() < 1e-9:
        p = (y.sum() + 1) / (len(y) + 2)
        return 0.0, float(np.log(p / (1 - p)))
    scale = z.std()
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    a = fit(np.stack([np.ones(len(z)), z / scale], axis=1), target, l2=1e-6, steps=500)
    return float(a[1] / scale), float(a[0])


#: From this probability on a view is sure of a document.
SURE = 0.95


@dataclass(frozen=True)
class Model:
    """given: for each round how many rows the text view gave and the metadata view gave."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    prior: float
    given: tuple[tuple[int, int], ...] = ()

    def log_odds(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = t @ self.text * self.text_scale[0] + self.text_scale[1]
        b = m @ self.meta * self.meta_scale[0] + self.meta_scale[1]
        return a, b, a + b - self.prior


#: (weights of both views, for each view the keys that it may no longer be given, how many good and bad ones) ->
#: for each view (features of the rows that it gets, their labels, their keys).
Exchange = Callable[[list[np.ndarray], list[set[int]], int, int], list[tuple[np.ndarray, np.ndarray, list[int]]]]


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, exchange: Exchange, rounds: int = 3, per_round: int = 150) -> Model:
    """y: labels 0/1 of the rows of t and m."""
    good = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(good / (1 - good)))
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(t.shape[1]), np.zeros(m.shape[1]), (0.0, prior), (0.0, prior), prior)
    held = np.arange(len(y)) % 4 == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    rows = [[t[~held]], [m[~held]]]
    labels = [[y[~held]], [y[~held]]]
    taken: list[set[int]] = [set(), set()]
    w = [fit(x[0], y[~held]) for x in rows]
    given = []
    for _ in range(rounds):
        got = exchange(w, taken, max(int(per_round * good), 1), max(int(per_round * (1 - good)), 1))
        for v, (x, label, keys) in enumerate(got):
            rows[v].append(x)
            labels[v].append(label)
            taken[v] |= set(keys)
        given.append((len(got[1][1]), len(got[0][1])))
        w = [fit(np.concatenate(rows[v]), np.concatenate(labels[v])) for v in (0, 1)]
    test = held if held.any() else np.ones(len(y), bool)
    scales = [platt(x[test] @ w[v], y[test]) for v, x in ((0, t), (1, m))]
    return Model(w[0], w[1], scales[0], scales[1], prior, tuple(given))


def surest(p: np.ndarray, free: np.ndarray, good: int, bad: int, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The free rows that a view with these probabilities is surest of: (good ones, bad ones).

    Of equally sure ones, and rows with the same metadata are just that, those with the least keys: which slice or task a row is in
    makes no difference.
    """
    left = np.flatnonzero(free)
    order = left[np.lexsort((left if key is None else key[left], -np.abs(p[left] - 0.5)))]
    top, low = order[p[order] >= SURE][:good], order[p[order] <= 1 - SURE][:bad]
    return top, low


_COLUMNS = ("text", "source", "lang", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns that features are made of, and key, a hash of the id."""
    return docs.select(F.xxhash64("doc_id").alias("key"), "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))


def _matrices(b: pa.RecordBatch, first: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the features of both views; the text is in column `first`."""
    for start in range(0, b.num_rows, 1000):
        part = b.slice(start, 1000)
        t = np.stack([text_features(x.as_py()) for x in part.column(first)])
        m = np.stack([meta_features(*x) for x in zip(*(part.column(first + i).to_pylist() for i in (1, 2, 3)), strict=True)])
        yield part, t, m


def _features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(text features, metadata features, labels, keys) of (key, text, source, lang, n_chars, label): so few rows that the driver can hold them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t, m in _matrices(b, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], ["key", "label", "t", "m"])

    found = rows.select("key", *_COLUMNS, "label").mapInArrow(of, "key long, label int, t binary, m binary").orderBy(F.xxhash64("t", "m"), "label").toPandas()
    t = np.frombuffer(b"".join(found.t), np.float32).reshape(-1, DIMS)
    m = np.frombuffer(b"".join(found.m), np.float32).reshape(-1, _META)
    return t, m, found.label.to_numpy(np.float64), found.key.tolist()


def _of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of each chosen key (the least by hash of its text), once for each of its labels."""
    found = rows.join(F.broadcast(chosen.select("key").distinct()), "key")
    one = found.groupBy("key").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *_COLUMNS)).alias("d")).select("key", *(F.col(f"d.{x}").alias(x) for x in _COLUMNS))
    return one.join(F.broadcast(chosen), "key")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", labelled: int = 4000, per_round: int = 150, rounds: int = 3) -> Model:
    """A model from a bounded sample of labelled documents and the surest of all unlabelled ones."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit(11))
    marked = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(target).cast("int").alias("label")).orderBy(order, "label").limit(labelled)
    rows = _rows(docs.where(F.col("doc_id").isNotNull()))
    t, m, y, known = _features(_of(rows, marked.select(F.xxhash64("doc_id").alias("key"), "label")))

    def exchange(w: list[np.ndarray], taken: list[set[int]], good: int, bad: int) -> list[tuple[np.ndarray, np.ndarray, list[int]]]:
        shipped = spark.sparkContext.broadcast((w, [np.array(sorted(x | set(known)), np.int64) for x in taken]))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, gone = shipped.value
            for b in batches:
                for part, t, m in _matrices(b, 1):
                    key = part.column(0).to_numpy(zero_copy_only=False)
                    p = [probability(x @ w[v]) for v, x in ((0, t), (1, m))]
                    for to in (0, 1):
                        free = ~np.isin(key, gone[to])
                        for label, chosen in zip((1, 0), surest(p[1 - to], free, good, bad, key), strict=True):
                            sure = np.abs(p[1 - to][chosen] - 0.5)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chosen), to, np.int32)), pa.array(np.full(len(chosen), label, np.int32)), pa.array(sure), pa.array(key[chosen])], ["view", "label", "sure", "key"])

        seen = cut(rows.mapInArrow(of, "view int, label int, sure double, key long"), "candidates")
        out = []
        for to, width in ((0, DIMS), (1, _META)):
            of_view = seen.where(F.col("view") == to).groupBy("label", "key").agg(F.max("sure").alias("sure"))
            best = [of_view.where(F.col("label") == label).orderBy(F.desc("sure"), "key").limit(k).select("key", "label") for label, k in ((1, good), (0, bad))]
            picked = [(int(r.key), int(r.label)) for r in best[0].unionByName(best[1]).collect()]  # per_round rows at most
            if picked:
                found = _features(_of(rows, spark.createDataFrame(picked, "key long, label int")))
                out.append((found[to], found[2], found[3]))
            else:
                out.append((np.zeros((0, width), np.float32), np.zeros(0), []))
        discard(seen)
        shipped.unpersist()
        return out

    return co_train(t, m, y, exchange, rounds, per_round)


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) for every row of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t, m in _matrices(b, 1):
                p = [probability(z) for z in shipped.value.log_odds(t, m)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in p), pa.array(p[2] >= threshold)], ["doc_id", "p_text", "p_meta", "score", "kept"])

    return docs.select("doc_id", *_COLUMNS[:3], F.col("n_chars").cast("long").alias("n_chars")).mapInArrow(of, f"doc_id {kind}, p_text double, p_meta double, score double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: quality of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
