"""Runs of repeated words within a text: multi-scale minimizers seed long periods, lag scans find the short ones.

A run is a maximal stretch of words with smallest period q, of at least 4 q words and at least `shortest` ones. Periods up to
`LAGS` are found by comparing each word with the one q places on. Longer ones are looked for scale by scale: a scale with k = 2**s
has the periods from k/2 + 1 to k. Words are ranked by their k words (ranks of k come from pairs of ranks of k/2, so equal ranks
are equal words and nothing is hashed), places whose k words occur once in the text leave, and of each window of k/2 places the
least by a fixed mixing of ranks is kept. Inside a run windows repeat at the distance of its period and so do their minima; k words
are at least a period, so within it no nearer place has the same rank. Neighbouring minima of one rank at a distance of the scale
are seeds, which are extended to both sides. A scale without any place left ends the search, which for most texts is soon.

Texts are independent of each other, so no row is shuffled; a slice of about 4 MB of text, or one longer text, is in work at a
time. Defined results: a null or empty text has no words and no runs; repeated rows, null ids, empty tables and further columns
make no difference.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, space_words, table

#: Periods that are found by direct comparison.
LAGS = 4
#: Bytes of text in work at a time.
SLICE = 1 << 22
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd, so that multiplication modulo 2**32 keeps ranks apart.
_MIX = np.uint64(0x9E3779B1)


def lag_stretches(a: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, q) of the maximal stretches of at least `least` symbols whose symbols q apart are equal."""
    if len(a) <= q:
        return []
    same = np.zeros(len(a) - q + 2, np.int8)
    same[1:-1] = a[:-q] == a[q:]
    step = np.diff(same)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least - q
    return [(int(s), int(e) + q, q) for s, e in zip(start[long], end[long], strict=True)]


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading symbols are equal, read in blocks that double."""
    n, at, step = min(len(x), len(y)), 0, 64
    while at < n:
        differ = np.flatnonzero(x[at : min(at + step, n)] != y[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, step * 2
    return n


def window_minima(rank: np.ndarray, width: int) -> np.ndarray:
    """The places of the least ranks, by their mixing, of all windows of `width` places (the leftmost of equal ones); rank 0 is no place."""
    place = np.arange(len(rank), dtype=np.uint64)
    order = np.where(rank > 0, ((rank.astype(np.uint64) * _MIX & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | place, _NONE)
    low, span = order, 1
    while span < width and len(low) > span:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    chosen = np.unique(low)
    return (chosen[chosen != _NONE] & np.uint64(0xFFFFFFFF)).astype(np.int64)


def seeds(a: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, distances) for each scale: the k symbols at a place and at its distance are equal."""
    alive = np.bincount(a)[a] > 1
    rank, k = np.where(alive, a + 1, 0), 1
    while 4 * (k // 2 + 1) <= longest:
        at = np.flatnonzero(rank)
        if not len(at):
            return
        if k > LAGS:
            chosen = window_minima(rank, k // 2)
            chosen = chosen[np.argsort(rank[chosen], kind="stable")]
            apart = np.diff(chosen)
            pair = (rank[chosen][1:] == rank[chosen][:-1]) & (apart > k // 2) & (apart <= k)
            if pair.any():
                yield k, chosen[:-1][pair], apart[pair]
        at = at[at + k < len(a)]
        at = at[rank[at + k] > 0]
        pairs = rank[at].astype(np.uint64) * np.uint64(len(a) + 2) + rank[at + k].astype(np.uint64)
        _, number, times = np.unique(pairs, return_inverse=True, return_counts=True)
        keep = times[number] > 1
        rank, k = np.zeros(len(a), np.int64), 2 * k
        rank[at[keep]] = number[keep] + 1


def runs(a: np.ndarray, longest: int, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs of a sequence of symbols, by start; no run is longer than `longest`."""
    found = [x for q in range(1, LAGS + 1) for x in lag_stretches(a, q, max(shortest, 4 * q))]
    for k, places, apart in seeds(a, longest):
        done = (0, 0)  # the distance and the end of the stretch that was extended last
        for i in np.lexsort((places, apart)):
            p, d = int(places[i]), int(apart[i])
            if done[0] == d and p + d < done[1]:
                continue
            end = p + k + d + _reach(a[p + k :], a[p + k + d :])
            start = p - _reach(a[:p][::-1], a[d : p + d][::-1])
            done = (d, end)
            if end - start >= max(shortest, 4 * d):
                found.append((start, end, d))
    # a stretch that repeats four times or more with two periods repeats with their greatest common divisor, over the same words
    least: dict[tuple[int, int], int] = {}
    for s, e, q in found:
        least[s, e] = min(q, least.get((s, e), q))
    return sorted((s, e, q) for (s, e), q in least.items())


def _slice_of(texts: list[bytes], shortest: int) -> tuple[list[int], list[list[dict]], list[str]]:
    """Words, runs and collapsed text of each text."""
    words = [t.split() for t in texts]
    codes: list[int] = []
    bounds = [0]
    for w in words:  # numbers of words differ between texts, so that nothing reaches from one to the next
        numbers: dict[bytes, int] = {}
        base = len(codes)
        codes += [numbers.setdefault(x, base + len(numbers)) for x in w]
        bounds.append(len(codes))
    a = np.array(codes, np.int64)
    out: list[list[dict]] = [[] for _ in texts]
    for start, end, q in runs(a, max(map(len, words), default=0), shortest) if len(a) else []:
        i = int(np.searchsorted(bounds, start, side="right")) - 1
        out[i].append({"start": start - bounds[i], "length": end - start, "period": q})
    for i, own in enumerate(out):
        if own:
            step = np.zeros(len(words[i]) + 1, np.int64)
            for r in own:
                step[r["start"] + r["period"]] += 1
                step[r["start"] + r["length"]] -= 1
            words[i] = list(compress(words[i], (np.cumsum(step[:-1]) == 0).tolist()))
    return [int(n) for n in np.diff(bounds)], out, [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", shortest: int = 6) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: runs of (start, length, period) in words, and the words without repetitions.

    A word is left out of `collapsed` if a run has it after its first period.
    """
    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def made(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        n, found, left = _slice_of(texts, shortest)
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(found, kind), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, texts, size = 0, [], 0
            for i, t in enumerate(b.column(1)):
                body = t.as_py()
                if texts and size + len(body) > SLICE:
                    yield made(b.column(0).slice(first, len(texts)), texts)
                    first, texts, size = i, [], 0
                texts.append(body)
                size += len(body)
            if texts:
                yield made(b.column(0).slice(first, len(texts)), texts)

    name = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {name}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _tail_repeated(doc_id: Column, text: Column) -> Column:
    """The query's texts: of every tenth document by hash, words from a certain one on repeat those before."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def changed(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")).otherwise("")

    return F.when(F.pmod(h, F.lit(10)) == 0, let(space_words(F.coalesce(text, F.lit(""))), changed)).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    """op13: runs of every document, the most repetitive one apart, and digests of all runs and of what is left."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, "doc_id", _tail_repeated(F.col("doc_id"), F.col("text")))
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    # runs come by start and then period, so the first of those with the greatest quotient stays
    best = "aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr(best).alias("b"), F.expr(f"sha2({listed}, 256)").alias("runs_sha256"), F.expr("sha2(collapsed, 256)").alias("collapsed_sha256"), "n_words")
    return rows.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
