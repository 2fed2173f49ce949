"""N-gram Jaccard join by a token-group matrix.

A document's set has its distinct shingles of `k` words. Documents with equal sets form a class, and classes are compared once.
All sets are ordered in one way: shingles that few documents have come first, by hash, and those known to be frequent last. Two
sets that are similar enough have a shingle in common among the first of each (the prefix), so classes without one are
never compared. Where the first shingle that two sets share stands in each bounds what they can share at all: no more than
what follows in either.

1. Every class is compared with one leader, a class with which it shares much of its prefix. This is linear in the input, also
   for a group that holds a third of all rows. What links makes the first components; classes with one leader, linked or not,
   make a group of similar documents.
2. Groups are cut into chunks of at most `chunk` classes, and a matrix holds for each shingle and chunk the union over its
   members: the most that follows the shingle in a member, and the least size. A class is a query to each chunk outside of its
   component that shares a prefix shingle, if the places of that shingle allow a link. For a chunk with one class, the places
   of the shingles before it tell whether the pair was met already, and parities of the sets (`_parity`), an exact upper bound,
   whether it is worth a comparison. For the others the chunk's token-group matrix, the union of its members' shingles with the
   members of each, bounds the overlap with the whole chunk first; only if that reaches the threshold is it opened, and all its
   overlaps come from one sum over the matrix. No two classes that can link stay untried unless they are in one component
   already, so no component is split.

The order only decides how much is compared, never what links. Frequent shingles are counted over all documents in local
batches: those that `common` documents of a batch have are summed up, and the `listed` most frequent are known to all tasks.
Shingles of one class only and texts that no pair asks for are left out by a bitmap of fixed size (`common.Bits`) before they
are shuffled. Equality of shingles and sets is that of their 63-bit and 128-bit hashes.

Defined results: a null text or a text without words has an empty set, which links with nothing: such a row is its own
component. Rows with one id have the component of the row that is least; equal sets link whatever the ids; with null ids the
component is the least id that is not null, or null if there is none; ids of any type that can be ordered will do; empty tables
give no rows; further columns are ignored by `join` and kept as they are by `representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import BATCH, Bits, batches_of, cut, discard, text_of
from .components import components

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


#: Stands for no shingle.
_NONE = 2**63 - 1
#: Shingles before one that are looked at to tell whether a pair was met already.
_BEFORE = ("p1", "p2", "p3")


def _placed(shingles: np.ndarray) -> np.ndarray:
    """The places of shingles that are not frequent: numbers below 0 in the order of the hashes. Frequent ones have their rank."""
    return (shingles | A.U(1 << 63)).view(np.int64)


class Measure:
    """Shingles of k words; sets link if 100 * intersection >= percent * union."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def least(self, n: int, m: int) -> int:
        """The intersection that sets of n and m need."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1 if n else 0

    def shingles(self, text: str | None) -> np.ndarray:
        """The set of a text as sorted hashes of 63 bits."""
        data = _FOLD[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
        words = A.word_symbols(data, np.array([len(data)]))[0]
        n = len(words)
        if not n:
            return np.zeros(0, A.U)
        k = min(self.k, n)
        at = np.arange(n - k + 1)
        return np.unique(A.Hashes(words).of(at, at + k) >> A.U(1))

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        n, m = len(x), len(y)
        if not n or self.percent * max(n, m) > 100 * min(n, m):
            return False
        return len(np.intersect1d(x, y, assume_unique=True)) >= self.least(n, m)


def _often(sets: list[np.ndarray], common: int) -> pa.RecordBatch:
    """(token, n): the shingles that at least `common` of the sets have. Empties the list, as its arrays are no longer needed."""
    every = np.concatenate([np.zeros(0, A.U), *sets])
    sets.clear()
    every.sort()
    tokens = np.unique(every[common - 1 :][every[common - 1 :] == every[: max(len(every) - common + 1, 0)]])
    n = np.searchsorted(every, tokens, "right") - np.searchsorted(every, tokens)
    return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])


def _frequent(docs: DataFrame, measure: Measure, common: int, listed: int, texts: int = 10_000, shingles: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): the shingles known to be frequent, sorted, and their ranks, the rarest first. At most `listed`.

    Texts come in small Arrow batches; what is counted at a time are the sets of about `texts` of them, with about `shingles` at most.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for b in batches:
            for t in b.column(0):
                sets.append(measure.shingles(t.as_py()))
                held += len(sets[-1])
            if len(sets) >= texts or held >= shingles:
                yield _often(sets, common)
                held = 0
        yield _often(sets, common)

    every = docs.select("text").mapInArrow(of, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    with batches_of(docs.sparkSession, BATCH):
        top = every.orderBy(F.desc("n"), "token").limit(listed).toPandas()
    tokens = top.token.to_numpy(np.int64).view(A.U)[::-1]
    order = np.argsort(tokens)
    return tokens[order], np.arange(len(tokens))[order]


def _parity(shingles: np.ndarray) -> np.ndarray:
    """One bit for each of as many buckets as the set has shingles, up to the next power of two: how many it has there, modulo 2.

    What two sets share cancels out, so the bits in which they differ are at most as many as the shingles in which they do.
    """
    size = 1 << max(int(len(shingles) - 1).bit_length(), 6)
    return (np.bincount((shingles & A.U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool)


def _differ(x: bytes, y: bytes) -> int:
    """Shingles that only one of two sets has, at least; the longer parity is folded to the shorter."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _sets(docs: DataFrame, measure: Measure, known) -> DataFrame:
    """(doc_id, did, th, s1, s2, n, central, prefix, parity): each document's set by a 128-bit signature, its size, how many of its
    shingles are known to be frequent, the places of its first shingles and its parity.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, rank = known.value
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                yield part(b.slice(start, 1000), frequent, rank)

    def part(b: pa.RecordBatch, frequent: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        out = []
        for t in b.column(3):
            s = measure.shingles(t.as_py())
            n = len(s)
            ends = np.array([0]), np.array([n])
            s1, s2 = (int(A.Hashes(x, i).of(*ends).view(np.int64)[0]) for i, x in enumerate((s, A.mix(s))))
            place = np.searchsorted(frequent, s)
            place[place == len(frequent)] = 0
            often = frequent[place] == s if len(frequent) else np.zeros(n, bool)
            last = np.sort(rank[place[often]])
            prefix = np.concatenate([_placed(s[~often]), last])[: measure.prefix(n)]
            out.append((s1, s2, n, len(last), prefix, np.packbits(_parity(s), bitorder="little").tobytes()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        numbers = [pa.array(c, pa.int64()) for c in cols[:4]]
        return pa.RecordBatch.from_arrays([*b.columns[:3], *numbers, pa.array(list(cols[4]), pa.list_(pa.int64())), pa.array(cols[5], pa.binary())], ["doc_id", "did", "th", "s1", "s2", "n", "central", "prefix", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "did", "th", "text").mapInArrow(of, f"doc_id {kind}, did long, th long, s1 long, s2 long, n long, central long, prefix array<long>, parity binary")


def _compared(pairs: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) of classes that are similar."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = None, np.zeros(0, A.U)
        for b in batches:
            hit = []
            for y, t, u in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if y != seen:  # pairs come sorted by b
                    seen, known = y, measure.shingles(u.as_py())
                hit.append(measure.similar(measure.shingles(t.as_py()), known))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    # the texts are dealt by cid once for both joins
    own = pairs.join(texts.alias("x"), F.col("a") == F.col("x.cid")).select("a", "b", F.col("x.text").alias("t"))
    both = own.join(texts.alias("y"), F.col("b") == F.col("y.cid")).select("a", "b", "t", F.col("y.text").alias("u"))
    return both.mapInArrow(of, "a long, b long")


def _alike(pairs: DataFrame, classes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) that can still link by their parities."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, m, y = (b.column(i) for i in range(2, 6))
            hit = [_differ(u.as_py(), v.as_py()) <= k - 2 * measure.least(k, 0) for u, v, k in zip(x, y, (np.asarray(n) + np.asarray(m)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    known = cut(classes.join(_members(pairs), "cid", "left_semi").select("cid", "n", "parity"), "parities")
    c = F.col
    own = pairs.join(known.alias("x"), c("a") == c("x.cid")).select("a", "b", c("x.n").alias("k"), c("x.parity").alias("own"))
    both = own.join(known.alias("y"), c("b") == c("y.cid")).select("a", "b", "k", "own", c("y.n").alias("m"), c("y.parity").alias("other"))
    return both.mapInArrow(of, "a long, b long")


def _labelled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """rows with the component of each class, itself if it has no link."""
    return rows.join(found.select(F.col("node").alias("cid"), F.col("component").alias("_c")), "cid", "left").withColumn(name, F.coalesce("_c", "cid")).drop("_c")


def _to_leaders(tokens: DataFrame, measure: Measure) -> DataFrame:
    """One pair (a: class, b: leader) for each class that shares much of its prefix with a leader.

    The leader of a shingle is the class with the most frequent shingles, as a text that many others are copies of has. Pairs
    with few shingles in common are left to `_queries`, which misses none.
    """
    # as a table of its own, so that a shingle that very many classes have is split in the join
    leaders = cut(tokens.groupBy("token").agg(F.max_by(F.struct("cid", "n"), F.struct("central", F.col("cid"))).alias("l")), "leaders")
    near = tokens.join(leaders, "token").where("cid <> l.cid")
    p = measure.percent
    near = near.where(p * F.greatest("n", "l.n") <= 100 * F.least("n", "l.n"))
    pairs = near.groupBy(F.col("cid").alias("a"), F.col("l.cid").alias("b"), "n").agg(F.count("*").alias("k"))
    pairs = pairs.where(F.col("k") * 1000 >= 6 * (100 - p) * F.col("n"))
    return pairs.groupBy("a").agg(F.max_by("b", F.struct("k", F.col("b"))).alias("b"))


def _chunks(tokens: DataFrame, found: DataFrame, pairs: DataFrame, chunk: int) -> DataFrame:
    """(cid, n, comp, home, part, size): the chunk of each class, and the size of its group: a leader and its classes."""
    led = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti").select(F.col("a").alias("node"), F.col("b").alias("component"))
    rows = cut(_labelled(_labelled(tokens.select("cid", "n").distinct(), found, "comp"), led, "home"), "grouped")
    # as a table of its own, so that a very large group is split in the join
    sizes = cut(rows.groupBy("home").agg(F.count("*").alias("size")), "sizes")
    return rows.join(sizes, "home").withColumn("part", F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / chunk)))


def _queries(tokens: DataFrame, chunks: DataFrame, measure: Measure) -> DataFrame:
    """(a, home, part, alone): each class a and each chunk that can hold a class similar to it; alone: the only class of a group."""
    lists = tokens.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("l")).join(chunks, "cid")
    row = lambda x, i: F.struct(x["pos"].alias("pos"), x["token"].alias("token"), *(F.coalesce(F.get("l", i - k)["token"], F.lit(_NONE)).alias(p) for k, p in enumerate(_BEFORE, 1)))
    rows = cut(lists.select("cid", "n", "comp", "home", "part", "size", F.inline(F.transform("l", row))), "rows")
    c, p = F.col, measure.percent
    # a chunk with one class is its own matrix
    alone = rows.where("size = 1").select("token", "home", "part", "size", (c("n") - c("pos")).alias("rest"), c("n").alias("n0"), c("n").alias("n1"), c("comp").alias("c0"), c("comp").alias("c1"), c("cid").alias("first"), *_BEFORE)
    union = rows.where("size > 1").groupBy("token", "home", "part", "size").agg(
        F.max(c("n") - c("pos")).alias("rest"), *(f(x).alias(y) for f, x, y in ((F.min, "n", "n0"), (F.max, "n", "n1"), (F.min, "comp", "c0"), (F.max, "comp", "c1"), (F.min, "cid", "first"))), *(F.lit(_NONE).alias(x) for x in _BEFORE)
    )
    matrix = alone.unionByName(union)
    q, g = rows.alias("q"), matrix.alias("g")
    other = ~((c("g.c0") == c("q.comp")) & (c("g.c1") == c("q.comp"))) & (c("g.first") < c("q.cid"))
    sizes = (p * c("q.n") <= 100 * c("g.n1")) & (p * c("g.n0") <= 100 * c("q.n"))
    # if this is the first shingle that the query shares with a member, they share no more than what follows in either
    needed = p * (c("q.n") + F.greatest(c("g.n0"), F.ceil(c("q.n") * p / 100)))
    places = ((100 + p) * (c("q.n") - c("q.pos")) >= needed) & ((100 + p) * c("g.rest") >= needed)
    # a pair that shares an earlier shingle was met there
    met = F.lit(False)
    for x in _BEFORE:
        met = met | ((c(f"g.{x}") != _NONE) & c(f"g.{x}").isin(*(c(f"q.{y}") for y in _BEFORE)))
    meet = q.join(g, (c("q.token") == c("g.token")) & other & sizes & places & ~met)
    return meet.select(c("q.cid").alias("a"), "g.home", "g.part", F.when(c("g.size") == 1, c("g.first")).alias("alone")).distinct()


class TokenGroupMatrix:
    """The union of a chunk's shingles with the members that have each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([np.zeros(0, A.U), *sets])
        order = np.argsort(every, kind="stable")
        self.member = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)

    def row(self, x: np.ndarray) -> np.ndarray:
        """Where the union has the shingles of x."""
        at = np.searchsorted(self.union, x)
        at = at[at < len(self.union)] if len(at) and at[-1] >= len(self.union) else at
        return at[self.union[at] == x[: len(at)]]

    def overlaps(self, at: np.ndarray) -> np.ndarray:
        """How many of these shingles each member has."""
        n = self.count[at]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[at], n)
        return np.bincount(self.member[inside], minlength=len(self.sizes))


def _opened(queries: DataFrame, chunks: DataFrame, texts: DataFrame, measure: Measure, at_once: int = 512) -> DataFrame:
    """Links (a, b) of queries to members of other components, one for each component, in chunks that their bound opens."""
    many = queries.groupBy("home", "part").agg(F.ceil(F.count("*") / at_once).alias("salts"))
    own = chunks.select(F.col("cid").alias("a"), F.col("comp").alias("own"))
    asks = queries.join(many, ["home", "part"]).select("a", "home", "part", F.pmod(F.xxhash64("a"), "salts").alias("salt")).join(own, "a").join(texts.alias("x"), F.col("a") == F.col("x.cid")).select("a", "home", "part", "salt", "own", "text")
    held = chunks.select("cid", "comp", "home", "part").join(many, ["home", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).drop("salts").join(texts, "cid").withColumnRenamed("text", "held")

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        matrix = TokenGroupMatrix([measure.shingles(t) for t in right.held])
        cids, comps, p = right.cid.to_numpy(), right.comp.to_numpy(), measure.percent
        out = []
        for a, own, t in zip(left.a, left.own, left.text, strict=True):
            x = measure.shingles(t)
            n = len(x)
            at = matrix.row(x)
            smallest = max(int(matrix.sizes.min()), -(-p * n // 100))  # of the members that can link
            if len(at) < measure.least(n, smallest):
                continue
            hit = ((100 + p) * matrix.overlaps(at) >= p * (n + matrix.sizes)) & (comps != own)
            for c in np.unique(comps[hit]):
                out.append((a, int(cids[hit & (comps == c)][0])))
        return pd.DataFrame(out, columns=["a", "b"])

    key = ["home", "part", "salt"]
    return asks.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(of, "a long, b long")


def join(docs: DataFrame, k: int = 4, percent: int = 85, chunk: int = 128, common: int = 8, listed: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, class_id, group_id, component_id) for every row of docs.

    class_id is the same for equal sets and group_id for the sets of one component (null for empty sets).
    """
    measure = Measure(k, percent)
    body = text_of(text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id).alias("did"), F.xxhash64(body).alias("th"), body.alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(_frequent(rows, measure, common, listed))
    sets = cut(_sets(rows, measure, known), "sets", BATCH)
    ids = sets.select("doc_id", "th", "s1", "s2", "n")
    classes = cut(_classes(sets.where("n > 0")).withColumn("cid", F.monotonically_increasing_id()), "classes")

    tokens = classes.select("cid", "n", "central", F.posexplode("prefix").alias("pos", "token"))
    shared = cut(tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "shared")
    met = cut(Bits(shared, "token").may_hold(tokens, "token").join(shared, "token"), "met")
    discard(shared)

    pairs = cut(_to_leaders(met, measure), "pairs")
    texts = _texts(rows, classes, _members(pairs))
    links = cut(_compared(pairs, texts, measure), "similar", BATCH)
    chunks = cut(_chunks(met, components(links), pairs, chunk), "chunks")
    asks = cut(_queries(met, chunks, measure), "queries")
    discard(met, texts)
    single = cut(_alike(asks.where("alone IS NOT NULL").select("a", F.col("alone").alias("b")), classes, measure), "singles", BATCH)
    many = asks.where("alone IS NULL").select("a", "home", "part")
    held = chunks.join(many.select("home", "part").distinct(), ["home", "part"], "left_semi")
    texts = _texts(rows, classes, _members(single).unionByName(many.select(F.col("a").alias("cid"))).unionByName(held.select("cid")).distinct())
    more = cut(_compared(single, texts, measure).unionByName(_opened(many, chunks, texts, measure)), "similar", BATCH)
    discard(texts)
    final = components(links.unionByName(more))

    named = classes.select("s1", "s2", "cid", "least_id").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    found = cut(named.join(least, "comp").select("s1", "s2", F.col("cid").alias("class_id"), F.col("comp").alias("group_id"), "component_id"), "found")
    out = ids.join(found, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "class_id", "group_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(sets: DataFrame) -> DataFrame:
    """(s1, s2, n, least_id, did, th, central, prefix, parity): one row for each different set.

    Sets that surely come once are classes as they are; only the others are shuffled with what belongs to them.
    """
    key = ["s1", "s2", "n"]
    again = cut(sets.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key), "again")
    bits = Bits(again, *key)
    rest = ["central", "prefix", "parity"]
    once = bits.surely_lacks(sets, *key).select(*key, F.col("doc_id").alias("least_id"), "did", "th", *rest)
    many = bits.may_hold(sets, *key).groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.min(F.struct("did", "th")).alias("at"), *(F.any_value(x).alias(x) for x in rest))
    return once.unionByName(many.select(*key, "least_id", "at.did", "at.th", *rest))


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()


def _texts(rows: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the wanted classes."""
    ids = cut(wanted.join(classes.select("cid", "did", "th"), "cid"), "wanted")
    some = Bits(ids, "did", "th").may_hold(rows.select("did", "th", "text"), "did", "th")
    # equal rows share a key, and each key is of one class
    return cut(some.join(ids, ["did", "th"]).dropDuplicates(["did", "th"]).select("cid", "text"), "texts")


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row for each component (the least id, then the least hash of the text) and all rows without words.

    Rows with one id and one text are one document. Rows whose key is surely none of a document that goes or comes again
    pass where they lie; only the others are shuffled.
    """
    found = join(docs, k, percent, doc_id=doc_id, text=text).where("group_id IS NOT NULL")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.groupBy("group_id").agg(F.min(key).alias("first"))
    keys = found.groupBy("group_id", "doc_id", "text_hash").agg(F.count("*").alias("copies")).join(first, "group_id").select(F.xxhash64("doc_id").alias("did"), F.col("text_hash").alias("th"), "copies", key.eqNullSafe(F.col("first")).alias("stays"))
    doubtful = cut(keys.where("NOT stays OR copies > 1").select("did", "th", "stays"), "doubtful")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(doc_id).alias("did"), F.xxhash64(text_of(text)).alias("th"))
    bits = Bits(doubtful, "did", "th")
    settled = bits.may_hold(rows, "did", "th").join(doubtful, ["did", "th"], "left")
    alone = settled.where("stays IS NULL").select("row")
    again = settled.where("stays").dropDuplicates(["did", "th"]).select("row")
    return bits.surely_lacks(rows, "did", "th").select("row").unionByName(alone).unionByName(again).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the component of every document under Jaccard links."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
