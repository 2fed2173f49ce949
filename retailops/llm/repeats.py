"""Which windows of a corpus occur twice: the part that substring and suffix-array dedup share.

1. Every text is cut into anchored segments (`anchors`). Counting the occurrences of each anchor, with partial sums before the
   shuffle, leaves the anchors that occur twice or more; without one of those, no window repeats.
2. The different segments of such an anchor, each once with its number of occurrences, go to a shard: there the operator's
   own index decides which windows of which segment repeat. A shard has about `per_shard` segments. For an anchor with more than
   `hot` different segments, too many for one shard, there is an exact way window by window: the windows' 128-bit hashes are
   counted with partial sums.
3. The spans found are gathered by document, which is cut in a final join; documents that surely have none (`common.Bits`) are
   not shuffled for it.

Segments are equal if their anchors' and their own 64-bit hashes are.
A document is known by two 64-bit hashes over its id and text, so equal rows share their spans and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import Bits, cut, discard

KEYS = ["h1", "h2"]
#: Rows of an Arrow batch that are held as Python objects at a time.
_ROWS = 500
_SEGMENTS = "h1 long, h2 long, anchor long, seg long, lo int, hi int, off int"
_CONTENT = "shard int, anchor long, seg long, copies long, windows int, off int, content binary"

#: (contents, copies, windows, anchors' places, anchors) -> for each segment the repeated windows as a Boolean array.
Judge = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]


class Unit:
    """What a symbol is: a byte, or a word of a text. A segment's content is its bytes, or its words joined by one space.

    per_shard: segments of a shard, about; what an index over so many takes is the memory of a task.
    """

    def __init__(self, kind: str, window: int, gram: int, per_shard: int = 1500):
        self.words, self.window, self.gram, self.per_shard = kind == "words", window, gram, per_shard

    def symbols(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"".join(data), np.uint8)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        if self.words:
            symbols, counts, _, _ = A.word_symbols(flat, sizes)
            return symbols, counts
        return A.BYTES[flat], sizes

    def cut(self, text: bytes) -> np.ndarray:
        """The symbols of one text of any length."""
        return A.symbols_of(text) if self.words else A.BYTES[np.frombuffer(text, np.uint8)]

    def units(self, text: bytes) -> bytes | list[bytes]:
        return text.split() if self.words else text

    def join(self, units: bytes | list[bytes]) -> bytes:
        return b" ".join(units) if self.words else units


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            yield b.slice(start, _ROWS)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x or b"" for x in column.to_pylist()]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text as UTF-8, h1, h2); null texts are empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.encode(body, "UTF-8").alias("text"), F.xxhash64(F.col(doc_id), body).alias("h1"), F.xxhash64(F.lit(17), body, F.col(doc_id)).alias("h2"))


def _cut_into_segments(docs: DataFrame, unit: Unit) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield from part(b)

    def part(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, k = unit.window, unit.gram
        texts = _utf8(b.column(0))
        keys = [b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)]
        for group, start in A.pieces([len(x) for x in texts], w):
            text = texts[group[0]]
            if len(text) > A.BATCH:  # alone, and cut by bytes; words are cut by words
                if unit.words and not start:
                    yield from long(unit.cut(text), keys[0][group[0]], keys[1][group[0]])
                elif not unit.words:
                    yield piece(A.BYTES[np.frombuffer(text, np.uint8, min(A.BATCH, len(text) - start), start)], keys[0][group[0]], keys[1][group[0]], start)
                continue
            symbols, sizes = unit.symbols([texts[i] for i in group])
            s = A.segments(symbols, sizes, w, k)
            at = np.array(group)[s["seq"]]
            yield rows(keys[0][at], keys[1][at], s, 0)

    def long(symbols: np.ndarray, h1: int, h2: int) -> Iterator[pa.RecordBatch]:
        for _, start in A.pieces([len(symbols)], unit.window):
            yield piece(symbols[start : start + A.BATCH], h1, h2, start)

    def piece(symbols: np.ndarray, h1: int, h2: int, start: int) -> pa.RecordBatch:
        s = A.segments(symbols, np.array([len(symbols)]), unit.window, unit.gram)
        return rows(np.full(len(s["lo"]), h1), np.full(len(s["lo"]), h2), s, start)

    def rows(h1, h2, s, start) -> pa.RecordBatch:
        place = [pa.array((s[x] + start).astype(np.int32)) for x in ("lo", "hi", "off")]
        return pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *(pa.array(s[x].view(np.int64)) for x in ("anchor", "seg")), *place], ["h1", "h2", "anchor", "seg", "lo", "hi", "off"])

    return docs.select("text", *KEYS).mapInArrow(of, _SEGMENTS)


def spans(docs: DataFrame, unit: Unit, judge: Judge, per_shard: int | None = None, hot: int = 5000) -> DataFrame:
    """(h1, h2, spans): for each document with repeated windows the symbols that they cover, as an array of (start, end), unsorted.

    docs: the result of `keyed`.
    """
    w = unit.window
    every = cut(_cut_into_segments(docs, unit), "segments")
    counted = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    again = cut(Bits(counted, "anchor").may_hold(every, "anchor").join(counted, "anchor"), "repeated")
    discard(every, counted)

    # the different segments of each anchor, each at one place in one document
    unlike = again.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct(*KEYS, "lo", "hi", "off")).alias("at"))
    crowd = again.select("anchor", "seg").distinct().groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot)
    unlike = cut(unlike.join(crowd, "anchor", "left").select("anchor", "seg", "copies", F.col("m").isNotNull().alias("hot"), "at.*"), "unlike")
    shards = max(1, -(-unlike.count() // (per_shard or unit.per_shard)))

    def contents(some: DataFrame) -> DataFrame:
        wanted = some.groupBy(*KEYS).agg(F.collect_list(F.struct("anchor", "seg", "copies", "lo", "hi", "off")).alias("wanted"))
        holders = Bits(some, *KEYS).may_hold(docs.select("text", *KEYS), *KEYS).join(wanted, KEYS)
        return _contents(holders.dropDuplicates(KEYS), unit, shards)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        found = judge(list(pdf.content), pdf.copies.to_numpy(), pdf.windows.to_numpy(), pdf.off.to_numpy(), pdf.anchor.to_numpy())
        out = [(a, s, *r) for a, s, f in zip(pdf.anchor, pdf.seg, found, strict=True) for r in runs(f)]
        return pd.DataFrame(out, columns=["anchor", "seg", "first", "last"])

    judged = contents(unlike.where("not hot")).groupBy("shard").applyInPandas(of, "anchor long, seg long, first int, last int")
    windows = _windows(contents(unlike.where("hot")), unit)
    twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).where("n > 1")
    crowded = windows.join(twice, ["w1", "w2"]).select("anchor", "seg", F.col("at").alias("first"), F.col("at").alias("last"))
    # as a table of its own, so that a segment with very many copies is split in the join
    found = cut(judged.unionByName(crowded).groupBy("anchor", "seg").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "verdicts")
    decided = again.select(*KEYS, "anchor", "seg", "lo").join(found, ["anchor", "seg"]).select(*KEYS, "lo", F.explode("runs").alias("r")).select(*KEYS, (F.col("lo") + F.col("r.first")).alias("start"), (F.col("lo") + F.col("r.last") + w).alias("end"))
    out = cut(decided.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    discard(again, unlike, found)
    return out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs of True as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _contents(docs: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """The content of each wanted segment."""
    names = ["shard", "anchor", "seg", "copies", "windows", "off", "content"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, wanted = b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("wanted"))
            out: list[tuple] = []
            size = 0
            for text, items in zip(texts, wanted, strict=True):
                units = unit.units(text.as_py())
                for x in items.as_py():
                    content = unit.join(units[x["lo"] : x["hi"] + unit.window])
                    out.append((int(np.uint64(x["anchor"] & (2**64 - 1)) >> np.uint64(20)) % shards, x["anchor"], x["seg"], x["copies"], x["hi"] - x["lo"] + 1, x["off"] - x["lo"], content))
                    size += len(content)
                if size > 8 << 20:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(of, _CONTENT)


def _windows(content: DataFrame, unit: Unit) -> DataFrame:
    """Every window of the segments of hot anchors by its 128-bit hash."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                symbols = unit.cut(r["content"])
                lo = np.arange(r["windows"])
                w1, w2 = (A.Hashes(s, i).of(lo, lo + unit.window) for i, s in enumerate((symbols, A.mix(symbols))))
                same = lambda x: pa.array(np.full(len(lo), x, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), same(r["anchor"]), same(r["seg"]), same(r["copies"]), pa.array(lo.astype(np.int32))], ["w1", "w2", "anchor", "seg", "copies", "at"])

    return content.select("anchor", "seg", "copies", "windows", "content").mapInArrow(of, "w1 long, w2 long, anchor long, seg long, copies long, at int")


def merged(found: list[dict] | None, limit: int) -> list[tuple[int, int]]:
    """Sorted disjoint spans, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], min(x["end"], limit)) for x in found or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def with_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (of `keyed`) and the spans of each, null where it has none."""
    bits = Bits(found, *KEYS)
    none = bits.surely_lacks(docs, *KEYS).withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
    return bits.may_hold(docs, *KEYS).join(found, KEYS, "left").select(*docs.columns, "spans").unionByName(none)
