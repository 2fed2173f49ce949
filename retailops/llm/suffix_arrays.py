"""Suffix-array dedup by a logarithmic family of indexes.

The corpus is cut into anchored segments and dealt to shards so that equal 200-byte strings are in one shard (`repeats`). A
shard indexes its segments in batches. A batch gets two sorted arrays: the suffixes that start at the segments' anchors, and
the reversed prefixes that end there, each 200 bytes long at most. It is merge-scanned against every level of the family:
in the merged order, neighbours' longest common prefixes tell for each of the 161 places that an anchor can have in a 200-byte
string which of these strings agree on both sides of the anchor. Then the batch becomes a level, and levels of equal size
merge, so that a shard of n batches has about log2(n) levels. The indexes compare bytes; only copies of a whole segment are told
by hashes.

Defined results: a null or empty text has no bytes and nothing is removed; one row comes out for each row in, and equal rows
count as copies of each other; null ids, empty tables and further columns make no difference; texts are worked on whole. What is
kept may begin or end within a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAM = 200, 40
PLACES = WINDOW - GRAM + 1
BATCH = 256


@dataclass
class Level:
    """Segments in the order of their suffixes; row numbers refer to the shard."""

    rows: np.ndarray
    right: np.ndarray  # anchor and suffix, as fixed-width bytes
    left: np.ndarray  # anchor and reversed prefix, in the same order of rows


def _matrix(parts: list[bytes], anchor: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(parts), 8 + width), np.uint8)
    out[:, :8] = anchor.astype(">i8").view(np.uint8).reshape(-1, 8)
    for row, p in zip(out, parts, strict=True):
        row[8 : 8 + len(p)] = np.frombuffer(p, np.uint8)
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """Positions in the order of the rows' bytes; sorted runs are only merged."""
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def _common(keys: np.ndarray) -> np.ndarray:
    """Longest common prefixes of neighbours."""
    unlike = keys[1:] != keys[:-1]
    return np.where(unlike.any(axis=1), unlike.argmax(axis=1), keys.shape[1])


class Family:
    """The levels of one shard and, for each segment, which of its windows repeat."""

    def __init__(self, copies: np.ndarray, windows: np.ndarray, off: np.ndarray):
        self.windows, self.off = windows, off
        self.levels: list[Level] = []
        self.twice = np.zeros((len(off), PLACES), bool)  # by the anchor's place in the window
        self.twice[copies > 1] = True

    def add(self, rows: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        order = _order(right)
        new = Level(rows[order], right[order], left[order])
        self._scan(new)
        for level in self.levels:
            self._scan(self._merged(level, new))
        while self.levels and len(self.levels[-1].rows) <= len(new.rows):
            new = self._merged(self.levels.pop(), new)
        self.levels.append(new)

    @staticmethod
    def _merged(a: Level, b: Level) -> Level:
        right = np.concatenate([a.right, b.right])
        order = _order(right)
        return Level(np.concatenate([a.rows, b.rows])[order], right[order], np.concatenate([a.left, b.left])[order])

    def _scan(self, level: Level) -> None:
        """Marks the windows that two segments of the level have in common."""
        m = len(level.rows)
        if m < 2:
            return
        after = _common(level.right)
        by_left = _order(level.left)
        before = _common(level.left[by_left])
        first, last = (self.off - self.windows + 1)[level.rows], self.off[level.rows]
        same_r, same_l = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for place in range(max(int(first.min()), 0), min(int(last.max()) + 1, PLACES)):
            own = np.flatnonzero((first <= place) & (place <= last))
            if len(own) < 2:
                continue
            np.cumsum(after < 8 + WINDOW - place, out=same_r[1:])
            same_l[by_left[1:]] = np.cumsum(before < 8 + place)
            same_l[by_left[0]] = 0
            pair = same_r[own] * m + same_l[own]
            order = np.argsort(pair, kind="stable")
            equal = pair[order[1:]] == pair[order[:-1]]
            hit = np.zeros(len(own), bool)
            hit[order[1:][equal]] = True
            hit[order[:-1][equal]] = True
            self.twice[level.rows[own[hit]], place] = True

    def repeated(self, i: int) -> np.ndarray:
        """For each window of segment i in order: whether it repeats."""
        return self.twice[i, self.off[i] - np.arange(self.windows[i])]


def judge(contents: list[bytes], copies: np.ndarray, windows: np.ndarray, off: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """The verdict of a shard, for `repeats.spans`."""
    family = Family(copies, windows.astype(np.int64), off.astype(np.int64))
    for start in range(0, len(contents), BATCH):
        rows = np.arange(start, min(start + BATCH, len(contents)))
        right = _matrix([contents[i][off[i] :] for i in rows], anchor[rows], WINDOW)
        left = _matrix([contents[i][: off[i]][::-1] for i in rows], anchor[rows], PLACES - 1)
        family.add(rows, right, left)
    return [family.repeated(i) for i in range(len(contents))]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the kept bytes of every document."""
    rows = repeats.keyed(docs, doc_id, text)
    found = repeats.with_spans(rows, repeats.spans(rows, repeats.Unit("bytes", WINDOW, GRAM), judge))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats.slices(batches):
            kept, numbers = [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                body = t.as_py()
                cut = repeats.merged(s.as_py(), len(body))
                left, done = [], 0
                for start, end in cut:
                    left.append(body[done:start])
                    done = end
                kept.append(b"".join(left) + body[done:])
                numbers.append((len(body), len(body) - len(kept[-1]), len(cut)))
            counts = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "spans").mapInArrow(of, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what suffix-array dedup keeps of every document."""
    kept = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256) AS kept_sha256")
