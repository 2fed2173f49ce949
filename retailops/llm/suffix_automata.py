"""Substring dedup by suffix automata.

The reference is the corpus itself, cut into shards so that equal windows are in one shard (`repeats`): every shard holds the
different segments of many anchors, and its suffix automaton, of bounded size, exists only in the task that works on the
shard; sending all automata to all executors would be a broadcast that grows with the corpus. One automaton is built over the
words of all the shard's segments, and every state gets the number of places in the corpus at which its strings end (up to two for a
segment: whole copies of it are counted by two hashes). A window lies in one segment only, so no place counts twice. The segments
are then streamed through it: at each word the matching statistic is the longest string that ends there and occurs at
another place as well, and where it reaches the window, the window is repeated. Maximal runs of such windows are removed.

Defined results: a null or empty text has no words and nothing is removed; one row comes out for each row in, and equal rows
count as copies of each other; null ids, empty tables and further columns make no difference; texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

WINDOW, GRAM = 35, 8
#: Segments of an automaton, about: one has a few hundred bytes for each of their words.
PER_SHARD = 400


class Automaton:
    """The suffix automaton of several sequences, with occurrences weighted by sequence."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.len = [0]
        self.count = [0]

    def add(self, sequence: list[int], weight: int) -> None:
        nxt, link, ln, count = self.next, self.link, self.len, self.count
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if ln[q] == ln[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
                count[last] += weight
                continue
            cur = len(ln)
            nxt.append({})
            ln.append(ln[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[cur] = q if ln[q] == ln[p] + 1 else self._clone(p, c, q)
            last = cur

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(self.len)
        nxt.append(nxt[q].copy())
        self.len.append(self.len[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def settle(self) -> None:
        """Counts of a state become those of all states whose strings end in its own."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, sequence: list[int], window: int) -> np.ndarray:
        """For each window of a sequence in the automaton: whether the matching statistic against other places reaches it."""
        nxt, link, ln, count = self.next, self.link, self.len, self.count
        out = np.zeros(len(sequence) - window + 1, bool)
        state = size = 0
        for i, c in enumerate(sequence):
            while c not in nxt[state]:
                state = link[state]
                size = ln[state]
            state = nxt[state][c]
            size += 1
            while state and count[state] < 2:  # what is here only leads to the longest suffix that is elsewhere, too
                state = link[state]
                size = ln[state]
            if size >= window:
                out[i - window + 1] = True
        return out


def judge(contents: list[bytes], copies: np.ndarray, windows: np.ndarray, off: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """The verdict of a shard, for `repeats.spans`: one automaton of all its segments, and every segment streamed through it."""
    numbers: dict[bytes, int] = {}
    sequences = [[numbers.setdefault(w, len(numbers)) for w in c.split()] for c in contents]
    automaton = Automaton()
    for s, n in zip(sequences, copies.tolist(), strict=True):
        automaton.add(s, min(n, 2))
    automaton.settle()
    return [automaton.repeated(s, WINDOW) if len(s) >= WINDOW else np.zeros(0, bool) for s in sequences]


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the kept words of every document, joined by one space."""
    rows = repeats.keyed(docs, doc_id, text)
    unit = repeats.Unit("words", WINDOW, GRAM, PER_SHARD)
    found = repeats.with_spans(rows, repeats.spans(rows, unit, judge))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in repeats.slices(batches):
            kept, n, gone = [], [], []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                body = t.as_py()
                words = body.split()
                cut = repeats.merged(s.as_py(), len(words))
                left, done = [], 0
                for start, end in cut:
                    left += words[done:start]
                    done = end
                kept.append(b" ".join(left + words[done:]).decode("utf-8", "surrogatepass"))
                n.append(len(words))
                gone.append(sum(e - s for s, e in cut))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "spans").mapInArrow(of, f"doc_id {kind}, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: what substring dedup keeps of every document."""
    kept = remove(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")
