"""Secret scans by a trigram inverted index.

Every rule's regex gives a Boolean trigram query (`trigrams.query_of`). The index is sharded by document, as Spark deals
the table out: for each slice of an Arrow batch it maps every trigram that some rule asks for to its posting list (the batch's texts
that hold it). A rule's postings are intersected and united as its query says, and only the candidates are searched with the
regex itself; a rule without mandatory trigrams is run over all texts. Nothing is shuffled, and memory is that of a batch.

Defined results: a null text counts as empty and has no secrets; repeated rows, null ids, empty tables and further columns
make no difference (one row out for each row in, further columns kept); long texts are searched whole. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .trigrams import query_of


@dataclass(frozen=True)
class SecretRule:
    """A secret is group `group` of a match if that has `least` characters or more; its span is that of the whole match."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


#: Only the letters of the keywords may be in either case.
BASE = (
    SecretRule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    SecretRule("access", r"AKIA[A-Z0-9]+", least=16),
    SecretRule("hex", r"[0-9a-f]{32,}", least=32),
)
MORE = (
    SecretRule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    SecretRule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    SecretRule("signed_token", r"eyJ[A-Za-z0-9_-]{16,}\.eyJ[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
)
RULES = BASE + MORE

SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


#: Texts that are indexed at a time: bounds the memory of a task.
_ROWS = 500


@lru_cache(maxsize=2)
def _numbers(wanted: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number): the row of each pair of bytes, 0 for those that begin no wanted trigram; by row and third byte the number of the trigram, from 1, else 0."""
    pairs = sorted({g[:2] for g in wanted})
    row = np.zeros(1 << 16, np.uint16)
    for k, g in enumerate(pairs, 1):
        row[(ord(g[0]) << 8) | ord(g[1])] = k
    number = np.zeros((len(pairs) + 1) << 8, np.uint16)
    for k, g in enumerate(wanted, 1):
        number[(int(row[(ord(g[0]) << 8) | ord(g[1])]) << 8) | ord(g[2])] = k
    return row, number


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            yield b.slice(start, _ROWS)


class BatchIndex:
    """Posting lists of one batch of texts for the trigrams that the rules ask for."""

    def __init__(self, texts: list[str], wanted: list[str]):
        self.rows = len(texts)
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 2)
        data = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8) if raw else np.zeros(0, np.uint8)
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        codes = fold[data]
        row, number = _numbers(tuple(wanted))
        which = number[(row[(codes[:-2].astype(np.uint16) << 8) | codes[1:-1]].astype(np.uint32) << 8) | codes[2:]]
        at = np.flatnonzero(which)
        found = np.unique(which[at].astype(np.int64) * max(self.rows, 1) + np.searchsorted(ends, at, side="right"))
        self.postings = {g: found[(found >= k * self.rows) & (found < (k + 1) * self.rows)] - k * self.rows for k, g in enumerate(wanted, 1)}

    def candidates(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        out = np.zeros(self.rows, bool)
        for every in query:
            one = None
            for g in sorted(every, key=lambda g: len(self.postings[g])):
                one = self.postings[g] if one is None else np.intersect1d(one, self.postings[g], assume_unique=True)
                if not len(one):
                    break
            out[one] = True
        return np.flatnonzero(out)


def find(texts: list[str], rules=RULES) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, by start and then in the order of the rules."""
    queries = [query_of(r.pattern, r.flags) for r in rules]
    wanted = sorted({g for q in queries if q for every in q for g in every})
    if len(wanted) >= 1 << 16:
        raise ValueError("the rules ask for more than 65535 trigrams; scan with fewer rules at a time")
    index = BatchIndex(texts, wanted)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        search = re.compile(rule.pattern, rule.flags)
        for i in index.candidates(query).tolist():
            for m in search.finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    return [[(rules[k].kind, s, e) for s, k, e in sorted(x)] for x in out]


def scan(docs: DataFrame, text: str = "text", rules=RULES, into: str = "spans") -> DataFrame:
    """docs and, in an array column, each text's secrets as (kind, start, end) in code points."""
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, SPAN)])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            texts = [x or "" for x in b.column(b.schema.get_field_index(text)).to_pylist()]
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in find(texts, rules)], kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, spans], [*b.schema.names, into])

    return docs.mapInArrow(of, schema)


def redact(docs: DataFrame, text: str = "text", rules=RULES, mark: str = "[SECRET]", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with every secret span (overlapping ones as one) replaced by mark; a null text stays null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            at = b.schema.get_field_index(text)
            texts = b.column(at).to_pylist()
            out = []
            for t, spans in zip(texts, find([x or "" for x in texts], rules), strict=True):
                done, parts = 0, []
                for _, s, e in spans:
                    if s >= done:
                        parts += [t[done:s], mark]
                    done = max(done, e)
                out.append(t if not spans else "".join(parts) + t[done:])
            cols = list(b.columns)
            cols[at] = pa.array(out, b.schema.field(at).type)
            k = b.schema.get_field_index(n_chars) if n_chars else -1
            if k >= 0:
                cols[k] = pa.array([c if new == old else len(new) for c, new, old in zip(cols[k].to_pylist(), out, texts, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return docs.mapInArrow(of, docs.schema)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, the base counts and hash, and all spans as text, from the result of `scan`."""
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: secrets of every document."""
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
