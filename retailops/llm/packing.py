"""Packing documents into sequences of a fixed number of tokens.

Documents become token ids and an end token. A document that is longer than a sequence is cut into full sequences, with what
is over as its first piece; all other documents stay whole. Pieces are dealt at random to groups of about `group` pieces.
Within a group best fit decreasing gives the first packing; then a swap-based local search takes the least full sequence and
moves its pieces to others, or exchanges one for one, two for one or one for two, whenever that raises the sum of the squared
fills, until it is empty or nothing helps. A group stops at the bound that no packing can beat, tokens / length rounded up, so
the packing has less than one sequence a group more than needed wherever the search gets there.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are packed as rows of their own;
empty tables give no pieces; further columns are dropped by `tokenized` and kept by `packed`; texts are encoded whole.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH, cut

LENGTH, END = 1024, 2
#: Letters of the texts that the quick splitter knows: ASCII and the Latin letters up to U+024F.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
_STRANGE = re.compile(f"[^\\x00-\\x7f{_LETTER}]|<\\|endoftext\\|>")
_SPLIT = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\t-\r {_LETTER}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


#: Bytes of ids that a task collects before it hands them on.
_HELD = 4 << 20


class Encoder:
    """Ids as little-endian unsigned 32-bit numbers. Merges never cross the tokenizer's pre-tokens, so each of these is encoded once while it is known."""

    def __init__(self, vocabulary: str, most: int = 200_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        letters = _byte_letters()

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= most:
                    self.clear()
                # of printable ASCII only the space has another letter
                plain = word.isascii() and word.isprintable()
                found = tokenizer.model.tokenize(word.replace(" ", letters[32]) if plain else word.encode().decode("latin-1").translate(letters))
                ids = self[word] = array("I", [x.id for x in found]).tobytes()
                return ids

        self.tokenizer, self.known = tokenizer, Known()

    def encode(self, text: str) -> bytes:
        if _STRANGE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.known.__getitem__, _SPLIT.findall(text)))


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


@functools.cache
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for each Python worker, which keeps the vocabulary from task to task."""
    return Encoder(vocabulary)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pieces(batches: Iterator[pa.RecordBatch], encoder: Encoder, uid: int, length: int, end: int) -> Iterator[pa.RecordBatch]:
    """The pieces of batches of (id, text), numbered from uid, in batches of about _HELD bytes of ids, or one document if that has more."""

    def batch() -> pa.RecordBatch:
        cols = np.array(rows, np.int64).reshape(-1, 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[:, 0]), b.column(0).take(pa.array(source, pa.int64())), pa.array(cols[:, 1].astype(np.int32)), pa.array(cols[:, 2]), pa.array(cols[:, 3]), pa.array(ids, pa.binary())],
            ["uid", "doc_id", "piece", "start", "length", "ids"],
        )

    for b in batches:
        rows, ids, source, held = [], [], [], 0
        for i, t in enumerate(b.column(1)):
            body = encoder.encode(t.as_py() or "") + end.to_bytes(4, "little")
            n = len(body) // 4
            at, size = 0, n % length or length
            if n <= length:
                size = n
            for piece in range(-(-n // length)):
                rows.append((uid, piece, at, size))
                ids.append(body[4 * at : 4 * (at + size)])
                source.append(i)
                uid += 1
                at, size = at + size, length
            held += len(body)
            if held >= _HELD:
                yield batch()
                rows, ids, source, held = [], [], [], 0
        yield batch()


def tokenized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids): the pieces of every document; uid is a number of its own for each piece."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary or vocabulary_path())
        yield from _pieces(batches, encoder, TaskContext.get().partitionId() << 36, length, end)
        encoder.known.clear()  # the worker goes on to other work

    return docs.select(doc_id, text).mapInArrow(of, f"uid long, doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each piece by best fit decreasing."""
    order = np.argsort(-sizes, kind="stable")
    where = np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = n = 0  # rooms: bit r is set if some bin has r tokens free
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = rooms >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                rooms &= ~(1 << r)
        else:
            r, b, n = length, n, n + 1
        where[i] = b
        by_room[r - s].append(b)
        rooms |= 1 << (r - s)
    return where


def local_search(sizes: np.ndarray, where: np.ndarray, length: int, patience: int = 40) -> np.ndarray:
    """Moves and exchanges that raise the sum of squared fills, to empty bins; returns the bin of each piece.

    It ends at the least possible number of bins, or once none of the `patience` least full bins can be improved.
    """
    where = where.copy()
    fill = np.bincount(where, sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // length)
    stuck: set[int] = set()
    while np.count_nonzero(fill) > least and len(stuck) < patience:
        order = [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < length and b not in stuck]
        if len(order) < 2:
            break
        b = order[0]
        if not _improve(sizes, where, fill, b, length):
            stuck.add(b)
        elif fill[b]:
            continue
        else:
            stuck.clear()
    return where


def _improve(sizes: np.ndarray, where: np.ndarray, fill: np.ndarray, b: int, length: int) -> bool:
    """One move or exchange between bin b and a fuller one."""
    own = np.flatnonzero(where == b)
    room = length - fill
    other = np.flatnonzero((where != b) & (room[where] > 0) & (fill[where] >= fill[b]))
    if not len(other):
        return False

    def give(gone: list[int], got: list[int], to: int) -> bool:
        gain = int(sizes[gone].sum() - sizes[got].sum())
        where[gone], where[got] = to, b
        fill[to] += gain
        fill[b] -= gain
        return True

    bins = np.unique(where[other])
    mine = own[np.argsort(-sizes[own], kind="stable")].tolist()
    for x in mine:  # a move, to the tightest bin
        fit = bins[room[bins] >= sizes[x]]
        if len(fit):
            return give([x], [], int(fit[np.argmin(room[fit])]))
    space = room[where[other]]
    singles = [([x], int(sizes[x])) for x in mine]
    pairs = [([x, y], int(sizes[x] + sizes[y])) for k, x in enumerate(mine) for y in mine[k + 1 :]]
    best, found = 0, None
    for gone, size in singles + pairs:  # one for one, two for one
        gain = size - sizes[other]
        gain = np.where((gain > 0) & (gain <= space), gain, 0)
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = int(gain[k]), (gone, [int(other[k])], int(where[other[k]]))
    if found:
        return give(*found)
    by_bin = other[np.argsort(where[other], kind="stable")]
    for step in range(1, 4):  # one for two that lie in one bin
        one, two = by_bin[:-step], by_bin[step:]
        same = where[one] == where[two]
        one, two = one[same], two[same]
        for gone, size in singles:
            gain = size - sizes[one] - sizes[two]
            gain = np.where((gain > 0) & (gain <= room[where[one]]), gain, 0)
            if len(gain) and gain.max() > best:
                k = int(gain.argmax())
                best, found = int(gain[k]), (gone, [int(one[k]), int(two[k])], int(where[one[k]]))
    return give(*found) if found else False


def packed(pieces: DataFrame, length: int = LENGTH, group: int = 8192) -> DataFrame:
    """pieces (with uid and length, any other columns) and their sequence_id and offset."""
    small = pieces.where(F.col("length") < length)
    groups = max(1, -(-small.count() // group))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable").reset_index(drop=True)
        sizes = pdf.length.to_numpy(np.int64)
        where = local_search(sizes, best_fit(sizes, length), length)
        order = np.lexsort((pdf.uid.to_numpy(), where))
        ends = np.cumsum(sizes[order])
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        begin = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(pdf), np.int64)
        offset[order] = ends - sizes[order] - begin
        head = pdf.uid.to_numpy()[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        sequence = np.empty(len(pdf), np.int64)
        sequence[order] = head  # a sequence is named after its first piece
        return pdf.drop(columns="_group").assign(sequence_id=sequence, offset=offset)

    dealt = small.withColumn("_group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    done = dealt.groupBy("_group").applyInPandas(of, f"{fields}, sequence_id long, offset long")
    return done.unionByName(pieces.where(F.col("length") >= length).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))


def digests(docs: DataFrame, **how) -> DataFrame:
    """The packing of docs with a checksum of each piece's ids instead of the ids."""
    pieces = tokenized(docs, **how).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packed(cut(pieces, "pieces", BATCH), how.get("length", LENGTH)).drop("uid")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: all documents packed into sequences of 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
