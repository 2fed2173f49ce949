"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A benchmark item is cut into windows of
`window` consecutive words; an item with fewer, but not none, is one window. A document word is hit if it stands in an
occurrence of a window. A window can occur only where its rarest shingle (of `shingle` words; a shorter window is its own)
does, so of the shingles of a window, ordered by rarity in the benchmark and then by length, one is the necessary prefix.
Document shingles are joined with the prefixes; the position of the prefix in its window and the lengths of both bound where
the window can lie; there the words of the document are compared with those of the window. The join, the bounds and the
comparison are one stage over the documents.

The windows are broadcast in blocks of about `block_mb`: a benchmark within that size is one block, a larger one is worked
off in several passes, so the broadcast never grows with the data. Windows are dealt to blocks by hash, also copies of one.

Defined results: a null text has no words; one row comes out for each row in, also for repeated rows and ids (rows with the
same id but other texts are kept apart by the text's hash) and for null ids; items without words occur nowhere; the words of an
item with a null id hit as any others do, but there is no id to list or count; equal items each count; empty tables give no
rows or no hits; further columns of either table are ignored by `report` and kept as they are by `clean`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_WORD, Bits, cut, let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does just that on ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{NOT_WORD}+"), "")


def _shingles(words: Column, n: int) -> Column:
    """Runs of n words, or all words if they are fewer."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))


def windows(items: DataFrame, window: int, shingle: int = 2, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, words, at, prefix): each window, its rarest shingle and the place of that shingle in it."""
    ws = items.select(F.col(item_id).alias("item_id"), raw_words(lower_ascii(F.col(text))).alias("ws")).where(F.size("ws") > 0)
    cut_up = ws.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window))).alias("words"))
    df = ws.select(F.explode(_shingles(F.col("ws"), shingle)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    each = cut_up.select(F.xxhash64("item_id", "words").alias("k"), "item_id", "words").distinct()
    tokens = each.select("k", "item_id", "words", F.posexplode(_shingles(F.col("words"), shingle)).alias("at", "w")).join(df, "w")
    # rare shingles first; of equally rare ones the longer, as common words of a language are short
    first = Window.partitionBy("k", "item_id", "words").orderBy("df", F.length("w").desc(), "w", "at")
    return tokens.withColumn("r", F.row_number().over(first)).where("r = 1").select("item_id", "words", "at", F.col("w").alias("prefix"))


def matches(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 2, block_mb: int = 32) -> DataFrame:
    """One row for each occurrence of an item's window in a document and one (item null) for each document.

    Columns: doc_id, h (hash of the text), n_words, item_id, start, len.
    """
    wins = cut(windows(items, window, shingle).withColumn("k", F.least(F.size("words"), F.lit(shingle))), "windows")
    sizes = {r.k: r.size for r in wins.groupBy("k").agg(F.sum(F.length(F.array_join("words", " ")) + 64).alias("size")).collect()}  # one row for each length of shingle
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("\0"))).alias("h"), raw_words(F.col("text")).alias("ws"))
    # an empty word ends each document: it joins with the empty prefix and gives the document's own row
    marked = rows.select("doc_id", "h", F.concat("ws", F.array(F.lit(""))).alias("ws"))
    parts = []
    for k, size in sorted((sizes or {1: 0}).items(), reverse=True):
        whole = wins.where(F.col("k") == k).drop("k")
        blocks = max(1, -(-size // (block_mb << 20)))
        at = marked.select("doc_id", "h", "ws", F.posexplode("ws").alias("pos", "w"))
        words = at.withColumn("w", lower_ascii(F.concat_ws(" ", "w", *(F.get("ws", F.col("pos") + i) for i in range(1, k)))))
        for b in range(blocks):
            block = whole if blocks == 1 else whole.where(F.pmod(F.xxhash64("prefix", "item_id", "words"), F.lit(blocks)) == b)
            if not parts:
                own = docs.sparkSession.range(1).select(F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.array(F.lit("")).alias("words"), F.lit(0).alias("at"), F.lit("").alias("prefix"))
                block = block.unionByName(own)
            n, size_w = F.size("ws") - 1, F.size("words")
            start = F.col("pos") - F.col("at")
            found = (
                words.join(F.broadcast(block), F.col("w") == F.col("prefix"))
                .where((start >= 0) & (size_w <= n) & (start + size_w <= n) | (F.col("w") == ""))
                .where((F.col("w") == "") | (lower_ascii(F.array_join(F.slice("ws", F.greatest(start, F.lit(0)) + 1, size_w), " ")) == F.array_join("words", " ")))
            )
            parts.append(found.select("doc_id", "h", n.cast("long").alias("n_words"), F.when(F.col("w") != "", F.col("item_id")).alias("item_id"), F.when(F.col("w") != "", start).alias("start"), F.when(F.col("w") != "", size_w).alias("len")))
    return reduce(DataFrame.unionByName, parts)


def _covered(spans: Column) -> Column:
    """Words under the sorted spans (start, len)."""
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["start"] + x["len"]).alias("to"))
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), add, lambda a: a["n"].cast("long"))


def report(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 2, block_mb: int = 32) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated for each row of docs."""
    found = matches(docs, items, window, shingle, block_mb)
    by = found.groupBy("doc_id", "h", "n_words").agg(
        F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))).alias("spans"),
        F.collect_set(F.when(F.col("start").isNotNull(), F.col("item_id").cast("string"))).alias("ids"),
        F.count(F.when(F.col("start").isNull(), 1)).alias("copies"),
    )
    each = by.select("doc_id", "h", "n_words", F.array_sort("ids").alias("item_ids"), let(F.array_sort("spans"), _covered).alias("n_hit"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return each.select("doc_id", "h", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 2, block_mb: int = 32) -> DataFrame:
    """The rows of docs in which no window of an item occurs. Only rows that may be among the others are shuffled."""
    found = matches(docs, items, window, shingle, block_mb).where("start IS NOT NULL")
    bad = cut(found.select(F.xxhash64("doc_id").alias("id"), "h").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit("\0"))).alias("h"))
    bits = Bits(bad, "id", "h")
    rest = bits.may_hold(rows, "id", "h").join(bad, ["id", "h"], "left_anti")
    return bits.surely_lacks(rows, "id", "h").unionByName(rest.select(*rows.columns)).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: contamination of every document by the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return report(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT dw.rid, dw.i, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
