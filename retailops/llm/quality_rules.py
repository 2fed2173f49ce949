"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean column that rejects a document. A sample of the table tells what a rule costs (seconds a row) and
how much it rejects; the cascade then tests the rules in the order of rejection per cost, and a document that one rule
rejects is not tested by those after it. The order never changes a verdict, only the time it takes.

Defined results: a null text counts as empty (no words, base_failed); a null or repeated doc_id, repeated rows, empty tables
and further columns make no difference: one row comes out for each row in, and only a column of docs that has the name of a
result gives way to it. Very long texts are worked on whole: three-word windows are compared by sorted 43-bit hashes that
carry their place, every match of hashes is verified on the words, and a text with a false match or more than 2**21 words is
counted on the windows themselves.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, space_words, text_of

#: Bits of a packed window that hold its place.
_PLACE = 21
_MASK = (1 << _PLACE) - 1


class Body:
    """A text (never null) and its words, as columns."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    @staticmethod
    def of(text: Column, body: Callable[[Body], Column]) -> Column:
        """body(...) of a text, cut into words once, however often body uses them."""
        return let(F.struct(text.alias("text"), space_words(text).alias("words")), lambda d: body(Body(d["text"], d["words"])))

    def n_words(self) -> Column:
        return F.size(self.words)

    def word_chars(self) -> Column:
        return F.length(F.array_join(self.words, ""))

    def n_of(self, chars: str) -> Column:
        """How many characters of a regex class the text has."""
        return F.size(F.split(self.text, chars)) - 1

    def n_symbols(self) -> Column:
        return self.n_of("[#*$%&|<>]")

    def lines(self) -> Column:
        return F.filter(F.split(self.text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:]}"))

    def n_dup_lines(self) -> Column:
        """Lines with a word that equal an earlier line."""
        return let(self.lines(), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def n_repeat_words(self) -> Column:
        """Words within three-word windows that the text has twice or more."""
        return let(
            self.words,
            lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(F.coalesce(F.when(F.size(w) <= _MASK, _by_hashes(w)), _by_windows(w))),
        )


@dataclass(frozen=True)
class Rule:
    """rejects: whether a text goes."""

    name: str
    rejects: Callable[[Body], Column]


def _covered(places: Column) -> Column:
    """Words that three-word windows at these sorted places cover."""
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]


def _by_windows(words: Column) -> Column:
    """n_repeat_words by sorting the windows themselves."""
    every = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("w"), i.alias("i"))))
    twice = let(every, lambda s: F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))))
    return let(F.array_sort(F.transform(twice, lambda x: x["i"])), _covered)


def _by_hashes(words: Column) -> Column:
    """n_repeat_words by sorted hashes; null if two different windows share a hash."""
    upper = lambda x: F.shiftright(x, _PLACE)
    place = lambda x: x.bitwiseAND(F.lit(_MASK)).cast("int")
    packed = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(*_window(words, i)).bitwiseAND(F.lit(~_MASK)).bitwiseOR(i.cast("bigint")))
    twice = let(F.sort_array(packed), lambda s: F.filter(s, lambda x, i: F.coalesce(upper(x) == upper(F.get(s, i - 1)), F.lit(False)) | F.coalesce(upper(x) == upper(F.get(s, i + 1)), F.lit(False))))

    def counted(s: Column) -> Column:
        differ = lambda x, y: (F.array(*_window(words, place(x))) != F.array(*_window(words, place(y)))) & (upper(x) == upper(y))
        false_match = F.exists(F.transform(s, lambda x, i: (i > 0) & F.coalesce(differ(x, F.get(s, i - 1)), F.lit(False))), lambda x: x)
        return F.when(F.size(s) == 0, F.lit(0)).when(~false_match, let(F.array_sort(F.transform(s, place)), _covered))

    return let(twice, counted)


def base_rules() -> list[Rule]:
    return [Rule("few_words", lambda d: d.n_words() < 50), Rule("repeats", lambda d: 100 * d.n_repeat_words() > 50 * d.n_words())]


def more_rules() -> list[Rule]:
    """Rules with wide margins, so that clean prose passes them."""
    return [
        Rule("symbols", lambda d: 10 * d.n_symbols() > 3 * d.n_words()),
        Rule("shouting", lambda d: 10 * d.n_of("!") > 5 * d.n_words()),
        Rule("long_words", lambda d: d.word_chars() > 25 * d.n_words()),
        Rule("short_words", lambda d: d.word_chars() < 2 * d.n_words()),
        Rule("same_lines", lambda d: let(d.lines(), lambda x: 10 * (F.size(x) - F.size(F.array_distinct(x))) > 6 * F.size(x))),
    ]


def ordered(texts: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, cost in seconds a row, share rejected) by rejection per cost, from about sample_rows rows of the whole table.

    texts: one column, text. All tasks sample; only the sampled rows meet in one partition, on which the rules are timed.
    """
    total = texts.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    sample = texts.select(text_of().alias("text")).sample(fraction=min(1.0, sample_rows / total), seed=seed).repartition(1).persist()
    try:
        rows = sample.count()

        def timed(rejects: Callable[[Body], Column]) -> tuple[float, int]:
            began = time.perf_counter()
            found = sample.agg(F.sum(Body.of(F.col("text"), rejects).cast("int"))).first()[0] or 0
            return time.perf_counter() - began, found

        timed(lambda d: F.lit(True))
        least = timed(lambda d: d.n_words() < 0)[0]
        seen = []
        for r in rules:
            cost, found = timed(r.rejects)
            seen.append((r, max(cost - least, 1e-4) / max(rows, 1), found / max(rows, 1)))
    finally:
        sample.unpersist()
    return sorted(seen, key=lambda x: (-x[2] / x[1], x[0].name))


def rejected_by(rules: list[Rule], body: Body) -> Column:
    """The first rule that rejects a document, or null; a CASE tests its branches one after the other."""
    out = None
    for r in rules:
        out = F.when(r.rejects(body), F.lit(r.name)) if out is None else out.when(r.rejects(body), F.lit(r.name))
    return out


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def score(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """docs with the base measures, base_failed and kept."""
    order = [r for r, _, _ in ordered(docs.select(F.col(text).alias("text")), more_rules(), sample_rows)]
    rows = docs.select(F.struct("*").alias("row"), text_of(text).alias("text"))
    rows = rows.withColumn("words", space_words(F.col("text")))
    body = Body(F.col("text"), F.col("words"))
    measured = rows.withColumns({x: getattr(body, x)().cast("long") for x in RESULTS[:5]})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    judged = measured.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rejected_by(order, body).isNull()))
    return judged.select(*(F.col("row")[x].alias(x) for x in docs.columns if x not in RESULTS), *RESULTS)


def keep(docs: DataFrame, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of docs that no rule rejects, all rules in one cascade."""
    order = [r for r, _, _ in ordered(docs.select(F.col(text).alias("text")), base_rules() + more_rules(), sample_rows)]
    return docs.where(Body.of(text_of(text), lambda d: rejected_by(order, d).isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: base measures and the cascade's verdict for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The verdict restated on the base measures; DuckDB compares the same rules without an order.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)
), dup AS (
  SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, length(t) - length(replace(t, '!', '')) AS n_bang
  FROM w LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_bang > 5 * n_words
            OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 6 * n_lines) AS kept
FROM m
"""
