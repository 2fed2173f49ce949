"""Runs of repeated words against all lags in plain Python."""

import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest

from retailops.llm import periodic_runs


def all_runs(w, shortest=6):
    """Every maximal stretch for every lag; of equal stretches the smallest period."""
    least = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 4 * q):
                least.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in least.items())


def expected(rows):
    out = []
    for d, t in rows:
        w = brute.SPACE_WORD.findall(t or "")
        n = len(w)
        if d is not None and n and zlib.crc32(str(d).encode()) % 10 == 0:
            g = zlib.crc32(str(d).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = all_runs(w)
        gone = {i for s, e, q in found for i in range(s + q, e)}
        best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
        head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
        out.append((d, len(found), *head, brute.sha(listed), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_sequences(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        w: list[int] = []
        for _ in range(rnd.randint(0, 6)):
            unit = [rnd.randrange(rnd.choice([2, 3, 30])) for _ in range(rnd.choice([1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33]))]
            w += (unit * rnd.randint(1, 7))[: rnd.randint(1, 150)]
            w += [rnd.randrange(30) for _ in range(rnd.randint(0, 5))]
        assert periodic_runs.runs(np.array(w, np.int64), len(w)) == all_runs(w) if w else True


def test_runs_of_structured_sequences():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    for w in (fib[-1], thue, thue * 5, [0] * 3000, [0, 1] * 700, ([0] * 20 + [1]) * 9, list(range(500)) * 4, list(range(500)) * 3 + list(range(499)), (list(range(40)) * 4 + [77]) * 5):
        assert periodic_runs.runs(np.array(w, np.int64), len(w)) == all_runs(w)


def odd_rows():
    rnd = random.Random(8)
    texts = [None, "", " \t\n ", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x\x0by\x0cz " * 9, "été " * 7, "a b a b " * 3, "日本 語 " * 5, "end of line\n" * 12, "w" * 3000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(1, 300))) for _ in range(60)]
    unit = [f"w{i}" for i in range(700)]
    texts += [" ".join(unit * 5), " ".join(unit * 4), " ".join(unit * 4)[:-1], " ".join(unit * 3)]
    rows = list(enumerate(texts)) + [(3, "b b b b b b b"), (3, "b b b b b b b"), (None, "c c c c c c c"), (None, None), (-7, "d e " * 8)]
    return rows + [(1000 + i, " ".join(rnd.choice(unit) for _ in range(rnd.randint(1, 400)))) for i in range(80)]


@pytest.mark.parametrize("size", [1 << 22, 500])
def test_query_on_odd_texts(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(periodic_runs, "SLICE", size)
    rows = odd_rows()
    table = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, start int, runs string, b int")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.query(spark, str(tmp_path)).drop("n_words")
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows)


def test_query_on_shared_tables(spark):
    at = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in periodic_runs.query(spark, at).drop("n_words").collect()], key=str) == expected(rows)


def test_operator_gives_texts_and_spans(spark, empty):
    df = spark.createDataFrame([(1, "no no no no no no stop"), (2, "one two")], "id long, body string")
    got = sorted(tuple(r) for r in periodic_runs.find(df, "id", "body").collect())
    assert got == [(1, 7, [(0, 6, 1)], "no stop"), (2, 2, [], "one two")]
    assert periodic_runs.find(empty).collect() == []
