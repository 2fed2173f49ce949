"""Operators on vectors against brute force."""

import math
import random

import duckdb
import numpy as np
import pytest

from retailops.llm import hard_negatives, learned_partitions

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int"


def odd_vectors(seed, n=700, dim=6):
    """Clusters, exact copies, ties, and every row that takes no part."""
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(0, 1, (9, dim))
    x = (centres[rnd.integers(0, 9, n)] + rnd.normal(0, 0.3, (n, dim))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[3]  # one vector on a third of the rows
    ids = rnd.permutation(3 * n)[:n]
    ids[:12] = np.arange(12) * 100
    rows = [(int(i), [float(v) for v in r], int(rnd.integers(0, 4)), "s", 1) for i, r in zip(ids, x)]
    rows = list({r[0]: r for r in rows}.values())
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * dim, [inf] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0] * (dim + 1)]
    rows += [(100 * (50 + k) + 5000, v, 1, None, None) for k, v in enumerate(bad)]
    return rows, [(None, [1.0] * dim, 1, None, None), (90000, [0.0] * dim, 2, None, None), (90100, [0.5] * dim, None, None, None)]


def usable(rows):
    return [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 6 and all(v is not None and math.isfinite(v) for v in r[1])]


def neighbours(rows, k=10):
    rows = [r for r in usable(rows) if any(r[1])]
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order if j != i]
    return out


def negatives(rows):
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * v) for v in x]) for i, x, lab, *_ in usable(rows) if lab is not None]
    out = []
    for a, lab, q in rows:
        if a % 100:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, v)), i, other) for i, other, v in rows if i != a)
        for ps, p, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [x for x in scored if x[2] != lab and 80 * -ps <= 100 * -x[0] <= 100 * -ps]
            out += [(a, p, r, i, -ps, -s) for r, (s, i, _) in enumerate(fit[:5], 1)]
    return sorted(out)


def written(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("block", [2048, 16])
def test_hard_negatives(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", 2048 if block > 100 else 7)
    rows, more = odd_vectors(1)
    got = hard_negatives.query(spark, written(spark, rows + more, tmp_path))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == negatives(rows + more)


def test_hard_negatives_of_shared_tables(spark):
    at = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet'")
    assert sorted(tuple(r) for r in hard_negatives.query(spark, at).collect()) == sorted(db.sql(hard_negatives.SQL).fetchall())


def test_zone_maps_leave_blocks_unread(spark, monkeypatch):
    """Tight clusters of one label each: an anchor's positives need its own cluster's blocks and no others."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 32)
    rnd = np.random.default_rng(4)
    rows = [(100 * c if k == 0 else 100 * c + k, c % 3, [int(v) for v in 1000 * np.eye(8)[c % 8] + rnd.integers(-9, 9, 8)]) for c in range(8) for k in range(64)]
    found = hard_negatives.Finder(spark.createDataFrame(rows, "id long, label long, v array<bigint>"))
    asking = found.blocks.where("id % 100 = 0").selectExpr("id AS anchor", "label", "v", f"array({-hard_negatives._LONG}L) AS los", f"array({hard_negatives._LONG}L) AS his")
    assert found.best(asking, 5, False).count() == 8 * 5
    read = sum(df.count() for df in found.read)
    assert read < 0.4 * 8 * found.zones.count()


def test_bounds_hold_every_score():
    rnd = np.random.default_rng(2)
    q, c = rnd.integers(-300, 300, (40, 9)), rnd.integers(-300, 300, (50, 9))
    low, high = hard_negatives.bounds(q, c.min(0)[None], c.max(0)[None])
    scores = hard_negatives.products(q, c)
    assert (low <= scores).all() and (scores <= high).all()
    big = rnd.integers(-(2**28), 2**28, (5, 9))
    assert hard_negatives.products(big, big).tolist() == [[sum(x * y for x, y in zip(a, b)) for b in big.tolist()] for a in big.tolist()]


def test_hilbert_curve_is_connected():
    for dims, bits in ((2, 5), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = hard_negatives.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("chunk", [32768, 40])
def test_neighbours_on_odd_tables(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(learned_partitions, "CHUNK", chunk)
    monkeypatch.setattr(learned_partitions, "TARGET", 1.0)
    rows, more = odd_vectors(2)
    got = learned_partitions.query(spark, written(spark, rows + more, tmp_path))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    found, true = {}, neighbours(rows + more)
    for q, r, v, s in sorted(tuple(r) for r in got.collect()):
        found.setdefault(q, []).append((v, s))
        assert r == len(found[q])
    assert found.keys() == true.keys() and all(len(found[q]) == len(true[q]) for q in true)
    # every queries' neighbours set the share, so all are found
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-12, abs_tol=1e-12) for q in true for a, b in zip(found[q], true[q]))


def test_recall_on_shared_tables(spark):
    at = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    x, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows])
    hits = n = 0
    found = {}
    for r in learned_partitions.query(spark, at).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        best = set(ids[np.argsort(d, kind="stable")[:10]].tolist())
        hits, n = hits + len(best & found[int(ids[i])]), n + 10
    assert hits >= 0.9 * n


def test_parts_are_balanced_and_learned():
    rnd = np.random.default_rng(6)
    x = rnd.normal(0, 1, (40, 8))[rnd.integers(0, 40, 3000)] * 4 + rnd.normal(0, 0.2, (3000, 8))
    graph = learned_partitions.neighbour_graph(x, 10)
    part = learned_partitions.balanced_parts(x, graph, 12)
    size = np.bincount(part, minlength=12)
    assert size.max() <= 1.1 * 250 + 1 and size.min() >= 0.9 * 250 - 1
    halves = learned_partitions.balanced_parts(x, graph[:, :0], 12)
    cut = lambda p: (p[graph] != p[:, None]).mean()
    assert cut(part) < cut(halves)
    assert (learned_partitions.fit(x, 12).probabilities(x).max(1) > 0.5).mean() > 0.7


@pytest.mark.parametrize("rows", [[], [(7, [1.0, 2.0], 1, None, None)], [(100, [1.0, 2.0], 1, None, None)], [(100, None, None, None, None)]])
def test_small_tables(spark, tmp_path, rows):
    at = written(spark, rows, tmp_path)
    assert hard_negatives.query(spark, at).count() == 0 and learned_partitions.query(spark, at).count() == 0


def test_repeated_ids_count_once(spark):
    rnd = random.Random(3)
    rows = [(i % 40, [rnd.randint(-9, 9) + 20 for _ in range(4)], i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>, label int")
    best = learned_partitions.search(learned_partitions.build(df.selectExpr("vec_id", "transform(embedding, x -> double(x)) AS embedding"), learned_partitions.F.col("id") == 0), learned_partitions.F.col("id") == 0).collect()
    own = [np.array(v) for i, v, _ in rows if i == 0]
    near = sorted((min(math.dist(v, q) for q in own for j, v, _ in rows if j == i), i) for i in range(1, 40))
    assert len(best) == 10 and {r.vec_id for r in best} <= set(range(1, 40)) and len({r.vec_id for r in best}) == 10
    assert all(r.score >= near[r.rank - 1][0] - 1e-9 for r in best)
    mined = hard_negatives.mine(df.selectExpr("vec_id AS id", "label", "embedding AS v"), learned_partitions.F.col("id") == 0).collect()
    assert mined and all(r.negative_id != 0 and r.positive_id != 0 for r in mined) and len({(r.positive_id, r.negative_id) for r in mined}) == len(mined)
