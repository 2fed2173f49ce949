"""Operators that compare documents with each other, packing and the classifier."""

import itertools
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest

from retailops.llm import common, cotraining, jaccard, packing, repeats, suffix_arrays, suffix_automata
from retailops.llm.components import components


def got(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(params=[{}, {"per_shard": 20, "hot": 3}], ids=["usual", "hot"])
def limits(request, monkeypatch):
    usual = repeats.spans
    monkeypatch.setattr(repeats, "spans", lambda docs, unit, judge: usual(docs, unit, judge, **request.param))


def test_substring_dedup(docs, rows, limits):
    assert got(suffix_automata.remove(docs).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256)")) == brute.repeats(pairs(rows), 35, True)


def test_suffix_array_dedup(docs, rows, limits):
    assert got(suffix_arrays.remove(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")) == brute.repeats(pairs(rows), 200, False)


def test_dedup_of_an_empty_table(empty):
    assert suffix_automata.remove(empty).count() == 0 and suffix_arrays.remove(empty).count() == 0


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    from retailops.llm import anchors

    rng = np.random.default_rng(5)
    text = " ".join(f"w{i}" for i in rng.integers(0, 900, 3000))
    rows = [(1, text), (2, text[4000:9000] + " end"), (3, "w1 w2")]
    monkeypatch.setattr(anchors, "BATCH", 1000)
    symbols = anchors.BYTES[np.frombuffer(text.encode(), np.uint8)]
    seen = []
    for _, start in anchors.pieces([len(symbols)], 200):
        part = symbols[start : start + anchors.BATCH]
        s = anchors.segments(part, np.array([len(part)]), 200, 40)
        seen += [x for lo, hi in zip(s["lo"] + start, s["hi"] + start) for x in range(lo, hi + 1)]
    assert seen == list(range(len(symbols) - 199))  # every window once
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_arrays.remove(df).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")) == brute.repeats(rows, 200, False)


def test_automaton_counts_other_places_only():
    a = suffix_automata.Automaton()
    a.add([1, 2, 3, 4], 1)
    a.add([9, 2, 3, 4, 1], 1)
    a.settle()
    assert a.repeated([1, 2, 3, 4], 3).tolist() == [False, True]
    b = suffix_automata.Automaton()
    b.add([5] * 6, 1)
    b.settle()
    assert b.repeated([5] * 6, 3).tolist() == [True] * 4


def test_a_shard_has_one_automaton(monkeypatch):
    """All segments of a shard go into one automaton and are streamed through it, whatever their anchors."""
    rnd, made = random.Random(6), []

    class Counted(suffix_automata.Automaton):
        def __init__(self):
            super().__init__()
            made.append(self)

    monkeypatch.setattr(suffix_automata, "Automaton", Counted)
    voc = [b"w%d" % i for i in range(60)]
    shared = [[rnd.choice(voc) for _ in range(50)] for _ in range(30)]
    segments = []
    for k in range(300):
        own = [rnd.choice(voc) for _ in range(rnd.randint(20, 60))]
        segments.append(own + shared[k % 30][rnd.randint(0, 10) :] + own[:5])
    copies = np.array([1 + (k % 50 == 0) for k in range(300)])
    got = suffix_automata.judge([b" ".join(s) for s in segments], copies, copies, copies, np.arange(300) // 3)
    assert len(made) == 1
    seen = defaultdict(int)
    for s, n in zip(segments, copies.tolist()):
        for i in range(len(s) - 34):
            seen[tuple(s[i : i + 35])] += n
    assert [g.tolist() for g in got] == [[seen[tuple(s[i : i + 35])] > 1 for i in range(len(s) - 34)] for s in segments]


@pytest.mark.parametrize("how", [{}, {"common": 3, "chunk": 2}])
def test_jaccard_join(docs, rows, how):
    assert got(jaccard.join(docs, **how).select("doc_id", "n_shingles", "component_id")) == brute.jaccard(pairs(rows))


def families(seed, count=300, size=12):
    """Texts in families, each a copy of an earlier one of its family with a few words replaced: (doc_id, text)."""
    rnd, rows = random.Random(seed), []
    for f in range(count):
        new = itertools.count()
        texts = [[f"f{f}x{next(new)}" for _ in range(rnd.randint(60, 140))]]
        for _ in range(size):
            t = list(texts[-1] if rnd.random() < 0.6 else rnd.choice(texts))
            n = rnd.choice((1, 1, 2, 3))
            at = rnd.randrange(len(t) - n)
            t[at : at + n] = [f"f{f}x{next(new)}" for _ in range(n)]
            texts.append(t)
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("seed, how", [(3, {"common": 6}), (1, {"common": 3, "chunk": 3})])
def test_jaccard_join_of_copies_of_copies(spark, seed, how):
    rows = families(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert got(jaccard.join(df, **how).select("doc_id", "n_shingles", "component_id")) == brute.jaccard(rows)


def passages(seed, shared=14, own=90):
    """Families whose members share most of their text or about as much as a link needs, with frequent shingles in all of them."""
    rnd, rows = random.Random(seed), []
    for f in range(shared):
        base = [f"b{f}x{i}" for i in range(rnd.randint(40, 90))]
        for i in range(own):
            extra = [f"o{f}x{i}x{j}" for j in range(rnd.randint(0, 14))]
            at = rnd.choice((0, len(base), rnd.randrange(len(base))))
            rows.append((len(rows) * 7 % 5000, " ".join(base[:at] + extra + base[at:])))
    return rows


@pytest.mark.parametrize("seed, how", [(1, {"common": 4, "chunk": 5}), (5, {"k": 1, "common": 3, "chunk": 3})])
def test_jaccard_join_near_the_threshold(spark, seed, how):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.join(df, **how).select("doc_id", "n_shingles", "component_id")) == brute.jaccard(rows, k=how.get("k", 4))


def test_parities_never_tell_of_too_much_difference():
    rng = np.random.default_rng(3)
    for n, m, both in ((1, 1, 0), (64, 65, 60), (300, 250, 200), (1000, 1030, 990), (5000, 4000, 100)):
        every = np.unique(rng.integers(0, 1 << 62, n + m, dtype=np.uint64))
        x, y = every[:n], every[n - both : n - both + m]
        packed = [np.packbits(jaccard._parity(v), bitorder="little").tobytes() for v in (x, y)]
        assert jaccard._differ(*packed) <= len(np.setxor1d(x, y))


def test_bits_hold_all_their_keys(spark):
    from retailops.llm.common import Bits

    rows = spark.range(0, 40000)
    bits = Bits(rows.where("id % 3 = 0"), "id")
    assert bits.may_hold(rows, "id").where("id % 3 = 0").count() == rows.where("id % 3 = 0").count()
    assert bits.may_hold(rows, "id").where("id % 3 <> 0").count() < 100
    lacks = bits.surely_lacks(rows, "id")
    assert lacks.where("id % 3 = 0").count() == 0 and lacks.count() > 26000


def test_representatives_keep_clashing_columns(spark):
    rows = [(3, "a b c d e f", "x", 1, 2), (1, "A b c d e f", "y", 3, 4), (1, "A b c d e f", "y", 3, 4), (None, "q", None, None, None), (7, None, "z", 5, 6), (7, None, "z", 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, th long, did long")
    assert got(jaccard.representatives(df)) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    ids = spark.createDataFrame([("b", "a b c d e"), ("a", "a b c d e"), ("c", "")], "doc_id string, text string")
    assert got(jaccard.join(ids).select("doc_id", "component_id")) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert got(jaccard.representatives(ids).select("doc_id")) == [("a",), ("c",)]


def test_jaccard_of_an_empty_table(empty):
    assert jaccard.join(empty).count() == 0 and jaccard.representatives(empty).count() == 0


def test_one_document_of_each_group_stays(docs, rows):
    sets, roots = brute.groups(pairs(rows), 5, 80)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    groups = {r for s, r in zip(sets, roots) if s}
    assert kept.count() == len(groups) + sum(not s for s in sets)


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 11), (7, 7), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    want = {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | dict.fromkeys(range(20, 26), 20)
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_packing_is_gapless_and_whole(docs, rows, empty):
    from tokenizers import Tokenizer

    out = packing.digests(docs, length=64).collect()
    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = defaultdict(int)
    for d, t in pairs(rows):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)] if len(ids) > 64 else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    have = defaultdict(int)
    for r in out:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        end = 0
        for offset, length in sorted(x):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= 1.02 * -(-sum(r.length for r in out) // 64) + 1
    assert packing.digests(empty).count() == 0


def test_quick_splitter_gives_the_tokenizers_ids():
    enc = packing.Encoder(packing.vocabulary_path(), most=3)
    odd = ["a  b\t\n c", "don't  'll x's", "<|endoftext|> hi", "x\x1cy \x1f z", "naïve ½ ² ª º", "  x\u0085y", "  ", "\n\n a", "日本 語", "1234 567ab", "a_b __ c!!", "", "ǅ ɏ ʰ", "\x00\x01 a", " 'tis", "end \n"]
    for t in odd:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_tokenizing_holds_few_ids():
    import pyarrow as pa

    enc = packing.Encoder(packing.vocabulary_path())
    texts = [f"once{i} " + "again and again " * 400 for i in range(3000)] + [None, "x y " * 700_000, ""]
    out = list(packing._pieces(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]), enc, 7, 1024, 2))
    sizes = [b.nbytes for b in out]  # of one batch; the text of 1.4 million tokens is never split
    assert sorted(sizes)[-2] < 5 << 20 and sum(sizes) > 14 << 20
    whole = pa.Table.from_batches(out).to_pydict()
    assert whole["uid"] == list(range(7, 7 + len(whole["uid"])))
    have = defaultdict(bytes)
    for d, ids in zip(whole["doc_id"], whole["ids"], strict=True):
        have[d] += ids
    for d in (0, 1, 2999, 3000, 3001, 3002):
        assert np.frombuffer(have[d], "<u4").tolist() == enc.tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
    assert len(have) == len(texts)


def test_a_cut_sends_small_batches(spark):
    from pyspark.sql import functions as F

    def of(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(key)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    n = [r.n for r in common.cut(rows.mapInArrow(of, "n long"), "batches", common.BATCH).collect()]
    assert sum(n) > 19e6 and max(n) < 5 << 20 and spark.conf.get(key) == usual


def test_frequent_shingles_are_counted_over_many_small_batches(spark):
    from pyspark.sql import functions as F

    class Held(jaccard.Measure):
        def shingles(self, text):
            import pyarrow as pa

            return np.array([pa.total_allocated_bytes()], np.uint64)

    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("text "), 1000).alias("text"))
    held, _ = jaccard._frequent(rows, Held(4, 85), 1, 100)
    assert int(held.max()) < 10 << 20
    # texts that share shingles lie in different batches, and count together
    words = spark.range(0, 4000, 1, 1).select(F.concat(F.when(F.expr("id % 500 = 3"), "a b c d ").otherwise(""), F.repeat(F.concat("id", F.lit(" ")), 1000)).alias("text"))
    known, _ = jaccard._frequent(words, jaccard.Measure(4, 85), 8, 100)
    assert known.tolist() == jaccard.Measure(4, 85).shingles("a b c d").tolist()


def test_often_counts_sets():
    rng = np.random.default_rng(1)
    for common in (1, 2, 8):
        for m in (0, 1, 5, 300):
            sets = [np.unique(rng.integers(0, 200, rng.integers(0, 60)).astype(np.uint64)) for _ in range(m)]
            every, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            assert jaccard._often(sets, common).to_pydict() == {"token": every[n >= common].tolist(), "n": n[n >= common].tolist()} and not sets


def test_an_encoder_keeps_no_more_words_than_a_worker_has_room_for():
    enc = packing.Encoder(packing.vocabulary_path())
    words = [" a", "\x7fa", "\t", "é", " ü", "ab\x01"]
    for w in words:
        assert np.frombuffer(enc.encode(w), np.uint32).tolist() == enc.tokenizer.encode(w, add_special_tokens=False).ids
    for k in range(210_000):
        enc.known[f" {k}"]
    assert len(enc.known) <= 200_000


def test_trigram_numbers_are_small_tables():
    from retailops.llm import secrets

    wanted = ("aki", "akj", "key", "\0=\x7f")
    row, number = secrets._numbers(wanted)
    assert row.nbytes + number.nbytes < 1 << 20
    look = lambda g: int(number[(int(row[(ord(g[0]) << 8) | ord(g[1])]) << 8) | ord(g[2])])
    assert [look(g) for g in (*wanted, "akk", "kez", "zzz", "kij")] == [1, 2, 3, 4, 0, 0, 0, 0]


def test_local_search_only_helps():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 1024, 400), rng.integers(300, 700, 300), np.array([600, 500, 424, 524]), np.zeros(0, np.int64)):
        first = packing.best_fit(sizes, 1024)
        then = packing.local_search(sizes, first, 1024)
        if len(sizes):
            assert np.bincount(then, sizes).max() <= 1024 and len(np.unique(then)) <= len(np.unique(first))
    assert len(np.unique(packing.local_search(np.array([600, 400, 624, 424]), np.array([0, 0, 1, 2]), 1024))) == 2


def test_co_training_is_accurate_on_held_out_labels(spark):
    from pyspark.sql import functions as F

    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    train, test = labels.where("doc_id % 5 <> 0"), labels.where("doc_id % 5 = 0")
    model = cotraining.train(docs, train, labelled=1500)
    assert len(model.given) == 3 and all(n > 0 for n, _ in model.given)
    scored = cotraining.score(docs, model).join(test, "doc_id")
    right = scored.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int")))).first()
    assert right[0] > 0.97 and right[1] > 0.99


def test_classifier_equals_an_exchange_over_one_array(spark):
    """The rounds in plain numpy: every document's features in one array, the surest by a sort of all of them."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet").where("doc_id % 2 = 0")
    all_rows = docs.selectExpr("doc_id", "xxhash64(doc_id) AS key", "text", "source", "lang", "n_chars").collect()
    x = [np.stack([cotraining.text_features(r.text) for r in all_rows]), np.stack([cotraining.meta_features(r.source, r.lang, r.n_chars) for r in all_rows])]
    keys = [r.key for r in all_rows]
    at_key = {k: i for i, k in enumerate(keys)}
    assert len(at_key) == len(keys)
    by_id = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    marked = [i for i, r in enumerate(all_rows) if r.doc_id in by_id]
    # rows are held back by their place in the order of the features' hashes
    order = {r.key: k for k, r in enumerate(spark.createDataFrame([(keys[i], x[0][i].tobytes(), x[1][i].tobytes()) for i in marked], "key long, t binary, m binary").orderBy("key").selectExpr("key", "xxhash64(t, m) AS h").orderBy("h").collect())}
    marked.sort(key=lambda i: order[keys[i]])

    def exchange(w, taken, good, bad):
        out = []
        for to in (0, 1):
            p = cotraining.probability(x[1 - to] @ w[1 - to])
            free = [i for i in range(len(keys)) if i not in set(marked) and keys[i] not in taken[to]]
            chosen = [(i, 1.0) for i in sorted((i for i in free if p[i] > 0.5), key=lambda i: (-abs(p[i] - 0.5), keys[i]))[:good] if p[i] >= cotraining.SURE]
            chosen += [(i, 0.0) for i in sorted((i for i in free if p[i] < 0.5), key=lambda i: (-abs(p[i] - 0.5), keys[i]))[:bad] if p[i] <= 1 - cotraining.SURE]
            out.append((x[to][[i for i, _ in chosen]], np.array([y for _, y in chosen]), [keys[i] for i, _ in chosen]))
        return out

    y = np.array([by_id[all_rows[i].doc_id] for i in marked], float)
    want = cotraining.co_train(x[0][marked], x[1][marked], y, exchange, 3, 40)
    model = cotraining.train(docs, labels, per_round=40)
    assert model.given == want.given and sum(n for n, _ in want.given) > 0
    scores = {r.doc_id: r.score for r in cotraining.score(docs, model).collect()}
    odds = want.log_odds(*x)[2]
    far = [abs(scores[r.doc_id] - cotraining.probability(odds[i])) for i, r in enumerate(all_rows)]
    assert max(far) < 0.02 and np.mean(far) < 1e-3


def test_the_surest_rows_are_the_same_in_any_order():
    rng = np.random.default_rng(1)
    p, key = rng.choice([0.01, 0.02, 0.5, 0.97, 0.99], 400), rng.permutation(10_000)[:400]
    want = [sorted(key[x].tolist()) for x in cotraining.surest(p, p < 2, 30, 30, key)]
    for _ in range(20):
        mixed = rng.permutation(400)
        assert [sorted(key[mixed][x].tolist()) for x in cotraining.surest(p[mixed], p < 2, 30, 30, key[mixed])] == want


def test_both_views_give_labels_and_gain_by_it():
    """Two views that tell of the label independently, few labels and many rows without one."""
    rng = np.random.default_rng(4)
    y = (rng.random(6000) < 0.5).astype(float)
    views = [np.concatenate([np.ones((6000, 1)), (2 * y - 1)[:, None] * strength + rng.normal(size=(6000, dims))], axis=1).astype(np.float32) for dims, strength in ((40, 0.35), (30, 0.4))]
    own, pool, test = np.arange(24), np.arange(24, 4000), np.arange(4000, 6000)

    def exchange(w, taken, good, bad):
        p = [cotraining.probability(views[v][pool] @ w[v]) for v in (0, 1)]
        out = []
        for to in (0, 1):
            top, low = cotraining.surest(p[1 - to], ~np.isin(pool, list(taken[to])), good, bad)
            keys = pool[np.concatenate([top, low])]
            out.append((views[to][keys], np.repeat([1.0, 0.0], [len(top), len(low)]), keys.tolist()))
        return out

    none = [(np.zeros((0, x.shape[1]), np.float32), np.zeros(0), []) for x in views]
    right = []
    for how in (lambda *a: none, exchange):
        model = cotraining.co_train(views[0][own], views[1][own], y[own], how, rounds=4, per_round=300)
        right.append(np.mean([((views[v][test] @ (model.text, model.meta)[v]) > 0) == (y[test] > 0) for v in (0, 1)]))
        assert all(a > 0 and b > 0 for a, b in model.given) == (how is exchange)
    assert right[1] > right[0] + 0.02


def test_classifier_takes_one_row_of_an_id(spark):
    text = "plain words of prose that say this and that and more. " * 8
    rows = [(i, text + str(i), "en", "s", 9, "k") for i in range(40)] + [(100 + i, "### $$$ %%% " * 30, "en", "s", 9, "k") for i in range(40)]
    rows += [rows[1]] * 300 + [(None, None, None, None, None, "k")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in (*range(20), *range(100, 120), 1, 1)], "doc_id long, quality int, toxic int")
    out = {(r.doc_id, r.kept) for r in cotraining.score(docs, cotraining.train(docs, labels)).collect()}
    assert {x for x in out if x[0] is not None} == {(r[0], r[0] < 100) for r in rows if r[0] is not None}


def test_classifier_edge_cases(spark, docs, empty):
    labels = spark.createDataFrame([(3, 1, 0), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    one = cotraining.train(docs, labels)  # one class only
    out = cotraining.score(docs, one)
    assert out.count() == docs.count() and out.select("score").distinct().count() == 1
    assert cotraining.score(docs, cotraining.train(docs, labels.limit(0))).select("score").first()[0] == pytest.approx(0.5)
    assert cotraining.score(empty, one).count() == 0
