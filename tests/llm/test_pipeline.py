"""The pipeline against its brute-force twin on a small table, stage by stage."""

import zlib

import brute
import numpy as np
import pytest

import corpus_pipeline
from retailops.llm import packing, secrets

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twin(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{AT}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    steps = [rows]
    good = {r[0] for r in brute.quality(rows) if r[-1]}
    steps.append([r for r in rows if r[0] in good])
    _, roots = brute.groups(steps[-1], 5, 80)
    first: dict = {}
    for r, root in zip(steps[-1], roots):
        first.setdefault(root, r)
    steps.append(sorted(first.values()))
    dirty = {r[0] for r in brute.contamination(steps[-1], items) if r[-1]}
    steps.append([r for r in steps[-1] if r[0] not in dirty])
    clean = []
    for d, t in steps[-1]:
        at, parts = 0, []
        for _, s, e in secrets.find([t])[0]:
            if s >= at:
                parts += [t[at:s], "[SECRET]"]
            at = max(at, e)
        clean.append((d, "".join(parts) + t[at:]))
    steps.append(clean)
    return steps


def test_stages(spark, twin, tmp_path):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1], 1):
        stage(spark, docs, AT).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == columns, name
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(twin[k]), name
        assert docs.where("n_chars <> char_length(text)").count() == 0
    assert len(twin[0]) > len(twin[1]) > len(twin[2]) >= len(twin[3]) > 0


def test_run(spark, twin):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    want = set()
    for d, t in twin[-1]:
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want |= {(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, AT).collect()} == want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_odd_and_empty_tables(spark, docs, empty, rows, name, stage):
    out = stage(spark, docs, AT)
    found = out.collect()
    assert 0 < len(found) and stage(spark, empty, AT).count() == 0
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        want = {tuple(r) for r in rows}
        changed = {"text", "n_chars"} if name == "secret_scans" else set()
        kept = [i for i, c in enumerate(docs.columns) if c not in changed]
        assert {tuple(r[i] for i in kept) for r in found} <= {tuple(r[i] for i in kept) for r in want}
        assert len(found) <= len(rows) and (name == "quality_rules" or any(r.text is None for r in found))


def test_secrets_are_sought_in_small_batches(spark, tmp_path):
    from retailops.llm.common import ARROW_BYTES, BATCH

    usual = spark.conf.get(ARROW_BYTES)
    at = "/root/testdata/sf0.001"
    try:
        corpus_pipeline.secret_scan(spark, spark.read.parquet(f"{at}/documents.parquet"), at)
        assert spark.conf.get(ARROW_BYTES) == BATCH
    finally:
        spark.conf.set(ARROW_BYTES, usual)
    corpus_pipeline.run(spark, at)
    assert spark.conf.get(ARROW_BYTES) == usual
