"""The corpus pipeline: documents that good rules keep, each once, free of benchmark text and secrets, packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. Stages are tables: each result is written and read again before the next one starts.

Defined results: a null or empty text is rejected by the first stage, as it has fewer than 50 words; where later stages are given
one, it is a document of its own, clean and without secrets, and one end mark when packed. Rows equal in id and text are one
document from the second stage on; rows with one id and different texts are different documents, also with null ids. Stages
return all columns of documents, whatever their names, and an empty table for an empty table; ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retailops.llm import decontaminate, jaccard, packing, quality_rules, secrets
from retailops.llm.common import ARROW_BYTES, BATCH, batches_of, cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingles of five words link at a similarity of 0.8."""
    return jaccard.representatives(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words, or a whole shorter text, of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars to match.

    The caller runs the stage, so the session is left with small Arrow batches; `run` puts the usual ones back.
    """
    spark.conf.set(ARROW_BYTES, BATCH)
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.digests(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packing_stage),
]

#: Neither the redaction nor the tokenizer can be put in SQL; tests/llm/test_pipeline.py has a brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with batches_of(spark, BATCH):
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                docs = cut(docs, name)
    return docs
