"""Training-data pipeline over ``documents``: five stages, each an operator of ``quarry.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. The first four keep rows of
``documents`` with their columns; the last one returns the packed pieces.

* language: rows that language identification rejects go: no letter, or a cosine
  with the nearest language prototype under ``MIN_COSINE`` (like no language).
* exact: of texts equal up to white space, the smallest doc_id stays.
* near: of near-duplicate groups (five-word shingles, similarity 0.8), the
  smallest doc_id stays.
* benchmark: rows that hold a benchmark item (five-word shingles, 0.8) go.
* packing: windows of 4096 tokens.

Defined cases: rows of null or letterless text go in the first stage; texts of any
length are read whole; rows that repeat one id and text are one document and stay
together, of several ids the smallest stays; an empty table gives no pieces; columns
beside those of ``documents`` are carried to the last stage, whatever their names.

``ORACLE_SQL`` is None: language models and SimHash have no SQL; the stages are
tested against brute force instead (tests/llm/test_pipeline.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import decontaminate, exact_dedup, language, near_dedup, packing
from quarry.llm.common import fresh_name, stash

SHINGLE_WORDS, PERCENT = 5, 80
MIN_COSINE = 0.02
PACKING_WORDS = 100_000        # words a worker remembers while it packs: executors are full by then


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, MIN_COSINE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(docs, SHINGLE_WORDS, PERCENT)
    own = fresh_name(docs, "gone")
    gone = found.filter("not kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=PACKING_WORDS)


STAGES = [
    ("language", language_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
