"""Cleaning and packing of a document table: each stage works on what the one before it kept.

toxicity: documents whose text scores 0.5 or more go. exact dedup: of equal texts one row stays.
near dedup: of each group of similar texts (shingles of five words, similarity of 0.8 or more) the
smallest doc_id stays. secret scans: secrets in texts are replaced by a mark; all rows stay.
packing: the texts' tokens in sequences of at most 2048, a row a piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausula.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from clausula.llm.queries import tokenizer_file
from clausula.llm.shared import written

#: Executors still hold what the stages before packing took, so its workers remember fewer pieces than op10's.
PACK_CACHE_BYTES = 10_000_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0, capacity=2048, cache_bytes=PACK_CACHE_BYTES)


STAGES = [("toxicity", remove_toxic), ("exact dedup", remove_copies), ("MinHash near-dedup", remove_near_copies), ("secret scans", redact_secrets), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs


#: SQL cannot express the learned stages; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None
