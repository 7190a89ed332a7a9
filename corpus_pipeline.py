"""A training corpus in five stages; each takes (spark, docs, sf_dir) and the last gives sampled token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from genolake.llm import decontaminate, sentencepiece_lattice, shingle_dedup, suffix_dedup, toxicity
from genolake.llm.common import documents


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(toxicity.training_rows(docs, labels)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (Jaccard similarity of five-word shingles at least 0.8) the document with the least id stays.

    SimHash fingerprints and their pigeonring join find the nearest copies, a prefix join the others; both verify whole sets.
    """
    return shingle_dedup.representatives(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a document of smaller id has too, in a run of 50, go; what they leave of a character goes as well."""
    return suffix_dedup.rewrite(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, as in op 1."""
    return sentencepiece_lattice.encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", clean),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", span_dedup),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", encode),
]
#: No SQL can express the fitted field, the hashes and the seeded draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
