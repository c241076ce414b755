"""Corpus pipeline: quality rules, near-duplicate groups, repeated passages, benchmark passages, then segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partloom.llm.common import discard, materialise
from partloom.llm.decontaminate import without_contaminated
from partloom.llm.jaccard import one_of_each
from partloom.llm.quality import keep_good, trusted_ids
from partloom.llm.sentencepiece_sampling import sample_segmentations
from partloom.llm.substring import without_repeats

#: Near duplicates: shingles of five words, Jaccard similarity of 80 % or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, PERCENT, SHINGLE)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_segmentations(docs, with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", segmentation),
]

#: Log-likelihood ratios, signature trees and seeded sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage{k}")
            discard(before)
    return docs
