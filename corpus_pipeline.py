"""A corpus pipeline: no toxic text, no near copies, no secrets, mixed to weights, encoded.

Each stage takes what its predecessor kept, whole, and returns the columns of `documents`; the
last one returns the encoded documents. `run` writes every stage as Parquet to the folder that
all executors share and reads it again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetgauge.llm import bpe, mixing, secret_scan, simhash, toxicity
from fleetgauge.llm.common import shared_folder
from fleetgauge.llm.queries import VOCABULARY

#: Near copies: a Jaccard similarity of 0.8 of five-word shingle sets. Candidates are texts of at most 32 shingles by
#: shared shingles, others by 512-bit fingerprints: 0.8 is about 80 differing bits there (deviation 8), unrelated texts 256 (11).
NEAR = {"width": 5, "n_words": 8, "radius": 128, "coarse": 24, "similarity": 0.8, "short": 32}


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.learn(docs, labels))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return simhash.one_of_each(docs, **NEAR)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    return bpe.encode(docs, VOCABULARY)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("secrets", without_secrets),
    ("mix", mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and fingerprints have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
