"""A cleaning pipeline over ``documents``: each stage works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import bpe, lines, minhash, posindex, quality, simhash
from spanloom.llm.common import configure, read
from spanloom.session import shared_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking rejects go."""
    return quality.keep_good(docs, quality.training_labels(read(spark, sf_dir, "labels")))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first one; ``n_chars`` follows the text."""
    found = lines.dedup_lines(docs).drop("n_lines", "n_dropped")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more of their five-word shingles.
    Texts without words are copies of each other: line dedup leaves such of exact copies.
    SimHash fingerprints of the shingles are linked at four bits. Members of a class are
    compared with its first document on whole sets, then along every link whose ends that
    leaves apart. Sets at 0.8 may differ in more bits, so MinHash bands find the links
    that the fingerprints leave.
    """
    return minhash.keep_first(docs, link_empty=True, pairs=simhash.near_pairs(docs, words_in=5))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return posindex.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids, and of the text that they decode to."""
    return bpe.round_trip(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_shared_lines),
    ("simhash_near_dedup", first_of_near_copies),
    ("benchmark_decontamination", uncontaminated),
    ("bpe_encoding", encoded),
]

#: SQL can express neither the fitted ranking nor the merges of the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
