"""The training-data pipeline: documents to mixed, deduplicated token ids.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame that is written as Parquet and read again as the
next one's documents. All stages but the last return the columns of documents.
Rows with nulls, empty texts and repeated rows pass through as each operator's
docstring says; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm import bpe, mixing, near_dedup, quality_rules, substrings
from corpuloom.llm.common import materialise

#: A repeated passage is a run of this many words, of repeated strings of this many bytes: fifty words of prose have 240 and more.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles at 0.8 similarity."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of 50 words or more that occur elsewhere too, each copy cut; n_chars counts what is left."""
    cut = substrings.without_repeats(docs, length=PASSAGE_BYTES, min_words=PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which sources mix by their tempered weights: files and their rows are the schedule."""
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, whether they decode to the document's very bytes, and the document's position in the mix, from 0."""
    return bpe.tokens(mixing.placed(docs, ["doc_id", "text"]), position_col="position")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing_sources),
    ("bpe", encoding),
]

#: SQL can't express near duplicates' bands, suffix sorts or byte-pair merges on whole tables; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
