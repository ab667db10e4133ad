"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, SentencePiece encoding.

run(spark, sf_dir) applies STAGES to documents; each stage's rows are written to the cluster's shared folder as Parquet
and read again as the next one's docs. All stages but the last return the columns of documents.

Defined results: null and empty texts, and those without a letter, go in the first stage, which also puts the language it
finds in the place of lang, so that mixing weighs that; stages drop rows, not numbers:
of rows with equal or near equal texts one stays, with the smallest doc_id (null only where there is no other), and rows
that share a doc_id but not their text are documents of their own; an empty table gives an empty result; other columns
are kept up to the last stage, which returns doc_id, ids, n_ids and round_trip.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heatfield.llm import exact_dedup, jaccard_join, langid, mixing, sentencepiece_lattice
from heatfield.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document the language found, and drops those that have none."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of equal texts the row with the smallest number."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples to raked source, language and topic weights."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left."""
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_lattice.encode(docs.select("doc_id", "text"), path)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL cannot express the stages that learn, join by similarity and encode; the tests hold them against brute force.
ORACLE_SQL = None
