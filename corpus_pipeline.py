"""Corpus pipeline: quality, toxicity, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its
result is written as Parquet and read again as the next one's documents.  All but the
last return the columns of ``documents``:

quality          rows whose shrunk perplexity is over their language's threshold go
toxicity         rows scored 0.5 or more by their nearest labelled examples go
near_duplicates  of texts linked by SimHash fingerprints of three-word shingles at most three
                 bits apart, the one of the smallest doc_id stays
decontamination  occurrences of benchmark windows are cut out of the texts
sentencepiece    documents become token ids and byte spans, with their count and digests

Null texts and columns, repeated rows, empty tables and extra columns behave as the
operators' docstrings say: a stage keeps extra columns, rows with a null text count as
empty texts, and of rows with equal doc_id and class one stays.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rateforge.llm import fm_index, kneser_ney, neighbours, pieces, simhash
from rateforge.llm.common import checkpoint_folder, read

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.kept(docs, read(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neighbours.kept(docs, neighbours.fit(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_index.removed(docs, read(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 of what is left."""
    return pieces.digests(docs, PIECES)


STAGES = [
    ("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece),
]

#: The models of the first two stages and SimHash's hash are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the shared folder."""
    docs, folder = read(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
