"""A corpus pipeline of five stages; each one's Parquet is the next one's documents.

The first four return the columns they are given, the last the token ids.
As a stage's result runs after the stage has returned, the stages leave the session's Arrow batches
short (2,000 rows, 2 MB); ``run`` sets them back.  Nulls, empty texts, repeated rows, empty tables and extra columns are treated as
the operators' docstrings say; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, jaccard, mixing, quality, toxicity
from textloom.llm.common import Scratch, short_batches, shorten_batches, table
from textloom.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorten_batches(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorten_batches(spark)
    return quality.reject_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorten_batches(spark)
    return jaccard.keep_one_per_component(docs, width=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorten_batches(spark)
    return bpe.encode_documents(docs, tokenizer("byte_bpe_50k.json"), keep=["doc_id", "source"], ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned scores and seeded rounding are beyond SQL; tests/llm hold the stages' operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each is written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    with short_batches(spark):
        for i, (_, stage) in enumerate(STAGES):
            docs = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
