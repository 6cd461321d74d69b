"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

quality classifier -> line dedup -> near-dedup -> mixing sources to target weights -> SentencePiece encoding.
Every stage but the last returns the columns of documents; the last adds token_ids, n_tokens and round_trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factweave.llm import op2_quality, op3_linechunks, op5_sentencepiece, op6_simhash, op10_mixing
from factweave.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade reaches the fitted limit."""
    model = op2_quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op2_quality.graded(docs, model).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur earlier in the corpus."""
    return op3_linechunks.without_repeats(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are similar by 0.8 or more."""
    return op6_simhash.one_of_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents left out, taken once or taken twice."""
    return op10_mixing.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    return op5_sentencepiece.with_tokens(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]
#: None: fitting, connected components and Viterbi have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
