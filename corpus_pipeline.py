"""A training corpus from documents: rejects low quality and toxic text, near copies, mixes sources, encodes.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's rows as Parquet into the shared
scratch folder, deletes what the stage kept between its own steps, and gives the table to the next. All but the last
return the columns of documents.

Defined results: documents without text are rejected as low quality; a document whose id is null stays in its own right
where its group of near copies has no id; of a group the smallest id stays, and of rows that repeat an id and a text one;
without labels nothing but empty texts is rejected; an empty table gives an empty result. Extra columns, whatever their
names, go along. Texts of any length are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, mixing, quality_lm, simhash, toxicity
from framelake.sources.scratch import scratch_dir, scratch_removed


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limit."""
    return quality_lm.kept_documents(docs, _labels(spark, sf_dir))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.clean_documents(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: 5-word Jaccard similarity of 0.8 or more.

    Candidates come from SimHash fingerprints by BK-trees, and from min-hash bands those that lie too many bits apart.
    """
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]
#: No SQL expresses the trained models and the random rounding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = f"{scratch_dir(spark)}/{name}"
        with scratch_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
