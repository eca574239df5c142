"""From raw documents to packed sequences: five stages, each written and read again.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. All but the
last return rows of ``docs`` with the columns as they are, and whatever more of them there are. Null
texts are judged as empty ones and rows without an id by their text; an empty table passes all
stages as one. Results are lazy, so a stage leaves the session's limit of Arrow batches set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm import dedup, mixing, packing, process, quality, queries, toxicity
from bookloom.sources import new_path, staging_scope


def _labels(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col(name).alias("label")
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3; repeated rows stay or go together."""
    process.limit_batches(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, _labels(spark, sf_dir, "toxic")))


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is not under the quantile that bad documents make up."""
    process.limit_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, _labels(spark, sf_dir, "quality")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Of rows that repeat an id and a text one stays, rows without an id all stay.
    """
    process.limit_batches(spark)
    return dedup.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come near the target weights of sources, languages and topics.

    Documents without words are not sampled; rows of one id and cell are sampled alike.
    """
    process.limit_batches(spark)
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences; repeated rows are packed each."""
    process.limit_batches(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_bad),
    ("near_dedup", drop_copies),
    ("mixing", mix),
    ("packing", pack),
]

# Trained models and min-hashes are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``. What a stage has staged for itself goes when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        path = new_path(spark, name)
        with staging_scope(spark):
            kept = function(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
