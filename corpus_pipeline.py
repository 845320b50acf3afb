"""A corpus pipeline: documents go through STAGES in order, each written as Parquet and read again.

A stage works on all rows that its predecessor kept, whatever their ids: null and repeated ids, null, empty and very long
texts, repeated rows, an empty table and further columns, whatever they are called, are all defined by the stage below.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowforge.llm import bpe, langid, mixing, secrets, simhash
from rowforge.llm.common import forget, forget_at_exit, remainder, shared_dir
from rowforge.llm.queries import RANKS


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language (null, empty, or without a letter); the others keep all their columns, and where
    ``lang`` is null it becomes the predicted language. Repeated rows are all kept."""
    model = langid.fit(docs.filter(remainder("doc_id", 5) != 0))
    return langid.keep_identified(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: that of the least id, null ids last; of rows that share an id,
    by a hash of the text, then of all columns. Rows equal in all columns become one."""
    return simhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts and brings ``n_chars`` up to date; every row stays, null and empty texts as they are."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until sources (a null one is a source) have their target weights; a text without words
    goes with the documents around it in the seeded order."""
    return mixing.repeat_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts: doc_id, n_tokens, ids_sha256, decoded_sha256, a row for each row, null texts as empty ones."""
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [("language", language), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix", mix), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's folder goes when the next one is written, the last one's when the driver ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/rowforge/pipeline-{uuid.uuid4().hex}"
    forget_at_exit(spark, at)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
        if i:
            forget(spark, f"{at}/{i - 1}-{STAGES[i - 1][0]}")
    return docs


#: The learned language model and 64-bit hashes have no form in SQL; tests/llm holds run()'s rows against plain loops.
ORACLE_SQL = None
