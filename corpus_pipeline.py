"""A corpus pipeline: quality, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.

Cases: a null or empty text is scored as any other, and if it stays it is near nothing, holds no personal data, is never
taken by the mix and so ends there; a null doc_id is never held as a near duplicate; of equal rows one stays; ties between
near duplicates go to the least doc_id; a very long text passes every stage whole; columns beyond those of documents, with
whatever names, are left out at the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumastack.llm import bpe_fst, mixing, near_dup, pii, quality_qda
from lumastack.llm.scratch import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _as_documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_qda.accepted(docs.select(*COLUMNS), quality_qda.train(quality_qda.measured(docs), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return near_dup.representatives(docs.select(*COLUMNS), k=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return _as_documents(pii.redacted(docs.select(*COLUMNS)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row for each pass over a document, with the words taken."""
    return _as_documents(mixing.mixed_documents(mixing.mix(docs.select(*COLUMNS), keep_text=True)))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: (doc_id, source, n_tokens, ids)."""
    coded = bpe_fst.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("source_mix", mix_sources),
    ("bpe_tokens", encode_tokens),
]

#: Trained models, signatures and tokenizers are beyond SQL; tests hold each stage's rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
