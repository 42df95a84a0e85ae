"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

The language stage drops documents whose language cannot be told (``und``); line dedup deletes later repeated runs of
lines and drops documents that had text and lost all of it; of near duplicates one stays; documents that contain a benchmark
item go; what is left is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm import bpe, decontamination, language, linededup, neardup
from eventframe.llm.common import stored, table
from eventframe.llm.queries import VOCABULARY

#: Language models, hashes and merges are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is predicted, by profiles of the documents outside the held-out fold."""
    model = language.learn(language.teachers(docs))
    return language.keep_identified(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of 50 words or more; a document left without any text goes."""
    done = linededup.without_repeated_lines(docs)
    emptied = (F.col("_llm_deleted") > 0) & (F.trim(F.translate("text", "\n\t\r", "   ")) == "")
    out = done.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on five-word shingles."""
    return neardup.distinct_documents(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the five-word shingles of every benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return bpe.digest(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("language", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("byte bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
