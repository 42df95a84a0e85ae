"""What the operators share: tables of the test data, stored intermediate results, folds, bounded samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a Parquet table in the folder that ``spark.checkpoint.dir`` names.

    It cuts the lineage: a lost executor makes later stages read the table again instead of computing it anew.
    """
    path = shared_dir(df.sparkSession, f"llm-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in no fold (null)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def held_out(doc_id: str, parts: int, rest: int) -> Column:
    """Whether the row's labels are kept from training; rows without an id are never learned from and not held out."""
    return F.coalesce(fold(doc_id, parts) == rest, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, parts: int, rest: int, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled documents outside the held-out fold.

    The sample is the ids that come first in the order of a hash of the id, so it is the same on every run and does not
    depend on how the input is partitioned. Several labels for one id count as the largest. Its size is bounded by
    the parameter, so the broadcast is too.
    """
    known = (labels.select("doc_id", F.col(target).cast("int").alias("y"))
             .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", parts, rest))
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fresh(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:8]}"


def sha256_of(column: Column) -> Column:
    return F.sha2(F.encode(column, "utf-8"), 256)
