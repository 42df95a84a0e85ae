"""Scratch locations all executors can reach."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="eventframe-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    Only a session whose master is this machine may go without that setting; it gets a temporary folder.
    """
    base = spark.conf.get(SETTING, None)
    if base is None:
        master = spark.conf.get("spark.master", None)
        if master and master != "local" and not master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder: later plans read it back instead of computing it again."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
