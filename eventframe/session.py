"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution sizes reducers and splits skewed joins; the rest keeps results independent of the host.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(name: str, cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """One-machine session for tests and benchmarks; on a cluster use its own session with SETTINGS."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.ui.enabled", "false").config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
