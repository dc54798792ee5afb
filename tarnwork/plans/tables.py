"""Access to the tables that queries bind to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import scratch  # noqa: F401  (a new folder where all executors can write)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instants(df: DataFrame, *columns: str) -> DataFrame:
    """Zoneless timestamps as instants, which event-time operators need; the session's zone is UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})
