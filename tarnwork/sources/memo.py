"""[X03] Lookups with a memory: what was fetched once is not fetched again, by this run or a later one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, value string"


def fetcher(call: Callable[[str], str | None]) -> Callable[[DataFrame], DataFrame]:
    """A fetch of single keys by a function that runs on the executors; None is an answer too."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part["key"], "value": [call(k) for k in part["key"]]}, columns=["key", "value"])

    return lambda missing: missing.mapInPandas(rows, SCHEMA)


def lookup(keys: DataFrame, key: str, memo: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``keys`` with ``value``: what the memo table at ``memo`` has for ``key``, fetching what it lacks.

    ``fetch`` turns missing(key) into (key, value).  Each distinct key that the memo lacks is asked for once; what a fetch
    does not answer is remembered as null, so a rerun asks for nothing.  The answers are appended by one job, which the
    table shows whole or not at all.  Null keys have no value.
    """
    spark = keys.sparkSession
    read = lambda: spark.read.schema(SCHEMA).parquet(memo)
    asked = keys.select(F.col(key).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    try:
        missing = asked.join(read(), "key", "left_anti")
    except AnalysisException:  # no memo yet
        missing = asked
    if not missing.isEmpty():
        answers = fetch(missing).groupBy("key").agg(F.min("value").alias("value"))
        missing.join(answers, "key", "left").select("key", "value").write.mode("append").parquet(memo)
    # two runs at once may both have asked
    known = read().groupBy("key").agg(F.min("value").alias("value"))
    return keys.join(known, F.col(key).cast("string") == known["key"], "left").drop(known["key"])
