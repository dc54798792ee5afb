"""Sinks: append logs, snapshots with a drift check, reports, backups, canonical records."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.relational import consecutive_new, drifted


def append_log(events: DataFrame, path: str, ts: str = "ts") -> None:
    """[K06 T03] JSON by day, without rows that repeat the one before in time, tool and mechanism.

    The row before the first of a batch is the last one of that day's log, so a batch that is sent again from there on does
    not double it.  Only each day's last row is read into the comparison.
    """
    same = [ts, "tool_id", "mechanism"]
    dated = events.withColumn("date", F.left(ts, F.lit(10)))
    try:
        log = events.sparkSession.read.schema(dated.schema).json(path)
        last = log.select("date", F.struct(*same).alias("r")).groupBy("date").agg(F.max("r").alias("r")).select("date", "r.*")
    except AnalysisException as e:  # no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = dated.select("date", *same).limit(0)
    before = dated.join(last.withColumnsRenamed({c: f"_last_{c}" for c in same}), "date", "left")
    known = F.col(f"_last_{ts}").isNotNull() & (F.struct(*same) <= F.struct(*[F.col(f"_last_{c}") for c in same]))
    fresh = consecutive_new(before.filter(~known).select(*dated.columns), same, *same, by=["date"])
    fresh.write.partitionBy("date").mode("append").json(path)


def publish(df: DataFrame, path: str) -> None:
    """[K09] A snapshot artifact, one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def has_drifted(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """[K09] Whether regenerating would change the published snapshot."""
    return not drifted(spark.read.schema(df.schema).json(path), df).isEmpty()


def markdown(df: DataFrame, title: str, columns: list[str], order: list[Column | str]) -> DataFrame:
    """[K10] (line): a heading and a table; reports are small, and their lines are ordered."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("—")) for c in columns]), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    body = df.orderBy(*order).select(row.alias("line"))
    return df.sparkSession.createDataFrame([(h,) for h in head], "line string").unionByName(body)


def csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def backup(spark: SparkSession, tables: list[str], folder: str, stamp: str) -> str:
    """[K12] A snapshot folder of all tables."""
    for t in tables:
        spark.table(t).write.mode("error").parquet(f"{folder}/{stamp}/{t}")
    return f"{folder}/{stamp}"


def restore(spark: SparkSession, tables: list[str], path: str) -> None:
    for t in tables:
        spark.read.schema(spark.table(t).schema).parquet(f"{path}/{t}").write.mode("overwrite").insertInto(t)


def backups(spark: SparkSession, folder: str) -> list[str]:
    """Newest first."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((s.getPath().getName() for s in fs.listStatus(fs_path) if s.isDirectory()), reverse=True) if fs.exists(fs_path) else []


def graduated(candidates: DataFrame, fields: list[str], existing: DataFrame) -> DataFrame:
    """[K07] Canonical records of candidates that are not there yet, each field by the fallback ladder, and what needs review.

    ``candidates``: id, and for each field ``<f>``, ``<f>_confidence`` and ``<f>_payload``.
    """
    new = candidates.join(existing.select("id"), "id", "left_anti")
    got = {f: S.field_fallback(F.col(f), F.col(f"{f}_confidence"), F.col(f"{f}_payload")) for f in fields}
    review = F.array_compact(F.array(*[F.when(g["reason"] == "review_required", F.lit(f)) for f, g in got.items()]))
    return new.select("id", *[g["value"].alias(f) for f, g in got.items()], review.alias("review_required"))
