"""Streaming forms: incremental ingest, bounded duplicate memory, windows, two-phase events, the candidate lifecycle.

State is bounded by a watermark throughout; in a batch run the same functions keep all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions import text as X


def files(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", per_trigger: int = 64) -> DataFrame:
    """[T01] New files as they come; the checkpoint takes the place of a "since"."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def run_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", by: list[str] = ()) -> None:
    """[T01 T03] Process what there is, then stop; a rerun takes up where this one ended."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (w.partitionBy(*by) if by else w).start().awaitTermination()


def deduplicated(df: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """[T02 K01] Raw results, each (source, content hash) once within the watermark's delay."""
    hashed = df.withColumn("content_hash", X.content_hash("url", "title")).withWatermark(ts, delay)
    return hashed.dropDuplicatesWithinWatermark(["source", "content_hash"])


def windowed(df: DataFrame, by: str, ts: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """[T08] Counts by event-time window; later rows than the delay are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.withWatermark(ts, delay).groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(df: DataFrame, by: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """[T08]"""
    return df.withWatermark(ts, delay).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stamped(pending: DataFrame, commits: DataFrame, delay: str = "1 hour") -> DataFrame:
    """[T04] Pending events whose tree, parent and digest a commit confirms in time; all others go with the watermark."""
    p = pending.withWatermark("ts", delay).alias("p")
    c = commits.withWatermark("commit_ts", delay).alias("c")
    same = F.expr(f"p.tree = c.tree AND p.parent = c.parent AND p.digest = c.digest AND c.commit_ts BETWEEN p.ts AND p.ts + INTERVAL {delay}")
    return p.join(c, same).select("p.*", "c.commit", "c.commit_ts")


def unreplayed(events: DataFrame, log: DataFrame) -> DataFrame:
    """[T03] Events of commits that were not replayed before."""
    return events.join(log.filter(F.col("source") == "replay").select("commit").distinct(), "commit", "left_anti")


# Where a candidate may go from each status.
MOVES = {"pending": ("reviewed", "accepted", "rejected", "low_relevance", "duplicate"), "reviewed": ("accepted", "rejected"), "accepted": ("graduated", "rejected"), "low_relevance": ("pending",)}


def lifecycle(changes: DataFrame, ts: str = "ts") -> DataFrame:
    """[T05] (id, status, refused) of changes(id, to, ts): each candidate's status after every batch, and moves not allowed."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, refused = state.get if state.exists else ("pending", 0)
        for r in pd.concat(list(rows)).sort_values(ts).itertuples():
            if r.to in MOVES.get(status, ()):
                status = r.to
            else:
                refused += 1
        state.update((status, refused))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "refused": [refused]})

    return changes.groupBy("id").applyInPandasWithState(step, "id long, status string, refused int", "status string, refused int", "update", GroupStateTimeout.NoTimeout)


def stale_scores(rows: DataFrame, current: str, stored: str = "query_set") -> DataFrame:
    """[T06] Rows scored under another query set, or never."""
    return rows.filter(~F.col(stored).eqNullSafe(F.lit(current)))
