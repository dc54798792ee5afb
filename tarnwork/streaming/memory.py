"""Streaming operators with state of their own: duplicate memory without a horizon, and a lifecycle with timers.

Both run on ``transformWithState``, whose state lies in the checkpoint, key by key, so a restarted query knows what earlier
runs saw however long ago.  Keys are dealt to ``BUCKETS``, as a call costs more than a key's rows.  A batch hands rows over in
no order; they are taken by event time and then by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .flows import MOVES

#: ``transformWithState`` keeps its state in this store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state(spark: SparkSession) -> None:
    """Choose the store that these operators need; before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


#: Parts that the keys of a memory are dealt to; a checkpoint holds for one number of them.
BUCKETS = 1024


class _First(StatefulProcessor):
    """Of a bucket of keys the first row of each is remembered; later rows carry its id.

    A call for each key would cost more than its rows do, so a call has all rows of a bucket, and the state a map by key.
    """

    def __init__(self, rule: str, by: str):
        self.rule, self.by = rule, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "key string", "id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable", ignore_index=True)
        repeated = df.duplicated(self.by)
        first, known, fresh = {}, set(), not self.first.exists()
        for value, one in zip(df.loc[~repeated, self.by], df.loc[~repeated, "id"], strict=True):
            if fresh or (before := self.first.getValue((value,))) is None:
                first[value] = int(one)
                self.first.updateValue((value,), (first[value],))
            else:
                first[value] = before[0]
                known.add(value)
        later = repeated | df[self.by].isin(known)
        df["rule"] = df["rule"].where(~later, self.rule)
        df["duplicate_of"] = df[self.by].map(first).astype("Int64").where(later)
        yield df.astype({"id": "int64"})[[c.split()[0] for c in SEEN.split(", ")]]

    def close(self) -> None:
        pass


SEEN = "id long, ts timestamp, address string, name string, rule string, duplicate_of long"


def remembered(rows: DataFrame) -> DataFrame:
    """[T02] rows(id, ts, address, name) with (rule, duplicate_of): what came before under the same address or else name.

    An address is taken as it is and should be canonical, a name compact.  Rows that repeat an address do not count for
    their name; a row without an address, or with an empty name, is no duplicate by that.  State grows with the distinct
    addresses and names and is never dropped.
    """
    rows = rows.select("id", "ts", "address", "name", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("long").alias("duplicate_of"))
    dealt = lambda df, by: df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)).cast("int")).groupBy("bucket").transformWithStateInPandas(_First(by, by), SEEN, "Append", "None")
    by_address = dealt(rows.filter("address IS NOT NULL"), "address")
    every = by_address.unionByName(rows.filter("address IS NULL"))
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    by_name = dealt(every.filter(F.col("rule").isNull() & named), "name")
    return by_name.unionByName(every.filter(F.col("rule").isNotNull() | ~named))


class _Lifecycle(StatefulProcessor):
    """The candidates of a bucket, in a map by id, with one timer: the earliest time at which one of them may be due."""

    def __init__(self, patience: timedelta, keep: timedelta):
        self.patience, self.keep = (t // timedelta(microseconds=1) for t in (patience, keep))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("state", "id long", "status string, refused int, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).drop_duplicates(["id", "us", "seq", "to"]).sort_values(["id", "us", "seq"], kind="stable")
        fresh = not self.state.exists()
        now = {}
        for i, us, to in zip(df["id"].tolist(), df["us"].tolist(), df["to"].tolist(), strict=True):
            if i not in now:
                now[i] = (None if fresh else self.state.getValue((i,))) or ("pending", 0, us)
            status, refused, last = now[i]
            now[i] = (to, refused, max(last, us)) if to in MOVES.get(status, ()) else (status, refused + 1, max(last, us))
        for i, value in now.items():
            self.state.updateValue((i,), value)
        self._wake(min(self._due(status, last) for status, _, last in now.values()))
        yield self._told([(i, *value) for i, value in now.items()])

    def _due(self, status: str, last: int) -> int:
        """In milliseconds: an open candidate waits for a decision, a closed one is kept for what may still come."""
        return (last + (self.patience if MOVES.get(status) else self.keep)) // 1000

    def _wake(self, due: int) -> None:
        set_ = list(self.handle.listTimers())
        if not set_ or due < min(set_):
            for old in set_:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(due)

    def _told(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "status", "refused", "us"]).astype({"id": "int64", "refused": "int32", "us": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        gone, out, next_ = [], [], None
        for (i,), (status, refused, last) in self.state.iterator():
            due = self._due(status, last)
            if due < mark:
                gone.append(i)
                if MOVES.get(status):
                    out.append((i, "expired", refused, last + self.patience))
            else:
                next_ = due if next_ is None else min(next_, due)
        for i in gone:
            self.state.removeKey((i,))
        if next_ is not None:
            self.handle.registerTimer(next_)
        if out:
            yield self._told(out)

    def close(self) -> None:
        pass


def lifecycle(changes: DataFrame, delay: str = "1 hour", patience: timedelta = timedelta(days=30), keep: timedelta = timedelta(days=90)) -> DataFrame:
    """[T05] (id, status, refused, at) of changes(id, to, ts, seq): each candidate's status after every batch that names it.

    A change that one batch repeats counts once.  Moves that ``MOVES`` does not allow are counted and change nothing.  A candidate that is open, and that no change names
    for ``patience`` of event time, expires: it comes out once more as ``expired`` at that time and is forgotten.  One that is
    closed is forgotten after ``keep``.  So state holds what changed within the longer of the two, not all candidates.
    """
    rows = changes.withWatermark("ts", delay).withColumns({"bucket": F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"), "us": F.unix_micros("ts")})
    told = rows.groupBy("bucket").transformWithStateInPandas(_Lifecycle(patience, keep), "id long, status string, refused int, us long", "Append", "EventTime")
    return told.select("id", "status", "refused", F.timestamp_micros("us").alias("at"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is with state in ``checkpoint``, append the output to ``path``, then stop."""
    keep_state(df.sparkSession)
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def folder(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of Parquet files, all new ones in one batch."""
    return spark.readStream.schema(schema).parquet(path)
