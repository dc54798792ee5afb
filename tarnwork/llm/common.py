"""What the operators of this subpackage share: reading tables, cutting lineage, bounded batches, exact-copy classes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from inspect import signature

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..durable import shared_folder, stored

#: Bytes of text that one numpy step works on; arrays of eight bytes a symbol stay within the processor's caches.
STEP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder that all executors share, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``; only a session on one machine without one (a test) gets a temporary
    folder.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def of_group(work: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``work`` of a group, for ``applyInArrow``; what it held goes back to the system."""
    if len(signature(work).parameters) == 2:

        def two(a: pa.Table, b: pa.Table) -> pa.Table:
            made = work(a, b)
            del a, b
            give_back()
            return made

        return two

    def one(rows: pa.Table) -> pa.Table:
        made = work(rows)
        del rows
        give_back()
        return made

    return one


def utf8(column: str) -> Column:
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


@lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker stays for the next stage, and what it keeps adds up over stages."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch; Spark bounds a batch by rows and by bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = work(batch)
                if isinstance(made, pa.RecordBatch):
                    yield made
                elif made is not None:
                    yield from made
                del batch, made
                give_back()

    return df.mapInArrow(run, schema)


def steps(texts: list[bytes], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts whose bytes stay under ``most``; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` without null ids, and what makes those ids null again, in ``id_col`` and in other columns that it is told.

    Each row without an id is a document of its own, after all others; such rows follow each other by their contents.
    Only those rows are materialised.
    """
    top, nulls = docs.agg(F.coalesce(F.max(id_col), F.lit(0)), F.count_if(F.col(id_col).isNull())).first()
    if not nulls:
        return docs, lambda df, *more: df
    lacking = docs.filter(F.col(id_col).isNull()).orderBy(*[F.xxhash64(F.col(f"`{c}`")) for c in docs.columns if c != id_col])
    named = cut(lacking.withColumn(id_col, F.monotonically_increasing_id() + F.lit(top + 1)))
    back = lambda df, *more: df.withColumns({c: F.when(F.col(c) <= top, F.col(c)) for c in (id_col, *more)})
    return docs.filter(F.col(id_col).isNotNull()).unionByName(named), back


def rows_with_own_ids(docs: DataFrame, id_col: str, given: str) -> DataFrame:
    """``docs`` with an id that no other row has, never null, and the id that a row came with as ``given``.

    Ids that are unique stay.  Where ids repeat, all rows are numbered by id and contents, those without an id last, so that
    order stays and each row is a document of its own; only then the table is sorted and materialised.
    """
    docs = docs.withColumn(given, F.col(id_col))
    if (docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().agg(F.max("count")).first()[0] or 0) < 2:
        return numbered(docs, id_col)[0]
    by = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, given)])
    return cut(docs.orderBy(F.asc_nulls_last(given), by).withColumn(id_col, F.monotonically_increasing_id()))


#: Slots of ids that tell which rows may be among those that go.
GONE_SLOTS = 1 << 22


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone``; no row travels unless its id shares a slot with one of those."""
    slot = F.pmod(F.xxhash64(id_col), F.lit(GONE_SLOTS))
    gone = stored(gone.select(id_col))
    flags = np.zeros(GONE_SLOTS, bool)
    flags[gone.select(slot.alias("s")).distinct().toArrow()["s"].to_numpy()] = True  # GONE_SLOTS bounds it
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    @pandas_udf("boolean")
    def asked(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((held.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    told = docs.withColumn("_asked", asked(slot))
    return told.filter("NOT _asked").drop("_asked").unionByName(told.filter("_asked").drop("_asked").join(gone, id_col, "left_anti"))


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, copy, carried columns), materialised; copy: whether a smaller id has the very same bytes, by SHA-256.

    Only ids and digests are shuffled, and repeated ids come to one row.  The smallest id of each digest comes from a
    grouped minimum, which is combined before the shuffle, and is joined back, so that a digest that a third of all rows
    hold is split by the skew join.
    """
    keyed = docs.select(F.col(id_col), F.sha2(utf8(text_col), 256).alias("_digest"), *carry)
    firsts = keyed.groupBy("_digest").agg(F.min(id_col).alias("_first"))
    told = keyed.join(firsts, "_digest").groupBy(id_col).agg(F.min(F.col("_first") != F.col(id_col)).alias("copy"), *[F.min(c).alias(c) for c in carry])
    return cut(told)


#: Edges that one partition of a round of ``components`` holds.
EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``: component is the smallest node reachable.

    Alternates large-star and small-star steps until the edge set stays the same, in a number of rounds that grows with
    the logarithm of the longest chain.  Each round is two grouped minima and two joins, and is a written table; only a row
    count and a checksum reach the driver.  The edges stand in partitions by their number, so a small graph costs no
    shuffle over all partitions of the session.
    """
    stars = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(stars)
    while state[0]:
        tasks = -(-state[0] // EDGES)
        stars = stars.coalesce(tasks)
        both = stars.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        stars = stored(small.coalesce(tasks))
        after = _state(stars)
        if after == state:
            break
        state = after
    nodes = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
