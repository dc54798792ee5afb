"""Sharding by extendible hashing, in DataFrame operations alone.

A row's shard is a prefix of its hash.  All rows start in one bucket, and a bucket over its byte limit splits on another
bit, so a leaf of the directory is the shortest prefix whose rows fit.  The directory is found in rounds of a few bits:
each adds up the bytes of the buckets that are still oversized, and the rows of settled buckets take no part in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of the hash, and bits that one round adds.
BITS, STEP = 32, 8


def hash_of(key: Column) -> Column:
    """The first 32 bits of a key's MD5, as a long; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(depth, bits, shard_bytes, shard_rows): the leaves over ``rows(h, bytes)``; a leaf at depth ``BITS`` may be oversized."""
    total = rows.agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    root = common.cut(total.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bits"), "shard_bytes", "shard_rows").filter("shard_rows > 0"))
    leaves, full = [root.filter(F.col("shard_bytes") <= limit)], root.filter(F.col("shard_bytes") > limit)
    for base in range(0, BITS, STEP):
        if full.isEmpty():
            break
        depth = base + STEP
        full = full.select(F.col("bits").alias("parent"))
        live = rows.select("bytes", F.shiftright("h", BITS - depth).alias("fine")).groupBy("fine").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        live = live.join(full, F.shiftright("fine", STEP) == F.col("parent"), "left_semi")
        each = F.explode(F.array(*[F.struct(F.lit(base + d).alias("depth"), F.shiftright("fine", STEP - d).alias("bits")) for d in range(1, STEP + 1)]))
        sums = live.select(each.alias("c"), "bytes", "rows").groupBy("c.depth", "c.bits").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        # a bucket exists if the bucket that it would split from is oversized
        level = common.cut(sums)
        over = level.filter(F.col("shard_bytes") > limit)
        above = over.select((F.col("depth") + 1).alias("depth"), F.col("bits").alias("above")).unionByName(full.select(F.lit(base + 1).alias("depth"), F.col("parent").alias("above")))
        settled = level.filter((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)).withColumn("above", F.shiftright("bits", 1))
        leaves.append(settled.join(above, ["depth", "above"], "left_semi").select("depth", "bits", "shard_bytes", "shard_rows"))
        full = over.filter(F.col("depth") == depth)
    return common.cut(reduce(DataFrame.unionByName, leaves))


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None, row_as: str | None = None) -> DataFrame:
    """(id, n_bytes, depth, shard, page, shard_bytes, shard_rows) of every row, with the row itself as ``row_as`` if asked for.

    ``shard`` is the leaf's bits as text (empty for the whole table).  Null and empty texts have no bytes, and rows of one
    key stay together.  Where a key cannot be split, because its rows alone exceed the limit, they are dealt to numbered
    pages of the shard by their content and by where they lie, of half the limit on average; a row over the limit is
    placed as it is.  ``page`` is 0 in all other shards.  Repeated rows are placed as often as they come in; an empty
    table has no shards.
    """
    more = [F.struct("*").alias(row_as)] if row_as else []
    rows = docs.select(*more, F.monotonically_increasing_id().alias("_turn"), F.col(id_col).alias(id_col), hash_of(F.col(key_col or id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    leaves = directory(rows.select("h", F.col("n_bytes").alias("bytes")), limit)
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # 33 numbers at most
    if not depths:
        depths = [0]
    # each row looks its leaf up under its prefix of every depth that has leaves; it finds one
    tries = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("h", BITS - d).alias("bits")) for d in sorted(depths)]))
    found = rows.select(*rows.columns, tries.alias("c")).select(*[c for c in rows.columns if c != "h"], "c.depth", "c.bits").join(leaves, ["depth", "bits"])
    pages = F.ceil(2 * F.col("shard_bytes") / F.lit(limit)).cast("long")
    page = F.when(F.col("shard_bytes") > limit, F.pmod(F.xxhash64(id_col, "n_bytes", "_turn"), pages)).otherwise(F.lit(0).cast("long"))
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(bits), depth, '0')"))
    return found.select(*([row_as] if row_as else []), id_col, "n_bytes", "depth", name.alias("shard"), page.alias("page"), "shard_bytes", "shard_rows")


def write_shards(docs: DataFrame, limit: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs`` once, as one folder a shard and page, a task for each; ``shard`` and ``page`` are new columns."""
    placed = shard(docs, limit, id_col, text_col, row_as="_row").select("_row.*", F.col("shard").alias("_shard"), F.col("page").alias("_page"))
    placed.repartition("_shard", "_page").withColumnsRenamed({"_shard": "shard", "_page": "page"}).write.partitionBy("shard", "page").parquet(path)
