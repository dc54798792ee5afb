"""[S08] A vector store: blocks of a float matrix with parallel ids, names and cells, kept apart by type.

Every row of the stored table is one block, so a scan hands a matrix to numpy without taking rows apart, and a filter on
types reads the folders of those types alone.  Spark writes and reads it, on any file system it knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a block, and blocks that meet a group of queries in one task.
ROWS, TOGETHER = 4096, 16

_CELLS = "array<array<string>>"
_BLOCKS = f"type string, block long, dim int, ids array<string>, names array<string>, cells {_CELLS}, matrix binary"


def save(df: DataFrame, path: str, rows: int = ROWS) -> None:
    """Write df(id, type, name, cell array<string>, vector array<float>) as blocks; an existing store is replaced.

    Rows are dealt to blocks by a hash of the id, so a type with very many rows is spread over as many tasks.  All vectors
    have one length; rows without a vector are refused.
    """
    sizes = df.agg(F.count_if(F.col("vector").isNull()).alias("none"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if sizes["none"] or sizes["least"] != sizes["most"]:
        raise ValueError("every row needs a vector, and all vectors one length")
    counts = df.groupBy("type").agg(F.ceil(F.count("*") / rows).alias("blocks"))
    kept = df.select(F.col("id").cast("string"), "type", "name", F.col("cell").cast("array<string>"), F.col("vector").cast("array<float>"))
    counts = counts.withColumnRenamed("type", "of")
    dealt = kept.join(counts, F.col("type").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).drop("of", "blocks")

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table["id"].to_pylist(), object), kind="stable")
        table = table.take(pa.array(order))
        matrix = np.stack(table["vector"].to_numpy()).astype("<f4")
        one = {"type": table["type"][:1], "block": table["block"][:1], "dim": pa.array([matrix.shape[1]], pa.int32())}
        many = {c: pa.array([table[s].to_pylist()], t) for c, s, t in (("ids", "id", pa.list_(pa.string())), ("names", "name", pa.list_(pa.string())), ("cells", "cell", pa.list_(pa.list_(pa.string()))))}
        return pa.table({**one, **many, "matrix": pa.array([matrix.tobytes()], pa.binary())})

    packed = dealt.groupBy("type", "block").applyInArrow(pack, _BLOCKS)
    packed.write.mode("overwrite").partitionBy("type").parquet(path)


def blocks(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """The store's blocks; of ``types`` alone, if given, whose folders are all that is read."""
    df = spark.read.schema(_BLOCKS).parquet(path)
    return df if types is None else df.filter(F.col("type").isin(types))


def load(spark: SparkSession, path: str, types: list[str] | None = None) -> DataFrame:
    """(id, type, name, cell, vector): the rows that were saved."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = len(r["ids"])
                vectors = np.frombuffer(r["matrix"], "<f4").reshape(n, r["dim"])
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"]), pa.array([r["type"]] * n, pa.string()), pa.array(r["names"], pa.string()), pa.array(r["cells"], pa.list_(pa.string())), pa.array(list(vectors), pa.list_(pa.float32()))], ["id", "type", "name", "cell", "vector"])

    return blocks(spark, path, types).mapInArrow(rows, "id string, type string, name string, cell array<string>, vector array<float>")


def nearest(spark: SparkSession, path: str, queries: DataFrame, k: int, types: list[str] | None = None, at_once: int = 1024) -> DataFrame:
    """(query, id, type, similarity, rank): of each queries(query, vector) the k most similar stored vectors by cosine.

    A block meets ``at_once`` queries at a time as one matrix product and passes on k rows of each query, so what is shuffled
    grows with queries and blocks.  Vectors without length are similar to none; ties go to the smaller id.
    """
    stored = blocks(spark, path, types)
    tasks = max(1, -(-stored.count() // TOGETHER))
    groups = max(1, -(-queries.count() // at_once))
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    asked = queries.select(F.col("query").cast("string"), "vector", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int").alias("q"))
    asked = asked.select("*", each(tasks, "task"))
    dealt = stored.select("*", F.pmod(F.xxhash64("type", "block"), F.lit(tasks)).cast("int").alias("task")).select("*", each(groups, "q"))

    def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.linalg.norm(m, axis=1)
        return m / np.where(size > 0, size, 1)[:, None], size > 0

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, q_ok = unit(np.stack(left["vector"].to_numpy()).astype(np.float64)) if left.num_rows else (np.zeros((0, 1)), np.zeros(0, bool))
        names = np.array(left["query"].to_pylist(), object)
        out: dict[str, list] = {"query": [], "id": [], "type": [], "similarity": []}
        for r in right.to_pylist() if left.num_rows else []:
            ids = np.array(r["ids"], object)
            m, ok = unit(np.frombuffer(r["matrix"], "<f4").reshape(len(ids), r["dim"]).astype(np.float64))
            s = np.where(q_ok[:, None] & ok[None], q @ m.T, -np.inf)
            best = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(s, best, 1)
            keep = np.isfinite(value)
            out["query"] += np.repeat(names, keep.sum(1)).tolist()
            out["id"] += ids[best[keep]].tolist()
            out["type"] += [r["type"]] * int(keep.sum())
            out["similarity"] += value[keep].tolist()
        return pa.table(out, pa.schema([("query", pa.string()), ("id", pa.string()), ("type", pa.string()), ("similarity", pa.float64())]))

    found = asked.groupBy("q", "task").cogroup(dealt.groupBy("q", "task")).applyInArrow(meet, "query string, id string, type string, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
