"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors at cosine ``c`` or more lie within a squared distance of ``2 - 2 c``.  After a rotation that spreads the
variance evenly, each vector is cut into blocks; in one block at least the squared distance is within that block's share
of the budget.  Each block is range-joined by itself on a grid over two of its dimensions, and the union of the pairs
found is verified by the cosine of the whole vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Blocks that the rotated vectors are cut into, and vectors that are compared at a time.
BLOCKS, TILE = 4, 1024


def rotation(size: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rep, n, label, v): vectors that can link, once for each label and content, with their smallest id and number."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), doubles.alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = good.filter(F.col("v").isNotNull() & F.col("label").isNotNull()).filter(finite & F.exists("v", lambda x: x != 0.0))
    return good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def candidates(reps: DataFrame, cosine: float) -> DataFrame:
    """(a, b, cosine) with a < b: all pairs of representatives of one label at ``cosine`` or more."""
    budget = 2 - 2 * cosine
    slack = budget * 1e-9 + 1e-12

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector under the cell of each block, and under the neighbours that it looks into."""
        turn: dict[int, np.ndarray] = {}
        for batch in batches:
            labels, values, ids = (batch.column(i).to_pylist() for i in range(3))
            for size in {len(v) for v in values}:
                own = [i for i, v in enumerate(values) if len(v) == size]
                x = np.array([values[i] for i in own])
                x /= np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(axis=1, keepdims=True)
                x = x @ turn.setdefault(size, rotation(size))
                edges = np.linspace(0, size, min(BLOCKS, size) + 1).astype(int)
                reach = np.sqrt(budget / (len(edges) - 1) + slack)
                out = []
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    part = x[:, a:b]
                    grid = np.floor(part[:, :2] / reach).astype(np.int64)
                    if grid.shape[1] < 2:
                        grid = np.hstack([grid, np.zeros_like(grid)])
                    for dx, dy, guest in ((0, 0, False), (0, 1, True), (1, -1, True), (1, 0, True), (1, 1, True)):
                        for i, (gx, gy) in zip(own, (grid + [dx, dy]).tolist(), strict=True):
                            out.append((labels[i], size * 64 + k, gx, gy, guest, ids[i]))
                    # the blocks themselves travel with the rows
                    rows = [part[j].tobytes() for j in range(len(own))]
                    for g in range(5):
                        at = len(out) - (5 - g) * len(own)
                        out[at : at + len(own)] = [(*r, v) for r, v in zip(out[at : at + len(own)], rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], ["label", "block", "gx", "gy", "guest", "id", "part"])

    numbered = reps.select(F.xxhash64("label").alias("label"), "v", F.col("rep").alias("id"))  # labels of any type; told apart below
    dealt = numbered.mapInArrow(spread, "label long, block long, gx long, gy long, guest boolean, id long, part binary")
    keys = ["label", "block", "gx", "gy"]
    # a cell with more than a tile of residents is dealt out by residents; its guests go to every part
    hot = dealt.filter("not guest").groupBy(*keys).count().filter(F.col("count") > TILE).select(*keys, F.ceil(F.col("count") / TILE).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    dealt = dealt.join(hot, keys, "left").withColumn("own", F.when(F.col("guest"), F.lit(-1)).otherwise(F.pmod(F.xxhash64("id"), parts).cast("int")))
    dealt = dealt.select(*keys, "own", "id", "part", F.explode(F.sequence(F.lit(0), parts - 1)).alias("task")).filter("own <= task")
    ready = dealt.repartition(*keys, "task").sortWithinPartitions(*keys, "task")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a cell and task: its residents against each other, the residents of earlier tasks and the guests."""
        held = None
        for batch in [*batches, None]:
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or not held.num_rows:
                continue
            key = np.stack([held[c].to_numpy() for c in (*keys, "task")], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist(), *([held.num_rows] if batch is None else [])]
            found_a, found_b = [], []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s > 1:
                    cell = held.slice(s, e - s)
                    a, b = _within(cell["own"].to_numpy(), cell["id"].to_numpy(), cell["part"].to_pylist(), int(key[s, 4]), budget / min(BLOCKS, int(key[s, 1]) // 64) + slack)
                    found_a.append(a)
                    found_b.append(b)
            if found_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (found_a, found_b)], ["a", "b"])
            held = held.slice(bounds[-1])

    pairs = ready.mapInArrow(join, "a long, b long").distinct()
    # squares of very large or small components leave the range of doubles; a power of two changes no digit
    largest = F.array_max(F.transform("v", F.abs))
    scaled = F.when(largest.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / F.pow(F.lit(2.0), F.floor(F.log2(largest)))))
    left, right = (reps.select(F.col("rep").alias(c), F.col("label").alias(f"label_{c}"), scaled.alias(f"v{c}")) for c in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    checked = pairs.join(left, "a").join(right, "b").filter("label_a = label_b").withColumn("cosine", dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))))
    return checked.filter(F.col("cosine") >= cosine).select("a", "b", "cosine")


def _within(own: np.ndarray, ids: np.ndarray, parts: list[bytes], task: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)
    here = np.flatnonzero(own == task)
    a, b = [], []
    for lo in range(0, len(here), TILE):
        mine = here[lo : lo + TILE]
        for at in range(0, len(x), TILE):
            other = np.arange(at, min(at + TILE, len(x)))
            square = (x[mine] ** 2).sum(axis=1)[:, None] + (x[other] ** 2).sum(axis=1) - 2 * x[mine] @ x[other].T
            i, j = np.nonzero(square <= share + 1e-9)
            i, j = mine[i], other[j]
            keep = (own[j] != task) | (i < j)
            a.append(np.minimum(ids[i], ids[j])[keep])
            b.append(np.maximum(ids[i], ids[j])[keep])
    a, b = np.concatenate(a) if a else np.zeros(0, np.int64), np.concatenate(b) if b else np.zeros(0, np.int64)
    return a[a != b], b[a != b]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors link if their labels are equal and not null and their cosine is ``cosine`` or more.  Null and zero vectors and
    those with a null or non-finite component link with nothing; so do vectors of different sizes.  Equal vectors are one
    class: each links with all others of its class and of the linked classes.  Rows that repeat an id count as vectors of
    their own in n_links.  An empty table gives an empty result.  Ids are longs; a row without one is a vector of its own, after
    all others, so a component of such rows alone has no id.
    """
    vectors, unnumbered = common.numbered(vectors.select(id_col, vector_col, label_col), id_col)
    reps = common.cut(classes(vectors, id_col, vector_col, label_col))
    pairs = common.cut(candidates(reps, cosine))
    roots = common.components(pairs)
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    linked = both.join(reps.select(F.col("rep").alias("other"), F.col("n").alias("m")), "other").groupBy("rep").agg(F.sum("m").alias("links"))
    told = reps.join(linked, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("label").alias("_label"), F.col("v").alias("_v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias("_label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("_v"))
    out = rows.join(told, ["_label", "_v"], "left").select(id_col, F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"))
    return unnumbered(out.withColumn("kept", F.col(id_col) == F.col("component_id")), "component_id")
