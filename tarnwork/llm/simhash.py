"""SimHash near-duplicates: 64-bit fingerprints, linked by a generalised pigeonhole search.

The 64 bits are grouped into partitions of correlated bits.  Partition ``i`` gets its own threshold ``t_i`` with
``sum(t_i + 1) = distance + 1``, so two fingerprints within ``distance`` agree within ``t_i`` bits in one partition at
least.  A dynamic programme picks the partitions' thresholds by the candidates that the bit statistics of all
fingerprints let it expect.  Every fingerprint stands under its own value of a partition and under the values up to
``t_i`` bits away; those that meet under a value are verified by their full distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .nearsets import LOWER, near_sets

#: A value's fingerprints beyond this number are split into blocks, and each pair of blocks is a task's unit of its own.
BLOCK = 4096
#: Relative cost of one shuffled row and of one compared pair, for the choice of partitions.
ROW_COST, PAIR_COST = 1.0, 0.01


def fingerprint_batch(texts: list[bytes], shingle: int = 4) -> np.ndarray:
    """A fingerprint for each UTF-8 text; a text without words has fingerprint zero."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.translate(LOWER).split()
        if len(words) <= shingle:
            if words:
                hashes.append(digest(b" ".join(words), 42))
                counts[i] = 1
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes += [digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
        counts[i] = len(words) - shingle + 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.uint32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp) of every row; a null or empty text and one without words have fingerprint zero."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in common.steps(texts, 1 << 18):
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(fingerprint_batch(texts[a:b], shingle).view(np.int64))], [id_col, "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), common.utf8(text_col).alias("_text"))
    return common.map_batches(kept, work, f"{id_col} long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits that are set together, over all rows."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = _bits(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array(range(65), pa.int32()), pa.array([*(bits.T @ bits).tolist(), [float(len(bits))]], pa.list_(pa.float64()))], ["k", "v"])

    rows = common.map_batches(fps.select("fp"), work, "k int, v array<double>").select("k", F.posexplode("v")).groupBy("k", "pos").agg(F.sum("col").alias("v")).collect()  # 4097 numbers at any size
    together, n = np.zeros((64, 64)), 0
    for k, pos, v in rows:
        if k < 64:
            together[k, pos] = v
        else:
            n = int(v)
    return n, together


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(np.int64).view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def grouped_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 is the highest) in ``parts`` groups of even width; each takes the bit most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, groups = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        group = [min(free)]
        free.remove(group[0])
        while len(group) < width:
            best = max(sorted(free), key=lambda b: corr[b, group].sum())
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with thresholds; those with threshold -1 are left out.  The cheapest of 2 to distance + 1 partitions."""
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    best, chosen = None, []
    for parts in range(2, distance + 2):
        groups = grouped_bits(n, together, parts)
        costs = []  # of each partition at thresholds -1 to distance
        for group in groups:
            apart = np.array([1.0])
            for b in group:
                apart = np.convolve(apart, [1 - differ[b], differ[b]])
            row = [0.0]
            for t in range(distance + 1):
                probes = sum(comb(len(group), k) for k in range(t + 1))
                meet = 0.5 * n * n * apart[: t + 1].sum() * probes
                row.append(ROW_COST * n * probes + PAIR_COST * meet)
            costs.append(row)
        table = {0: (0.0, [])}  # by the sum of (threshold + 1) so far
        for row in costs:
            after: dict = {}
            for used, (cost, picks) in table.items():
                for t in range(-1, distance + 1):
                    if (u := used + t + 1) <= distance + 1 and (u not in after or cost + row[t + 1] < after[u][0]):
                        after[u] = (cost + row[t + 1], [*picks, t])
            table = after
        cost, picks = table[distance + 1]
        if best is None or cost < best:
            best, chosen = cost, [(g, t) for g, t in zip(groups, picks, strict=True) if t >= 0]
    return chosen


def entries(reps: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, rep): each fingerprint under its value of every partition and the values within its threshold."""
    masks = []
    for group, t in chosen:
        flips = [np.uint64(0)] + [np.bitwise_or.reduce([np.uint64(1) << np.uint64(63 - b) for b in c]) for k in range(1, t + 1) for c in combinations(group, k)]
        masks.append((int(np.bitwise_or.reduce([np.uint64(1) << np.uint64(63 - b) for b in group]).astype(np.int64)), [int(f.astype(np.int64)) for f in flips]))
    cells = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(whole).cast("long")).alias("own"), F.array(*[F.lit(f).cast("long") for f in flips]).alias("flips")) for i, (whole, flips) in enumerate(masks)])
    return reps.select("fp", "rep", F.explode(cells).alias("c")).select("fp", "rep", F.col("c.part").alias("part"), F.col("c.own").alias("own"), F.explode("c.flips").alias("flip")).select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "fp", "rep")


def links(reps: DataFrame, chosen: list[tuple[list[int], int]], distance: int) -> DataFrame:
    """(a, b) of representatives: edges that join all fingerprints of a partition value that lie within ``distance``.

    Within a value only the edges of a spanning forest are given, which carry the same connections as all pairs.
    A value with more than ``BLOCK`` fingerprints is dealt out by pairs of blocks, so that no task holds more than two.
    """
    rows = entries(reps, chosen)
    hot = rows.groupBy("part", "value").count().filter(F.col("count") > BLOCK).select("part", "value", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(hot, ["part", "value"], "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.select("part", "value", "fp", "rep", "own", other.alias("other")).select("part", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "rep")
    keys = ["part", "value", "x", "y"]
    ready = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            if held:
                cols = np.concatenate([*held, cols])
            if not len(cols):
                continue
            cuts = np.flatnonzero((cols[1:, :4] != cols[:-1, :4]).any(axis=1)) + 1
            held = [cols[cuts[-1] :] if len(cuts) else cols]
            if len(cuts):
                yield _forest(cols[: cuts[-1]], np.concatenate([[0], cuts[:-1]]), cuts, distance)
        if held and len(held[0]):
            yield _forest(held[0], np.array([0]), np.array([len(held[0])]), distance)

    return ready.mapInArrow(run, "a long, b long").distinct()


def _forest(cols: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int) -> pa.RecordBatch:
    """Edges of a spanning forest of each group of rows [start, end)."""
    fp, rep = cols[:, 4].view(np.uint64), cols[:, 5]
    out_a, out_b = [], []
    sizes = ends - starts
    for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):  # all groups of a size at once; equal work, no loop over groups
        base = starts[sizes == size]
        for lo in range(0, len(base), max(1, 2_000_000 // int(size * size))):
            at = base[lo : lo + max(1, 2_000_000 // int(size * size))][:, None] + np.arange(size)
            v = fp[at]
            near = np.bitwise_count(v[:, :, None] ^ v[:, None, :]) <= distance
            g, i, j = np.nonzero(near & np.tri(size, k=-1, dtype=bool))
            out_a.append(rep[at[g, i]])
            out_b.append(rep[at[g, j]])
    for s, e in zip(starts[sizes > 32], ends[sizes > 32], strict=True):
        a, b = spanning(fp[s:e], distance)
        out_a.append(rep[s:e][a])
        out_b.append(rep[s:e][b])
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([lo, hi], axis=1)[lo != hi], axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def spanning(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a breadth-first forest over the fingerprints within ``distance``; each vertex is expanded once."""
    left = np.arange(len(fp))
    a, b, queue = [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        v = queue.pop()
        if len(left):
            near = np.bitwise_count(fp[left] ^ fp[v]) <= distance
            found = left[near]
            a.append(np.full(len(found), v))
            b.append(found)
            queue += found.tolist()
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def fingerprint_pairs(docs: DataFrame, id_col: str, text_col: str, shingle: int, distance: int) -> DataFrame:
    """(a, b) of ids: edges that join all rows whose fingerprints are equal or within ``distance`` bits."""
    fps = common.cut(fingerprints(docs, id_col, text_col, shingle))
    reps = common.cut(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    n, together = bit_statistics(reps)
    equal = fps.join(reps, "fp").select(F.col("rep").alias("a"), F.col(id_col).alias("b")).filter("a <> b")
    return common.cut(equal.union(links(reps, plan(n, together, distance), distance)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, similarity: float | None = None) -> DataFrame:
    """(id, fingerprint, component_id) of every row.

    With ``similarity`` the rows link by that Jaccard similarity of their sets of shingles instead, exactly, and no
    fingerprint returns: pairs within ``distance`` bits are found as without it and checked by their sets.  Of pairs at 0.8 only
    a few are within 4 bits, and a distance that holds nearly all of them meets most other documents as well, so ``nearsets``
    adds the pairs that fingerprints do not bring together.

    Texts are lower-cased in A-Z and split at ASCII white space; null counts as empty, and texts without words share
    fingerprint zero.  Rows with equal fingerprints are one class and link; classes link at ``distance`` differing bits
    or fewer; component_id is the smallest id reachable.  Repeated rows return as often as they come in, an empty table
    gives an empty one, and other columns are left out.  Ids are longs; a row without one is a document of its own, after
    all others, so a component of such rows alone has no id.
    """
    if similarity is not None:
        return near_sets(docs, id_col, text_col, shingle, similarity, fingerprint_pairs(docs, id_col, text_col, shingle, distance))
    docs, unnumbered = common.numbered(docs.select(id_col, text_col), id_col)
    fps = common.cut(fingerprints(docs, id_col, text_col, shingle))
    reps = common.cut(fps.groupBy("fp").agg(F.min(id_col).alias("rep")))
    n, together = bit_statistics(reps)
    roots = common.components(links(reps, plan(n, together, distance), distance))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return unnumbered(out, "component_id")
