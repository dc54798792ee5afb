"""Benchmark decontamination by q-gram lemma filtering.

An item of ``n`` characters that occurs in a document with at most ``e`` edits shares ``n - q + 1 - q e`` q-grams with it,
all within ``e + 1`` neighbouring diagonals.  Shared q-grams are counted in bands of twice that many diagonals which
overlap by half, so one band holds them all; bands that reach the bound are verified by banded alignment.  Items are taken
in blocks of a bounded size, and every document is read against each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .superkmers import gram_hashes, mixed

#: Length of the grams, and of those for items too short for them; edits for each character of an item, characters of the items in one block.
Q, SHORT_Q, RATE, BLOCK_CHARS = 12, 8, 0.06, 2_000_000
FILTER_BITS = 22
#: Hits of a batch of texts that are counted at once; what is held besides grows with bands, not with hits.
HITS = 1 << 20


def plain(text: str | None) -> str:
    """Case folded over all letters, runs of white space as one space."""
    return " ".join((text or "").casefold().split())


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(symbols: np.ndarray, q: int) -> np.ndarray:
    return gram_hashes(mixed(symbols.astype(np.uint64) + np.uint64(1)), q) if len(symbols) >= q else np.zeros(0, np.uint64)


class Index:
    """The q-grams of some of a block's items, sorted, behind a bit table of fixed size."""

    def __init__(self, q: int, texts: list[str], of: np.ndarray):
        self.q = q
        own = [grams(points(t), q) if x else np.zeros(0, np.uint64) for t, x in zip(texts, of, strict=True)]
        hashes = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g)) for g in own]) if own else item
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.table = np.zeros(1 << FILTER_BITS, bool)
        self.table[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def bands(self, symbols: list[np.ndarray], edits: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Items.bands``, over texts as symbols."""
        none = (np.zeros(0, np.int64),) * 3
        sizes = np.array([len(s) for s in symbols], np.int64)
        h = grams(np.concatenate(symbols), self.q) if len(symbols) else none[0].astype(np.uint64)
        if not len(h) or not len(self.hashes):
            return none
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        ends = np.cumsum(sizes)
        text = np.searchsorted(ends, at, side="right")
        inside = at + self.q <= ends[text]
        at, text = at[inside], text[inside]
        lo, hi = np.searchsorted(self.hashes, h[at], side="left"), np.searchsorted(self.hashes, h[at], side="right")
        count, start = hi - lo, (ends - sizes)[text]
        # text, item and band as one number
        offset = int(self.place.max()) + 2
        span = int(sizes.max()) + 2 * offset + 2
        keys, shared = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for first, last in chunks(count, HITS):
            hit = np.repeat(np.arange(first, last), count[first:last])
            before = np.cumsum(count[first:last]) - count[first:last]
            post = np.arange(len(hit)) - np.repeat(before, count[first:last]) + lo[hit]
            item = self.item[post]
            band = (at[hit] - start[hit] - self.place[post]) // (edits[item] + 1) + offset
            key = (text[hit] * len(edits) + item) * span + band
            more, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
            keys, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            shared = np.bincount(where, np.concatenate([shared, n]), minlength=len(keys)).astype(np.int64)
        item = keys // span % len(edits)
        keep = shared >= bound[item]
        keys, item = keys[keep], item[keep]
        return keys // (span * len(edits)), item, keys % span - offset


def chunks(count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose counts add up to ``most`` at the most; a larger count stands alone."""
    total, first = np.cumsum(count), 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, side="right")))
        yield first, last
        first = last


class Items:
    """A block of items: those with an edit or more, or long enough for a gram, by their q-grams; the others as they are."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids, self.texts = ids, texts
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.edits = (self.sizes * RATE).astype(np.int64)
        bounds = [self.sizes - q + 1 - q * self.edits for q in (Q, SHORT_Q)]
        self.bound = np.where(bounds[0] > 0, bounds[0], bounds[1])
        self.short = np.flatnonzero((bounds[0] <= 0) & (self.edits == 0) & (self.sizes > 0)).tolist()  # no edits and no gram
        apart = (bounds[0] <= 0) & (self.edits > 0)
        assert (self.bound[apart] > 0).all()
        self.indexes = [Index(q, texts, of) for q, of in ((Q, bounds[0] > 0), (SHORT_Q, apart)) if of.any()]

    def bands(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, band) that reach the bound; band k of an item covers the diagonals from k (edits + 1) on."""
        symbols = [points(t) for t in texts]
        found = [(np.zeros(0, np.int64),) * 3, *(x.bands(symbols, self.edits, self.bound) for x in self.indexes)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def found(self, texts: list[str]) -> Iterator[tuple[int, int | None, int, int]]:
        """(text, item id, start, edits): the best place of each item in each text; the first of equally good ones."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for t, i, k in zip(*(x.tolist() for x in self.bands(texts)), strict=True):
            e, n = int(self.edits[i]), int(self.sizes[i])
            low = max(0, k * (e + 1) - e)
            region = texts[t][low : k * (e + 1) + 2 * (e + 1) + n + e]
            exact = region.find(self.texts[i])
            got = (0, low + exact) if exact >= 0 else None
            if got is None and (r := align(points(self.texts[i]), points(region), e)):
                got = (r[0], low + r[1])
            if got:
                best[t, i] = min(best.get((t, i), got), got)
        for i in self.short:
            for t, text in enumerate(texts):
                if (at := text.find(self.texts[i])) >= 0:
                    best[t, i] = (0, at)
        for (t, i), (edits, start) in sorted(best.items()):
            yield t, self.ids[i], start, edits


def align(item: np.ndarray, region: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, start) of the item's best place in the region if it has ``most`` edits at the most.

    Rows are the item's characters.  Row ``i`` holds the columns from ``i - most`` on, as many as the region leaves to a
    place within ``most`` edits: a band of diagonals.  Each cell carries the start of its place.
    """
    n, m = len(item), len(region)
    width = m - n + 2 * most + 1  # columns i - most to i + (m - n) + most
    if width <= 0:
        return None
    far = 1 << 30
    shift = np.arange(width)
    cost = np.where((shift >= most) & (shift - most <= m), 0, far)
    start = shift - most
    padded = np.concatenate([np.zeros(most + 1, np.int64) - 1, region.astype(np.int64), np.zeros(width + most + 1, np.int64) - 1])
    for i in range(1, n + 1):
        column = shift + i - most  # characters of the region used
        step = np.where(padded[most + column] == item[i - 1], 0, 1)
        diagonal = cost + step
        above = np.append(cost[1:] + 1, far)
        new = np.minimum(diagonal, above)
        begin = np.where(diagonal <= above, start, np.append(start[1:], 0))
        new = np.where((column < 0) | (column > m), far, new)
        # a character of the region that the item lacks: the least of new[j] + (distance from j)
        low = new - shift
        source = np.maximum.accumulate(np.where(low == np.minimum.accumulate(low), shift, 0))
        cost, start = np.minimum(low[source] + shift, far), begin[source]
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return (int(cost[k]), int(start[k])) if cost[k] <= most else None


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items, streamed to the driver and handed on in blocks of a bounded size."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), text_col).distinct().toLocalIterator():
        text = plain(row[1])
        if ids and held + len(text) > BLOCK_CHARS:
            yield Items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(text)
        held += len(text)
    if ids:
        yield Items(ids, texts)


def _steps(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    for a, b in common.steps([t or "" for t in texts]):
        yield a, [plain(t) for t in texts[a:b]]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, edits): each document that holds an item, with the item's best place in the plain text.

    Case is folded on both sides and white space is one space.  Null and empty texts hold nothing, and empty items are held
    by nothing.  An item too short for an edit is found as it is.  Repeated rows are repeated.
    """
    spark, out = docs.sparkSession, None
    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    schema = f"{id_col} long, {item_col} long, start long, edits int"
    for items in blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(items)  # BLOCK_CHARS bounds it

        def work(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            rows = [(a + t, i, s, e) for a, texts in _steps(batch.column(1).to_pylist()) for t, i, s, e in held.value.found(texts)]
            at, item, start, edits = zip(*rows, strict=True) if rows else ((),) * 4
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int32())], [id_col, item_col, "start", "edits"])

        part = common.map_batches(kept, work, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no item, as they are."""
    spark = docs.sparkSession
    for items in blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(items)

        def work(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for a, texts in _steps(batch.column(text_col).to_pylist()):
                keep[[a + t for t, *_ in held.value.found(texts)]] = False
            return batch.filter(pa.array(keep))

        docs = common.map_batches(docs, work, docs.schema)
    return docs
