"""Line dedup: lines that many documents share stay in one document; the rest of the work is bits, not texts.

Hashes of lines are dealt by ranges of (hash, document, position) and sorted, so a partition reads each hash's documents in
order and the first one it meets is the one that keeps the line.  A hash that a third of all lines share spans many
partitions: every partition settles the hashes that lie wholly inside it and names the documents it saw of the hashes at its
two edges, and these few rows settle the edges.  What comes back for a document is a compressed bitmap of its lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_batches, numbered, utf8

#: Characters that are stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"

MIN_CHARS, MIN_DOCS = 20, 3

#: A row of the sorted stream's output: a line that goes, a line of an edge hash, a document that an edge hash was seen in.
GOES, OPEN, SEEN = 0, 1, 2


def _split(text: pa.Array) -> pa.ListArray:
    return pc.split_pattern(pc.fill_null(text, ""), "\n")


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc_id, place) of each line whose key has ``min_chars`` code points.

    The two halves are a 128-bit hash of the key.  A place is the line's number below the checksum of its row's text, which
    tells rows of one id apart.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = _split(batch["text"])
        keys = pc.ascii_lower(pc.ascii_trim(lists.flatten(), characters=BLANKS))
        at = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False))
        row = np.asarray(pc.list_parent_indices(lists))[at]
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(at)).cast(pa.binary()).to_pylist())), ">u8").reshape(-1, 2)
        place = (batch["tag"].to_numpy()[row] << 31) | (at - first[row])
        return pa.record_batch([pa.array(hashes[:, 0].astype("<u8").view("<i8")), pa.array(hashes[:, 1].astype("<u8").view("<i8")), batch["doc_id"].take(pa.array(row)), pa.array(place)], ["high", "low", "doc_id", "place"])

    return map_batches(docs.select("doc_id", "text", "tag"), work, "high long, low long, doc_id long, place long")


def _settle(min_docs: int):
    """What ``mapInArrow`` runs over a sorted partition: lines that go, and what the hashes at its edges leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, high, low, doc, place) -> pa.RecordBatch:
            n = len(doc)
            return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(high), pa.array(low), pa.array(doc), pa.array(place)], ["kind", "high", "low", "doc_id", "place"])

        # of the hash that is being read: its halves, whether it began the partition, documents so far, the last and the first of them
        hash_, leading, ranks, last, seen = None, False, 0, None, []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # its lines in documents 2 to min_docs - 1, until there are enough documents

        def edge() -> pa.RecordBatch:
            n = len(seen)
            return out(SEEN, np.full(n, hash_[0]), np.full(n, hash_[1]), np.array(seen, np.int64), np.zeros(n, np.int64))

        def waiting(kind: int) -> Iterator[pa.RecordBatch]:
            for d, p in held:
                yield out(kind, np.full(len(d), hash_[0]), np.full(len(d), hash_[1]), d, p)

        for batch in batches:
            if not batch.num_rows:
                continue
            high, low, doc, place = (batch[c].to_numpy() for c in ("high", "low", "doc_id", "place"))
            if hash_ != (high[0], low[0]):
                if leading:
                    yield edge()
                leading, hash_, ranks, last, seen, held = hash_ is None, (high[0], low[0]), 0, None, [], []
            new = np.r_[False, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
            other = np.r_[last is None or doc[0] != last, new[1:] | (doc[1:] != doc[:-1])]
            starts = np.r_[0, np.flatnonzero(new)]
            ends = np.r_[starts[1:], len(doc)]
            group, count = np.cumsum(new), np.cumsum(other)
            before = count[starts] - 1
            before[0] = -ranks
            rank = count - before[group]
            enough = rank[ends - 1] >= min_docs
            e = ends[0]
            seen += list(doc[:e][other[:e]][: min_docs - len(seen)])
            if held and enough[0]:
                yield from waiting(GOES)
                held = []
            goes = (rank > 1) & enough[group]
            if leading:
                yield out(OPEN, high[:e], low[:e], doc[:e], place[:e])
                goes[:e] = False
            if goes.any():
                yield out(GOES, high[goes], low[goes], doc[goes], place[goes])
            a = starts[-1]
            if a:
                if leading:
                    yield edge()
                leading, hash_, seen, held = False, (high[-1], low[-1]), list(doc[a:][other[a:]][:min_docs]), []
            ranks, last = int(rank[-1]), doc[-1]
            wait = rank[a:] > 1
            if not leading and ranks < min_docs and wait.any():
                held.append((doc[a:][wait], place[a:][wait]))
        if hash_ is not None:
            yield edge()
            yield from waiting(OPEN)

    return run


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, place) of the lines that go: in ``min_docs`` documents or more, and not in the largest of them."""
    order = ["high", "low", F.desc("doc_id"), "place"]
    told = cut(hashes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_settle(min_docs), "kind int, high long, low long, doc_id long, place long"))
    edges = told.filter(f"kind = {SEEN}").groupBy("high", "low").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).drop("n")
    # at most two rows a partition of the sorted stream, whatever the input
    open_ = told.filter(f"kind = {OPEN}").join(F.broadcast(edges), ["high", "low"]).filter("doc_id < keeper")
    return told.filter(f"kind = {GOES}").select("doc_id", "place").union(open_.select("doc_id", "place"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, tag, n_lines, n_dropped, keep) for each document: ``keep`` is null where all lines stay.

    ``docs(doc_id long, text)`` without null ids.  ``tag`` is the CRC-32 of the text; rows that repeat an id with the same
    text come to one row.  ``keep`` has a bit for each line, most significant first, packed and deflated.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(utf8("text")).alias("tag"))
    drops = repeated_lines(line_hashes(rows, min_chars), min_docs)
    drops = drops.distinct().groupBy("doc_id", F.shiftright("place", 31).alias("tag")).agg(F.collect_list(F.col("place").bitwiseAND(F.lit((1 << 31) - 1))).alias("drops"))
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    counted = rows.select("doc_id", "tag", n_lines.alias("n_lines")).distinct().join(drops, ["doc_id", "tag"], "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, n_dropped = [], []
        for n, drop in zip(batch["n_lines"].to_pylist(), batch["drops"], strict=True):
            n_dropped.append(len(drop) if drop.is_valid else 0)
            if drop.is_valid:
                bits = np.ones(n, np.uint8)
                bits[drop.values.to_numpy()] = 0
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            else:
                keep.append(None)
        return pa.record_batch([batch["doc_id"], batch["tag"], batch["n_lines"], pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "tag", "n_lines", "n_dropped", "keep"])

    return map_batches(counted, work, "doc_id long, tag long, n_lines long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``docs``: its lines that the bitmap keeps, joined by newlines."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.crc32(utf8("text")).alias("tag"))
    met = rows.join(bitmaps.filter("keep IS NOT NULL"), ["doc_id", "tag"], "left")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_lines, n_dropped, kept = [], [], []
        for text, packed in zip(batch["text"].to_pylist(), batch["keep"].to_pylist(), strict=True):
            lines = text.split("\n")
            n_lines.append(len(lines))
            if packed is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
                lines = [lines[i] for i in np.flatnonzero(bits)]
                text = "\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(text)
        return pa.record_batch([batch["doc_id"], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return map_batches(met.select("doc_id", "text", "keep"), work, "doc_id long, n_lines long, n_dropped long, kept string")


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``docs(doc_id long, text)``; other columns are not read.

    A line's key is the line stripped of ASCII blanks at both ends with A-Z lower-cased.  Keys of at least ``min_chars`` code
    points that ``min_docs`` documents hold lose all their lines except in the largest id that holds them.  A null text is
    one empty line.  Rows with one id are one document: they count once and keep or lose a line together.  A row without an
    id is a document of its own, after all others; its id comes back null.
    """
    named, unnumbered = numbered(docs.select("doc_id", "text"), "doc_id")
    return unnumbered(apply_bitmaps(named, keep_bitmaps(named, min_chars, min_docs)))
