"""Removal of repeated byte strings through the suffix order of string collections.

Super-k-mers (see ``superkmers``) bring every two places of a repeated string to one bucket.  There the order of all
suffixes of the bucket's strings is built column by column: each round inserts one symbol of every string, from its end,
into the collection's Burrows-Wheeler transform, and updates the common prefixes of neighbours, which live in files that
a round reads and writes in sequence.  Neighbours with a common prefix of the window's width are equal windows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .superkmers import Texts, mask_of, repeated_windows

#: Strings in one collection; strings with one anchor are never parted.
COLLECTION = 8192


def bytes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, None, None]:
    buffer = b"".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = (np.frombuffer(buffer, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return symbols, np.repeat(np.arange(len(texts)), sizes), buffer, None, None


class Column:
    """One external file of numbers, read and written in sequence; unlinked from the start, so it ends with its task."""

    def __init__(self, values: np.ndarray):
        self.kind = values.dtype
        self.write(values)

    def read(self) -> np.ndarray:
        self.file.seek(0)
        return np.fromfile(self.file, self.kind)

    def write(self, values: np.ndarray) -> None:
        self.file = tempfile.TemporaryFile()
        values.astype(self.kind, copy=False).tofile(self.file)
        self.file.flush()


def suffix_order(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, length, common prefix with the suffix before) of all suffixes of all strings, in order.

    Equal suffixes stand in the order of their strings.
    """
    m = len(strings)
    sizes = np.fromiter(map(len, strings), np.int64, m)
    data = np.frombuffer(b"".join(strings), np.uint8)
    alphabet = np.unique(data)
    small = np.uint8 if len(alphabet) < 256 else np.uint16
    number = np.zeros(256, small)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    data = number[data]
    ends = np.cumsum(sizes)

    def symbol(of: np.ndarray, back: int) -> np.ndarray:
        """The symbol ``back`` places before the end of each string; 0 before its start."""
        return np.where(sizes[of] > back, data[np.maximum(ends[of] - 1 - back, 0)], 0).astype(small)

    where, who = np.arange(m), np.arange(m)  # the place and string of the suffixes that the last round inserted
    longest = int(sizes.max(initial=0))
    bwt, prefixes = Column(symbol(who, 0)), Column(np.zeros(m, np.uint8 if longest < 256 else np.uint32))
    for round_ in range(1, longest + 1):
        b, lcp = bwt.read(), prefixes.read()
        order = np.argsort(b, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(b, minlength=len(alphabet) + 1))])
        done = edges[1]  # strings that are in whole have no symbol left
        c = b[where]
        by = np.argsort(c, kind="stable")
        by = by[c[by] > 0]
        where, who, c = where[by], who[by], c[by].astype(np.int64)
        rank = np.empty(len(c), np.int64)
        parts = np.searchsorted(c, np.arange(len(alphabet) + 2))
        for k in np.unique(c).tolist():
            own = slice(parts[k], parts[k + 1])
            rank[own] = edges[k] + np.searchsorted(order[edges[k] : edges[k + 1]], where[own])
        before = np.flatnonzero(rank > edges[c])
        behind = np.flatnonzero(rank + 1 < edges[c + 1])
        own_prefix = np.zeros(len(c), np.int64)
        own_prefix[before] = 1 + _least(lcp, order[rank[before] - 1] + 1, where[before] + 1)
        next_prefix = 1 + _least(lcp, where[behind] + 1, order[rank[behind] + 1] + 1)
        place = m + rank - done
        old = np.ones(m + len(b) - done, bool)
        old[place] = False
        out = np.empty(len(old), bwt.kind)
        out[old], out[place] = b, symbol(who, round_)
        bwt.write(out)
        out = np.empty(len(old), prefixes.kind)
        out[old], out[place] = lcp, own_prefix
        out[place[behind] + 1] = next_prefix
        prefixes.write(out)
        where = place
    # the finished transform names the suffixes: each step back from a string's end adds one symbol
    b = bwt.read()
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b))
    done = int((b == 0).sum())
    string, length = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
    where = who = np.arange(m)
    string[:m], length[:m] = who, 0
    for n in range(1, longest + 1):
        more = sizes[who] >= n
        where, who = m + rank[where[more]] - done, who[more]
        string[where], length[where] = who, n
    return string, length, prefixes.read().astype(np.int64)


def _least(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The minimum of values[begin:end] for ranges that are not empty."""
    if not len(begin):
        return np.zeros(0, np.int64)
    order = np.argsort(-begin, kind="stable")  # falling starts: what lies between ranges is never scanned
    padded = np.append(values, values[-1:])
    pairs = np.stack([begin[order], end[order]], axis=1).ravel()
    out = np.empty(len(begin), np.int64)
    out[order] = np.minimum.reduceat(padded, pairs)[::2]
    return out


def common_windows(width: int):
    """A ``resolve`` for byte windows: all but the first of the windows in a run of common prefixes of ``width`` or more."""

    def resolve(strings: list[bytes], group: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        out_s, out_o = [], []
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        begin = 0
        for stop in [*first[1:].tolist(), len(strings)]:
            after = np.searchsorted(first, stop, side="right")
            following = first[after] if after < len(first) else len(strings)
            if stop < len(strings) and following - begin <= COLLECTION:
                continue
            who, length, prefix = suffix_order(strings[begin:stop])
            run = np.cumsum(prefix < width)
            long = length >= width
            who, length, run = who[long] + begin, length[long], run[long]
            offset = sizes[who] - length
            order = np.lexsort((starts[who] + offset, ids[who], run))
            later = order[1:][run[order[1:]] == run[order[:-1]]]
            out_s.append(who[later])
            out_o.append(offset[later])
            begin = stop
        return np.concatenate(out_s), np.concatenate(out_o)

    return resolve


def drop_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, seed: int = 40, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with the kept bytes as ``kept`` and the columns ``carry``.

    A byte of the UTF-8 text goes if a string of ``width`` bytes that covers it also starts earlier, by (id, start), as
    judged on the input.  Null and empty texts have no bytes.  Of rows with one text the smallest id stands first; the
    others lose the whole text if it has ``width`` bytes or more.  Ids should be unique; rows that repeat an id and text
    are each judged as that id's first row, and rows that share an id alone are unordered.
    Rows with a null id are a document each, after all others.
    """
    docs, unnumbered = common.numbered(docs.select(F.col(id_col).cast("long").alias(id_col), text_col, *carry), id_col)
    classes = common.text_classes(docs, id_col, text_col, carry)
    docs, kinds = docs.select(id_col, text_col), {f.name: f.dataType.simpleString() for f in docs.schema}
    ranges = repeated_windows(docs, classes.filter("not copy").select(id_col), id_col, text_col, Texts(width, seed, bytes_of), common_windows(width))
    joined = docs.join(classes.join(ranges, id_col, "left"), id_col).select(id_col, common.utf8(text_col).alias("_text"), "copy", "begins", "ends", *carry)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, copies, begins, ends = (batch.column(i) for i in range(5))
        sizes, removed, spans, digests, rest = [], [], [], [], []
        for text, copy, a, b in zip(texts.to_pylist(), copies.to_pylist(), begins.to_pylist(), ends.to_pylist(), strict=True):
            n, runs, kept = len(text), 0, text
            if copy:
                if n >= width:
                    runs, kept = 1, b""
            elif (mask := mask_of(n, a, b)) is not None:
                runs = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~mask].tobytes()
            sizes.append(n)
            removed.append(n - len(kept))
            spans.append(runs)
            digests.append(hashlib.sha256(kept).hexdigest())
            rest.append(kept)
        return pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(digests), pa.array(rest, pa.binary()), *[batch.column(c) for c in carry]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carry])

    more = "".join(f", `{c}` {kinds[c]}" for c in carry)
    return unnumbered(common.map_batches(joined, work, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary{more}"))
