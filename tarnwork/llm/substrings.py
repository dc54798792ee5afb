"""Removal of repeated word windows: super-k-mers bring equal windows together, and sorting in a bucket counts them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .superkmers import Texts, mask_of, mixed, repeated_windows

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = 0x9E3779B97F4A7C15


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """Word hashes, the document of each, the texts with words one space apart, and the byte range of each word."""
    lines = [b" ".join(t.split()) for t in texts]
    buffer = b"\n".join(lines)
    data = np.frombuffer(buffer, np.uint8)
    gap = _SPACE[data]
    begins = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1 if len(data) else begins
    if not len(begins):
        return np.zeros(0, np.uint64), begins, buffer, begins, ends
    longest = int((ends - begins).max())
    powers = np.empty(longest, np.uint64)
    p = 1
    for i in range(longest):
        powers[i] = p
        p = p * _PRIME & 0xFFFFFFFFFFFFFFFF
    inside = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data)))) if begins[0] == 0 else np.arange(len(data)) - np.repeat(np.append(0, begins), np.diff(np.concatenate([[0], begins, [len(data)]])))
    weighted = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(inside, longest - 1)])
    hashes = mixed(np.add.reduceat(weighted, begins))
    limits = np.cumsum([len(x) + 1 for x in lines])
    return hashes, np.searchsorted(limits, begins, side="right"), buffer, begins, ends


def sorted_windows(width: int):
    """A ``resolve`` that numbers the words of the strings and sorts windows by doubling the length of ranked runs."""

    def resolve(strings: list[bytes], group: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        split = [s.split() for s in strings]
        number: dict[bytes, int] = {}
        rank = np.fromiter((number.setdefault(w, len(number)) for s in split for w in s), np.int64)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        string = np.repeat(np.arange(len(split)), sizes)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        have, step = {1: rank}, 1
        while 2 * step <= width:
            a = have[step]
            have[2 * step] = _ranked(a[:-step], a[step:])
            step *= 2
        out, length = have[step], step
        while length < width:
            step = 1 << ((width - length).bit_length() - 1)
            n = len(out) - step
            out = _ranked(out[:n], have[step][length : length + n])
            length += step
        n = len(out)
        whole = np.flatnonzero(string[:n] == string[width - 1 : width - 1 + n])
        offset = whole - base[string[whole]]
        order = np.lexsort((starts[string[whole]] + offset, ids[string[whole]], out[whole]))
        same = out[whole][order]
        later = np.zeros(len(order), bool)
        later[1:] = same[1:] == same[:-1]
        return string[whole][order[later]], offset[order[later]]

    return resolve


def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1] if len(a) else a


def drop_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, seed: int = 8) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row, with the kept text as ``kept``.

    Words are runs of anything but ASCII white space.  A word goes if a window of ``width`` words that covers it also
    starts earlier, by (id, start), as judged on the input.  Null and empty texts have no words.  Of rows with one text
    the smallest id stands first, the others lose all their words if they have ``width`` or more.  Ids should be unique;
    rows that repeat an id and text are each judged as that id's first row, and rows that share an id alone are unordered.
    Rows with a null id are a document each, after all others.
    """
    docs, unnumbered = common.numbered(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col)
    classes = common.text_classes(docs, id_col, text_col)
    docs = docs.select(id_col, text_col)
    spec = Texts(width, seed, words_of)
    ranges = repeated_windows(docs, classes.filter("not copy").select(id_col), id_col, text_col, spec, sorted_windows(width))
    joined = docs.join(classes.join(ranges, id_col, "left"), id_col).select(id_col, common.utf8(text_col).alias("_text"), "copy", "begins", "ends")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts, copies, begins, ends = (batch.column(i) for i in range(5))
        totals, removed, digests, kept_texts = [], [], [], []
        for text, copy, a, b in zip(texts.to_pylist(), copies.to_pylist(), begins.to_pylist(), ends.to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if copy:
                kept = [] if n >= width else words
            elif (mask := mask_of(n, a, b)) is None:
                kept = words
            else:
                kept = [words[i] for i in np.flatnonzero(~mask).tolist()]
            line = b" ".join(kept)
            totals.append(n)
            removed.append(n - len(kept))
            digests.append(hashlib.sha256(line).hexdigest())
            kept_texts.append(line)
        return pa.RecordBatch.from_arrays([ids, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept_texts, pa.binary()).cast(pa.string())], [id_col, "n_words", "n_removed", "kept_sha256", "kept"])

    return unnumbered(common.map_batches(joined, work, f"{id_col} long, n_words long, n_removed long, kept_sha256 string, kept string"))
