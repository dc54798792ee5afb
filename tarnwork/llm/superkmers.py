"""Repeated windows of symbols, found by super-k-mers.

A window is ``width`` consecutive symbols (bytes or words) of one document.  Its anchor is its first ``seed``-gram with
the smallest hash, so equal windows have equal anchors at equal places.  Consecutive windows with the same anchor are a
super-k-mer: one packed string, which travels to the bucket of its anchor's hash.

1. Only anchors whose hash occurs twice matter.  A first pass sends hashes alone, each once a batch of documents, and
   learns for every document which of its anchors occur elsewhere.
2. A second pass packs the super-k-mers of those anchors.  Of equal strings in a batch only the first travels; all others
   are repeats already.
3. A bucket drops all but the first of equal strings, and leaves the strings that share an anchor to ``resolve``, which
   says which windows also start earlier.

Hot anchors: a batch sends a hash once and equal strings once, so copies of a passage, however many, come to one row a
batch.  What can still grow is an anchor whose surroundings differ at each place.  Beyond ``HOT`` places the windows of
such an anchor travel each under the hash of its own content, where all strings are equal and again only the first of a
batch travels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Places of one anchor, each batch of documents counted once, beyond which its windows travel by their own content; it
#: is raised to the ten-millionth part of all places, so that the driver and each task hold ten million hot anchors at most.
HOT, HOT_ANCHORS = 50_000, 10_000_000
#: Buckets for each of the session's shuffle partitions, whose number is set in proportion to the input.
SPREAD = 4
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all ``size``-grams of 64-bit symbols, built by doubling."""
    powers = {1 << k: np.uint64(pow(_BASE, 1 << k, 1 << 64)) for k in range(size.bit_length())}
    have, step = {1: symbols}, 1
    while 2 * step <= size:
        a = have[step]
        have[2 * step] = a[:-step] * powers[step] + a[step:]
        step *= 2
    out, length = have[step], step
    rest = size - step
    while rest:
        step = 1 << (rest.bit_length() - 1)
        n = len(out) - step
        out = out[:n] * powers[step] + have[step][length : length + n]
        length, rest = length + step, rest - step
    return mixed(out)


def anchors(symbols: np.ndarray, docs: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash) of each super-k-mer of concatenated documents; docs: of each symbol."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(symbols) - width + 1
    if n <= 0:
        return none
    grams = gram_hashes(symbols, seed)
    span = width - seed + 1  # grams in a window
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # the first of equal hashes is the smaller
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if span > step:
        least = np.minimum(least[: n], least[span - step : span - step + n])
    place = (least[:n] & _PLACE).astype(np.int64)
    inside = docs[:n] == docs[width - 1 :]
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, n))
    keep = inside[starts]
    starts, counts = starts[keep], counts[keep]
    return starts, counts, grams[place[starts]]


@dataclass(frozen=True)
class Texts:
    """How documents become symbols; ``cut`` gives for texts: symbols, the document of each, and for packing the buffer with the byte range of each symbol."""

    width: int
    seed: int
    cut: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, bytes, np.ndarray | None, np.ndarray | None]]


def pieces(texts: list[bytes], spec: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, np.ndarray | None, np.ndarray | None, tuple]]:
    """Steps over ``texts``, each with its offset, symbols and super-k-mers."""
    for a, b in common.steps(texts):
        symbols, docs, buffer, begins, ends = spec.cut(texts[a:b])
        if len(symbols) < 1 << 24:
            yield a, symbols, docs, buffer, begins, ends, anchors(symbols, docs, spec.width, spec.seed)
            continue
        part = 1 << 23  # one very long text: by parts that overlap, so that places fit their bits
        for lo in range(0, len(symbols) - spec.width + 1, part):
            hi = min(len(symbols), lo + part + spec.width - 1)
            s, c, h = anchors(symbols[lo:hi], docs[lo:hi], spec.width, spec.seed)
            yield a, symbols, docs, buffer, begins, ends, (s + lo, c, h)


def repeated_windows(docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, spec: Texts, resolve: Callable, hot_places: int = HOT) -> DataFrame:
    """(id, begins, ends) for documents with repeats: ranges of symbols covered by windows that also start earlier.

    Earlier is by (id, start).  ``firsts`` holds the ids that stand first among equal texts, and only their texts are
    packed.  The first pass reads ``docs`` where it lies: a copy that it asks for only makes an anchor look more frequent.
    """
    buckets = SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = docs.select(F.col(id_col).alias("_id"), common.utf8(text_col).alias("_text"))
    asked = common.map_batches(every, _ask(spec, buckets), "bucket int, ids binary, hashes binary, kinds binary")
    told = common.cut(asked.groupBy("bucket").applyInArrow(common.of_group(_tell(hot_places)), "_id long, hashes binary, places long"))
    places = told.agg(F.sum("places")).first()[0] or 0
    hot = _hot(told, max(hot_places, places // HOT_ANCHORS))
    wanted = told.filter("_id is not null").select(F.col("_id").alias(id_col), "hashes").join(firsts, id_col).groupBy(id_col).agg(F.collect_list("hashes").alias("hashes"))
    text = docs.select(id_col, text_col).join(wanted, id_col).select(F.col(id_col).alias("_id"), common.utf8(text_col).alias("_text"), "hashes")
    packed = common.map_batches(text, _pack(spec, hot, buckets), "bucket int, rows binary")
    found = packed.groupBy("bucket").applyInArrow(common.of_group(_settle(resolve, spec)), "_id long, begins binary, ends binary")
    return found.groupBy("_id").agg(F.collect_list("begins").alias("begins"), F.collect_list("ends").alias("ends")).withColumnRenamed("_id", id_col)


def _ask(spec: Texts, buckets: int) -> Callable:
    """Each document's anchors.  kinds: 0 one place in the batch, 1 many (sent once; its documents are told at once)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        first: dict[bytes, int] = {}
        for i in np.argsort(ids, kind="stable").tolist():
            if first.setdefault(texts[i], i) != i:
                texts[i] = b""  # a copy in this batch
        all_ids, all_hashes = [], []
        for at, _, docs, _, _, _, (starts, _, hashes) in pieces(texts, spec):
            all_ids.append(ids[at + docs[starts]])
            all_hashes.append(hashes)
        who, what = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (all_ids, all_hashes))
        what = what.astype(np.uint64)
        order = np.argsort(what, kind="stable")
        who, what = who[order], what[order]
        _, begin, ends = _runs(what)
        count = ends - begin
        single = count == 1
        many = np.repeat(~single, count)
        # questions of one place, questions of many, and the answers that many gives at once
        bucket = np.concatenate([_bucket(what[begin[single]], buckets), _bucket(what[begin[~single]], buckets), (who[many] % buckets).astype(np.int32)])
        hashes = np.concatenate([what[begin[single]], what[begin[~single]], what[many]])
        sent = np.concatenate([who[begin[single]], np.zeros((~single).sum(), np.int64), who[many]])
        kinds = np.repeat(np.array([0, 1, 2], np.uint8), [single.sum(), (~single).sum(), many.sum()])
        order = np.lexsort((sent, bucket))
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(k, sent[o].tobytes(), hashes[o].tobytes(), kinds[o].tobytes()) for k in range(buckets) if len(o := order[edges[k] : edges[k + 1]])]
        return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(("bucket", "ids", "hashes", "kinds"), (pa.int32(), *[pa.binary()] * 3), zip(*rows, strict=True) if rows else ((),) * 4, strict=True)})

    return work


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, begin, end) of the runs of a sorted array."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[begin], begin, np.append(begin[1:], len(values))[: len(begin)]


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _tell(hot_places: int) -> Callable:
    """Of each document the anchors that occur twice; in a row without id, the bucket's places and its frequent anchors."""

    def work(rows: pa.Table) -> pa.Table:
        ids, hashes, kinds = _joined(rows["ids"], np.int64), _joined(rows["hashes"], np.uint64), _joined(rows["kinds"], np.uint8)
        asked = kinds < 2
        order = np.argsort(hashes[asked], kind="stable")
        what = hashes[asked][order]
        _, begin, ends = _runs(what)
        count = ends - begin
        again = (np.repeat(count, count) > 1) & (kinds[asked][order] == 0)
        frequent = count > hot_places
        pairs = np.stack([what[begin[frequent]], count[frequent].astype(np.uint64)], axis=1)
        who = np.concatenate([ids[asked][order][again], ids[kinds == 2]])
        what = np.concatenate([what[again], hashes[kinds == 2]])
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        docs, begin, ends = _runs(who)
        told = [what[a:b].tobytes() for a, b in zip(begin, ends, strict=True)]
        return pa.table({"_id": pa.array([*docs.tolist(), None], pa.int64()), "hashes": pa.array([*told, pairs.tobytes()], pa.binary()), "places": pa.array([None] * len(told) + [int(asked.sum())], pa.int64())})

    return work


def _hot(told: DataFrame, most: int) -> np.ndarray:
    """Anchors at more than ``most`` places, sorted."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[pairs[:, 1] > most, 0].view(np.int64))], ["hash"])

    rows = common.map_batches(told.filter("_id is null").select("hashes"), work, "hash long").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


#: One packed super-k-mer within a bucket's row: id, first symbol, number of symbols, number of bytes, anchor hash.
HEAD = np.dtype([("id", "<i8"), ("start", "<i8"), ("symbols", "<i4"), ("bytes", "<i4"), ("hash", "<u8")])


def _pack(spec: Texts, burning: np.ndarray, buckets: int) -> Callable:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        ids, texts = cols["_id"].to_numpy(zero_copy_only=False), cols["_text"].to_pylist()
        wanted = [np.frombuffer(b"".join(x), np.uint64) for x in cols["hashes"].to_pylist()]
        seen: dict[tuple[int, bytes], int] = {}
        heads: list[tuple] = []
        strings: list[bytes] = []
        for at, _, docs, buffer, begins, ends, (starts, counts, hashes) in pieces(texts, spec):
            if not len(starts):
                continue
            of = docs[starts]
            take, hot = np.zeros(len(starts), bool), np.isin(hashes, burning)
            edges = np.searchsorted(of, np.arange(of[-1] + 2))
            for d in range(of[0], of[-1] + 1):
                mine = slice(edges[d], edges[d + 1])
                take[mine] = np.isin(hashes[mine], wanted[at + d])
            base = np.searchsorted(docs, np.arange(len(texts) + 1 - at))
            for k in np.flatnonzero(take).tolist():
                s, c, h, doc = int(starts[k]), int(counts[k]), int(hashes[k]), int(of[k])
                for lo, run in ((s, c),) if not hot[k] else ((x, 1) for x in range(s, s + c)):
                    n = run + spec.width - 1
                    string = buffer[lo : lo + n] if begins is None else buffer[begins[lo] : ends[lo + n - 1]]
                    key = xxhash.xxh64_intdigest(string) if hot[k] else h
                    head = (int(ids[at + doc]), lo - int(base[doc]), n, len(string), key)
                    if (j := seen.get((key, string))) is None:
                        seen[key, string] = len(heads)
                        heads.append((*head, -1))
                        strings.append(string)
                    elif head[:2] == heads[j][:2]:
                        continue  # a repeated row
                    elif head[:2] < heads[j][:2]:  # the one that stood here is a repeat now
                        heads.append((*heads[j][:5], j))
                        strings.append(b"")
                        heads[j] = (*head, -1)
                    else:
                        heads.append((*head, j))
                        strings.append(b"")
        if not heads:
            return None
        head = np.array([h[:5] for h in heads], HEAD)
        head["bytes"] = [len(s) for s in strings]  # 0: a repeat
        bucket = np.where(head["bytes"] > 0, _bucket(head["hash"], buckets), head["id"] % buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out_b, out_r = [], []
        for k in range(buckets):
            o = order[edges[k] : edges[k + 1]]
            if len(o):
                out_b.append(k)
                out_r.append(len(o).to_bytes(8, "little") + head[o].tobytes() + b"".join([strings[i] for i in o.tolist()]))
        return pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_r, pa.binary())], ["bucket", "rows"])

    return work


def _settle(resolve: Callable, spec: Texts) -> Callable:
    """A bucket's repeats, as ranges of symbols of each document."""

    def work(rows: pa.Table) -> pa.Table:
        heads, strings = [], []
        for value in rows["rows"].to_pylist():
            n = int.from_bytes(value[:8], "little")
            head = np.frombuffer(value[8 : 8 + n * HEAD.itemsize], HEAD)
            at = 8 + n * HEAD.itemsize + np.concatenate([[0], np.cumsum(head["bytes"], dtype=np.int64)])
            heads.append(head)
            strings += [value[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        head = np.concatenate(heads)
        ids, starts, counts = head["id"], head["start"], head["symbols"]
        repeat = head["bytes"] == 0
        best: dict[tuple[int, bytes], int] = {}
        keys = head["hash"].tolist()
        order = np.lexsort((starts, ids))
        for i in order[~repeat[order]].tolist():  # by (id, start): the first of equal strings stays
            j = best.setdefault((keys[i], strings[i]), i)
            repeat[i] = j != i and (ids[i], starts[i]) != (ids[j], starts[j])  # a repeated row is no repeat of itself
        left = np.array(sorted(best.values(), key=keys.__getitem__), np.int64)
        out = [(ids[repeat], starts[repeat], starts[repeat] + counts[repeat])]
        if len(left):
            _, begin, ends = _runs(head["hash"][left])
            size = ends - begin
            group = np.repeat(np.cumsum(size > 1), size)[np.repeat(size > 1, size)]
            left = left[np.repeat(size > 1, size)]  # a string that stands alone under its anchor shares no window
        if len(left):
            w, offset = resolve([strings[i] for i in left.tolist()], group, ids[left], starts[left])
            begin = starts[left][w] + offset
            out.append((ids[left][w], begin, begin + spec.width))
        who, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((a, who))
        who, a, b = who[order], a[order], b[order]
        # merge ranges that touch
        reach = _running_max(who, b)
        new = np.ones(len(who), bool)
        new[1:] = (who[1:] != who[:-1]) | (a[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(who)) - 1 if len(who) else first
        who, a, b = who[first], a[first], reach[last]
        docs, begin, ends = _runs(who)
        spans = list(zip(begin.tolist(), ends.tolist(), strict=True))
        return pa.table({"_id": pa.array(docs, pa.int64()), "begins": pa.array([a[x:y].tobytes() for x, y in spans], pa.binary()), "ends": pa.array([b[x:y].tobytes() for x, y in spans], pa.binary())})

    return work


def _running_max(who: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The largest value so far within each run of equal ``who``."""
    if not len(who):
        return value
    run = np.cumsum(np.concatenate([[0], who[1:] != who[:-1]]))
    lift = int(value.max()) + 1
    return np.maximum.accumulate(value + run * lift) - run * lift


def mask_of(n: int, begins: list[bytes] | None, ends: list[bytes] | None) -> np.ndarray | None:
    """Which of ``n`` symbols the ranges cover; None if none."""
    if not begins:
        return None
    a, b = np.frombuffer(b"".join(begins), np.int64), np.frombuffer(b"".join(ends), np.int64)
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, a, 1)
    np.add.at(change, b, -1)
    return np.cumsum(change[:-1]) > 0
