"""Near-duplicate documents by the exact Jaccard similarity of their word shingles: a prefix-filtered set join.

Shingles stand in one fixed order, rare ones first.  Two sets at Jaccard ``least`` or more share a shingle among the
first ``n - ceil(least n) + 1`` of each, so documents that meet at no such shingle need no look.  Those that meet pass the
bounds of size and place, and are then compared whole.  The order comes from a bounded sample; it decides how many
documents meet, never which pairs are found.

At each shingle every document is first compared with the one of the smallest id there.  Only documents that those
comparisons leave unconnected are then compared pair by pair, so a group of near copies costs about its size.  Pairs that
signatures of 1,024 bits rule out bring no texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import stored
from . import common
from .superkmers import SPREAD

#: Bytes with A-Z in lower case.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Documents of the sample, or one in ``SHARE`` where those are more, and the most shingles that it tells to be frequent.  A sample
#: that does not keep up with the table leaves ever more frequent shingles untold, whose pairs grow with the square.
SAMPLE, SHARE, FREQUENT = 8_000, 16, 1 << 20
#: Documents at one shingle beyond this number are split into blocks, and each pair of blocks is a unit of its own.
BLOCK = 4096
#: Documents that candidate pairs connect and one task compares.
GROUP = 512
#: Bits of a document's signature.
BITS = 1024
#: Slots of ids that tell which texts are needed whole.
SLOTS = 1 << 24


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a UTF-8 text's shingles, each once, rising; a text of fewer words is one shingle."""
    words = text.translate(LOWER).split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64))


def least_shared(total: np.ndarray | int, least: Fraction) -> np.ndarray | int:
    """The fewest common shingles of two sets of ``total`` shingles together, at Jaccard ``least``."""
    p, q = least.numerator, least.numerator + least.denominator
    return -(-p * total // q)


def signature(own: np.ndarray) -> list[int]:
    """Of each residue of the hashes of a set, whether an odd number is there, as longs: two sets differ in as many
    shingles at least as their signatures differ in bits."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def possible(pairs: DataFrame, reps: DataFrame, least: Fraction) -> DataFrame:
    """The ``pairs`` that the signatures in ``reps(_id, n, sig)`` leave at Jaccard ``least`` or more; loses no such pair."""
    p, q = least.numerator, least.numerator + least.denominator
    left, right = (reps.select(F.col("_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"sig{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("siga", "sigb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("na") + F.col("nb")
    shared = F.expr(f"({p} * (na + nb) + {q - 1}) div {q}")
    return pairs.join(left, "a").join(right, "b").filter(apart <= total - 2 * shared).select("a", "b")


def _packed(what: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Hashes by bucket: their order, the upper halves in it, the edges of the buckets and which of these have any.

    The bucket and the upper half stand for a hash; that two hashes share them brings documents together that are then compared.
    """
    bucket = (what % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return order, (what[order] >> np.uint64(32)).astype(np.uint32), edges, np.flatnonzero(np.diff(edges)).tolist()


def frequent(docs: DataFrame, n_docs: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the shingles that several documents of a sample hold, by key: bucket and upper half of the hash.

    Of more than ``FREQUENT`` those with the higher counts, as far as all of one count fit.
    """
    buckets = _buckets(docs)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, h, edges, some = _packed(np.concatenate([shingle_set(t, shingle) for t in batch.column(0).to_pylist()]), buckets)
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([h[edges[k] : edges[k + 1]].tobytes() for k in some], pa.binary())], ["bucket", "h"])

    def count(rows: pa.Table) -> pa.Table:
        what, times = np.unique(np.frombuffer(b"".join(rows["h"].to_pylist()), np.uint32), return_counts=True)
        more = times > 1
        return pa.table({"h": what[more].astype(np.int64) + (rows["bucket"][0].as_py() << 32), "c": times[more].astype(np.int64)})

    some = docs.filter(F.pmod(F.xxhash64("_id"), F.lit(max(1, min(SHARE, n_docs // SAMPLE)))) == 0).select("_text")
    counts = common.cut(common.map_batches(some, spread, "bucket int, h binary").groupBy("bucket").applyInArrow(common.of_group(count), "h long, c long"))
    fits, least = 0, None
    for c, n in sorted(((r["c"], r["count"]) for r in counts.groupBy("c").count().collect()), reverse=True):  # a row for each count
        if (fits := fits + n) > FREQUENT:
            break
        least = c
    told = counts.filter(F.col("c") >= least if least is not None else F.lit(False)).toArrow()
    what, times = told["h"].to_numpy(), told["c"].to_numpy()
    order = np.argsort(what)
    return what[order], times[order]


def _met(cols: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: Fraction) -> pa.RecordBatch:
    """(a, b) of the documents at one shingle that are not joined yet and whose sizes and places leave ``least`` possible.

    cols from 3: id, component, size, place.
    """
    out = []
    p, q = least.numerator, least.denominator
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        ids, joined, size, place = (cols[s:e, k] for k in (3, 4, 5, 6))
        order = np.argsort(size, kind="stable")
        ids, joined, size, rest = ids[order], joined[order], size[order], size[order] - place[order]
        until = np.searchsorted(p * size, q * size, side="right")  # the first that is too large for each
        for i in range(len(ids) - 1):
            other = slice(i + 1, int(until[i]))
            near = np.flatnonzero((joined[other] != joined[i]) & (np.minimum(rest[i], rest[other]) >= least_shared(size[i] + size[other], least)))
            if len(near):
                j = ids[other][near]
                out.append(np.stack([np.minimum(ids[i], j), np.maximum(ids[i], j)], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _buckets(df: DataFrame) -> int:
    return SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def places(reps: DataFrame, least: Fraction) -> DataFrame:
    """(h, id, n, place, first, star, many) of shingles in the prefixes of two documents of ``reps(_id, n, prefix)`` or more.

    ``first`` is the smallest id at the shingle, ``star`` whether sizes and places leave ``least`` possible with it, ``many``
    whether more than two documents are there; of two nothing but their star is told.  Places travel packed by bucket, ids as
    differences, and only those of a shingle that stands twice go on.
    """
    buckets = _buckets(reps)
    small = lambda x: zlib.compress(x.tobytes(), 1)

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        own = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        count = np.array([len(x) for x in own], np.int64)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        order, h, edges, some = _packed(np.concatenate(own).view(np.uint64), buckets)
        i, n, p = (x[order] for x in (np.repeat(ids, count).astype(np.int64), np.repeat(sizes, count).astype(np.int32), place.astype(np.int32)))
        parts = [slice(edges[k], edges[k + 1]) for k in some]
        cols = [[h[x].tobytes() for x in parts], [small(np.diff(i[x], prepend=np.int64(0))) for x in parts], [small(n[x]) for x in parts], [small(p[x]) for x in parts]]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], ["bucket", "h", "id", "n", "place"])

    def again(rows: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(rows["h"].to_pylist()), np.uint32)
        i = np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), np.int64)) for x in rows["id"].to_pylist()])
        n, p = (np.frombuffer(b"".join(map(zlib.decompress, rows[c].to_pylist())), np.int32) for c in ("n", "place"))
        order = np.lexsort((i, h))
        same = h[order][1:] == h[order][:-1]
        keep = order[np.append(same, False) | np.append(False, same)]
        h, i, n, p = h[keep], i[keep], n[keep].astype(np.int64), p[keep].astype(np.int64)
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        size = np.diff(np.append(begin, len(h)))
        lead, many = np.repeat(begin, size), np.repeat(size, size) > 2
        star = (np.minimum(n - p, n[lead] - p[lead]) >= least_shared(n + n[lead], least)) & (i != i[lead])
        some = many | star
        whole = h.astype(np.int64) + (rows["bucket"][0].as_py() << 32)
        return pa.table({"h": whole[some], "id": i[some], "n": n[some], "place": p[some], "first": i[lead][some], "star": star[some], "many": many[some]})

    packed = common.map_batches(reps.select("_id", "n", "prefix"), spread, "bucket int, h binary, id binary, n binary, place binary")
    return common.cut(packed.groupBy("bucket").applyInArrow(common.of_group(again), "h long, id long, n long, place long, first long, star boolean, many boolean"))


def stars(rows: DataFrame) -> DataFrame:
    """(a, b), each once: every document with the first one at each of its shingles; no more pairs than places."""
    return rows.filter("star").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()


def candidates(rows: DataFrame, joined: DataFrame, least: Fraction) -> DataFrame:
    """(a, b), each once: documents of ``rows`` at one shingle that ``joined(node, component)`` does not connect yet.

    A shingle whose documents are all connected is left out whole, so a group of near copies makes no pairs here.
    """
    rows = rows.filter("many")  # two documents at a shingle are a star
    told = rows.join(joined, rows["id"] == joined["node"], "left").select("h", "id", "n", "place", F.coalesce("component", "id").alias("c"))
    known = told.groupBy("h").agg(F.count("*").alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 < c1").select("h", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = told.join(known, "h").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "id", "c", "n", "place")
    dealt = dealt.select("h", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "c", "n", "place")
    keys = ["h", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), np.int64)
        for batch in batches:
            cols = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
            if not len(cols):
                continue
            cuts = np.flatnonzero((cols[1:, :3] != cols[:-1, :3]).any(axis=1)) + 1
            held = cols[cuts[-1] :] if len(cuts) else cols
            if len(cuts):
                yield _met(cols, np.concatenate([[0], cuts[:-1]]), cuts, least)
        if len(held):
            yield _met(held, np.array([0]), np.array([len(held)]), least)

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def links(every: DataFrame, pairs: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(a, b): edges that join all ``pairs`` at Jaccard ``least`` or more of the documents ``every(_id, _text)``.

    Documents that candidate pairs connect come to one task, each text once, and a pair that found edges connect already
    is not compared.  Where more than ``GROUP`` documents are connected, their pairs are dealt out by b; a text goes
    once to each task that has a pair of it.
    """
    buckets = _buckets(pairs)
    met = common.components(pairs)
    parts = met.groupBy("component").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    met = met.join(parts, "component")
    task = F.pmod(F.xxhash64("component", F.pmod(F.xxhash64("b"), F.col("parts"))), F.lit(buckets)).cast("int").alias("task")
    dealt = common.cut(pairs.join(met, pairs["b"] == met["node"]).select("a", "b", task))
    asked = stored(dealt.select("task", F.explode(F.array("a", "b")).alias("_id")).distinct())  # few rows of known size bring no texts to them

    slot = F.pmod(F.xxhash64("_id"), F.lit(SLOTS))
    flags = np.zeros(SLOTS, bool)
    flags[asked.select(slot.alias("s")).distinct().toArrow()["s"].to_numpy()] = True  # SLOTS bounds it
    flagged = pairs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The documents whose slot is asked for, so that no other text is shuffled."""
        at = batch.column(2).to_numpy(zero_copy_only=False)
        return batch.select(["_id", "_text"]).filter(pa.array((flagged.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))

    def near(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return least.denominator * both >= least.numerator * (len(x) + len(y) - both)

    def together(own: pa.Table, asked: pa.Table) -> pa.Table:
        sets = {i: shingle_set(t, shingle) for i, t in zip(own["_id"].to_pylist(), own["_text"].to_pylist(), strict=True)}
        root = {i: i for i in sets}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for a, b in zip(asked["a"].to_pylist(), asked["b"].to_pylist(), strict=True):
            if (x := top(a)) != (y := top(b)) and near(sets[a], sets[b]):
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    texts = common.map_batches(every.select("_id", "_text", slot.alias("slot")), whole, "_id long, _text binary")
    brought = asked.join(texts, "_id").select("_id", "_text", F.col("task").alias("at"))
    return brought.groupBy("at").cogroup(dealt.groupBy("task")).applyInArrow(common.of_group(together), "a long, b long")


def near_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, told: DataFrame | None = None) -> DataFrame:
    """(id, component_id) of every row: documents linked by pairs at Jaccard ``least`` or more, exactly.

    Texts are lower-cased in A-Z and split at ASCII white space; a text of fewer words than a shingle is one shingle.
    Null counts as empty, and texts without words are one class.  ``told(a, b)`` are pairs that another method found: they are
    checked with the first ones.  component_id is the smallest id reachable.  Ids must
    not be null; repeated rows return as often as they come in.
    """
    least = Fraction(str(least))
    every = docs.select(F.col(id_col).cast("long").alias("_id"), common.utf8(text_col).alias("_text"))
    buckets = _buckets(every)
    held = docs.sparkSession.sparkContext.broadcast(frequent(every, every.select("_id").count(), shingle))  # FREQUENT bounds it

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        often, times = held.value
        keys, sizes, prefixes, signs = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_set(text, shingle)
            n = len(own)
            rank = np.zeros(n, np.int64)
            if n and len(often):
                known = ((own % np.uint64(buckets)) << np.uint64(32) | own >> np.uint64(32)).astype(np.int64)
                at = np.minimum(np.searchsorted(often, known), len(often) - 1)
                rank = np.where(often[at] == known, times[at], 0)
            most = n - -(-least.numerator * n // least.denominator) + 1 if n else 0
            keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            sizes.append(n)
            signs.append(signature(own))
            prefixes.append(own[np.argsort(rank, kind="stable")[:most]].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(signs, pa.list_(pa.int64()))], ["_id", "key", "n", "prefix", "sig"])

    keyed = common.cut(common.map_batches(every, work, "_id long, key binary, n long, prefix binary, sig array<long>"))
    firsts = common.cut(keyed.groupBy("key").agg(F.min("_id").alias("rep")))
    reps = keyed.join(firsts, (keyed["key"] == firsts["key"]) & (keyed["_id"] == firsts["rep"]), "left_semi")
    rows = places(reps, least)
    first = stars(rows)
    if told is not None:
        of = keyed.join(firsts, "key").select("_id", "rep").distinct()
        ends = told.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").filter("x <> y")
        first = first.union(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    edges = common.cut(links(every, common.cut(possible(first, reps, least)), shingle, least))
    pairs = common.cut(possible(candidates(rows, common.components(edges), least), reps, least))
    roots = common.components(edges.union(links(every, pairs, shingle, least)))
    named = firsts.join(roots, firsts["rep"] == roots["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return keyed.join(named, "key").select(F.col("_id").alias(id_col), "component_id")
