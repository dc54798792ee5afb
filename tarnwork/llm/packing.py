"""Packing of tokenised documents into sequences by swap-based local search.

Documents are tokenised where they lie.  Their pieces, as a few numbers each, are dealt to groups of a bounded number of
documents by a hash of the id, and each group is packed by itself; a group loses less than about one sequence.  A group
starts from the fill of its documents in the order of their ids; moves and exchanges between underfull bins do the rest.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .substrings import _SPACE

#: Documents that one group packs together.
GROUP = 16_384
#: Chunks, and pieces of chunks, that a worker remembers; then it starts anew.
CACHE = 400_000
#: Bytes of text that are encoded at a time.
STEP = 1 << 20
#: Letters whose upper and lower case, composition and class are the same to every Unicode library, and whose lower case is
#: among them: Latin, Greek without the sigma, whose lower case depends on its place, and Cyrillic.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſΑ-ΡΤ-Ωά-ώЀ-ҁҊ-ԯ"
#: How the vocabulary parts a lower-cased chunk; a line feed stands between chunks.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+|\n")
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+").fullmatch
_ODD = re.compile(rf"[^\t-\r -~{_LETTERS}]").search
#: Of a byte of a text of such letters and ASCII signs: 0 white space, 1 letter, 2 digit, 3 sign.
_KIND = np.full(256, 1, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[9, 10, 11, 12, 13, 32]] = 0


def byte_letters() -> dict[int, str]:
    """The letter for each byte by the usual rule: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)}.difference(own)))}


class Numbered:
    """Token ids of strings, each under a number, in flat arrays that grow."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def clear(self) -> None:
        self.__init__()

    def add(self, strings: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        total, first, last = len(ids), len(self.number), len(self.number) + len(strings)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        self.flat[self.used : self.used + total] = ids
        self.size[first:last], self.begin[first:last] = sizes, self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.number.update(zip(strings, range(first, last), strict=True))

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered strings one after another, and how many each has."""
        size = self.size[which]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        return self.flat[np.arange(n) + np.repeat(self.begin[which] - total + size, size)], size


@lru_cache(1)
def tokenizer(path: str):
    """One for each worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Ids:
    """Token ids of whole texts, as the tokenizer's ``encode(text, add_special_tokens=False)`` gives them.

    The tokenizer lower-cases, drops white space and takes runs of letters, digits and runs of signs each by itself.  A text
    of common letters and ASCII signs is parted by the kinds of its bytes, and each new part is encoded by the vocabulary's
    model.  Any other text is parted at ASCII white space alone, across which the tokenizer never looks, and new chunks
    with other signs go to the tokenizer as they are; so does a whole text that holds a special token's string, which is
    taken for that token.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(map(re.escape, special))) if special else None
        #: Only a vocabulary whose settings part texts as ``_PARTS`` does is read by parts.
        self.by_parts = self._parts_agree()
        self.chunks, self.runs = Numbered(), Numbered()

    def _parts_agree(self) -> bool:
        sample = "It's THEY'LL \"quoted\"... Ünïcode-näme Привет Ωμέγα x2 3.14 <a|b> a_b don't!!".split()
        alone = [e.ids for e in self.tokenizer.encode_batch_fast(sample, add_special_tokens=False)]
        return alone == [[i for part in _PARTS.findall(c.lower()) for i in self._ids(part)] for c in sample]

    def _ids(self, part: str) -> list[int]:
        if part == "\n":
            return []
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def _learn_parts(self, parts: list[str]) -> None:
        each = list(map(self._ids, parts))
        self.runs.add(parts, np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each)))

    def _learn(self, chunks: list[str]) -> None:
        plain = [c for c in chunks if self.by_parts and _PLAIN(c)]
        if plain:
            parts = _PARTS.findall("\n".join(plain).lower())
            if len(self.runs.number) > CACHE:
                self.runs.clear()
            known = self.runs.number
            if new := list(set(parts).difference(known)):
                self._learn_parts(new)
            which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            ids, size = self.runs.gather(which)
            before = np.concatenate([[0], np.cumsum(size)])
            ends = np.append(np.flatnonzero(which == known["\n"]) if len(plain) > 1 else np.zeros(0, np.int64), len(parts))
            self.chunks.add(plain, ids, np.diff(before[ends], prepend=0))
        if len(plain) < len(chunks):
            other = [c for c in chunks if not (self.by_parts and _PLAIN(c))]
            each = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
            self.chunks.add(other, np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each)))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of UTF-8 texts."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        plain, other, low = [], [], []
        for i, t in enumerate(texts):
            if self.special and self.special.search(t):
                out[i] = np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, np.uint32)
            elif self.by_parts and not _ODD(text := t.decode()):
                plain.append(i)
                low.append(text.lower().encode())
            else:
                other.append(i)
        for which, found in ((plain, self._by_parts(low)), (other, self._by_chunks([texts[i] for i in other]))):
            for i, ids in zip(which, found, strict=True):
                out[i] = ids
        return out

    def _by_parts(self, low: list[bytes]) -> list[np.ndarray]:
        """Lower-cased texts of common letters and ASCII signs, parted by the kinds of their bytes."""
        data = np.frombuffer(b" ".join([*low, b"   "]), np.uint8)
        kind = _KIND[data]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= kind == 2
        mark = np.flatnonzero((data == 39) & first)
        mark = mark[kind[mark + 1] == 1]  # an apostrophe by itself before a letter; some endings belong to it
        x, y = data[mark + 1], data[mark + 2]
        size = np.where(np.isin(x, np.frombuffer(b"stmd", np.uint8)), 1, 2 * (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)))
        mark, size = mark[size > 0], size[size > 0]
        first[mark + 1] = False
        first[mark + 1 + size] = True
        inside = kind > 0
        limits = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
        return self._numbered(data, first & inside, inside, limits, self.runs, self._learn_parts)

    def _by_chunks(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b" ".join([*texts, b" "]), np.uint8)
        inside = ~_SPACE[data]
        first = inside & np.concatenate([[True], ~inside[:-1]])
        limits = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
        return self._numbered(data, first, inside, limits, self.chunks, self._learn)

    def _numbered(self, data: np.ndarray, first: np.ndarray, inside: np.ndarray, limits: np.ndarray, held: Numbered, learn) -> list[np.ndarray]:
        """The ids of each text: its strings begin at ``first``, and bytes not ``inside`` belong to none."""
        offsets = np.flatnonzero(first[inside])
        offsets = np.append(offsets, np.count_nonzero(inside)).astype(np.int32)
        found = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
        own = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(held.number.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(number < 0)
        if len(held.number) + len(new) > CACHE and held.number:
            held.clear()
            new = np.arange(len(own))
        if len(new):
            learn([own[k] for k in new.tolist()])
            number[new] = np.fromiter((held.number[own[k]] for k in new.tolist()), np.int64, len(new))
        ids, size = held.gather(number[found.indices.to_numpy()])
        before = np.concatenate([[0], np.cumsum(size)])
        cuts = before[np.searchsorted(np.flatnonzero(first), limits)].tolist()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []


def encoded_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str, text_col: str, groups: int) -> DataFrame:
    """(grp, id, starts, lengths, crcs): one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Ids(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            starts, lengths, crcs = [], [], []
            for a, b in common.steps(texts, STEP):
                for got in coder.encode(texts[a:b]):
                    whole = np.append(got, np.uint32(end_id)).astype("<u4")
                    cuts = range(0, len(whole), capacity)
                    starts.append(list(cuts))
                    lengths.append([min(capacity, len(whole) - c) for c in cuts])
                    crcs.append([zlib.crc32(whole[c : c + capacity]) for c in cuts])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(2), ids, pa.array(starts, kind), pa.array(lengths, kind), pa.array(crcs, kind)], ["grp", id_col, "starts", "lengths", "crcs"])
        del coder
        common.give_back()

    chosen = docs.select(F.col(id_col).cast("long").alias(id_col), common.utf8(text_col).alias("_text"), F.pmod(F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col)), F.lit(groups)).alias("grp"))
    return chosen.mapInArrow(run, f"grp long, {id_col} long, starts array<long>, lengths array<long>, crcs array<long>")


def next_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers in their order; a bin is closed by the first item that it has no room for."""
    bins: list[list[int]] = []
    free = 0
    for i, n in enumerate(lengths.tolist()):
        if n > free:
            bins.append([])
            free = capacity
        bins[-1].append(i)
        free -= n
    return bins


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []  # (free space, bin), in order
    size = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k = capacity, len(bins)
            bins.append([])
        bins[k].append(i)
        if room > size[i]:
            insort(free, (room - size[i], k))
    return bins


def packed(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins by the local search, never more than best fit, longest first, takes.

    The search starts from next fit.  Moves and exchanges that each have to gain can end where no single one does; if best
    fit then has fewer bins, the search starts again from those.
    """
    bins = local_search(next_fit(lengths, capacity), lengths, capacity)
    if len(bins) > max(1, -(-int(lengths.sum()) // capacity)) and len(other := best_fit(lengths, capacity)) < len(bins):
        bins = local_search(other, lengths, capacity)
    return bins


class Bins:
    """Bins of items, with the free space of the underfull ones in order."""

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.size, self.lengths, self.capacity = [set(b) for b in bins], lengths.tolist(), lengths.astype(np.int64), capacity
        self.of = np.empty(len(lengths), np.int64)
        for k, b in enumerate(bins):
            self.of[b] = k
        self.free = np.array([capacity - sum(self.size[i] for i in b) for b in bins], np.int64)
        self.order = sorted((f, k) for k, f in enumerate(self.free.tolist()) if 0 < f < capacity)
        self.held: tuple[np.ndarray, ...] | None = None

    def _fill(self, k: int, change: int) -> None:
        f = int(self.free[k])
        if 0 < f < self.capacity:
            self.order.pop(bisect_left(self.order, (f, k)))
        self.free[k] = f = f - change
        if 0 < f < self.capacity:
            insort(self.order, (f, k))

    def put(self, i: int, giver: int, k: int, back: tuple[int, ...]) -> None:
        """Item ``i`` goes from ``giver`` to bin ``k``, the items ``back`` the other way."""
        change = self.size[i] - sum(self.size[j] for j in back)
        self.held = None
        self.bins[giver].remove(i)
        self.bins[k].add(i)
        self.of[i] = k
        for j in back:
            self.bins[k].remove(j)
            self.bins[giver].add(j)
            self.of[j] = giver
        self._fill(giver, -change)
        self._fill(k, change)

    def move(self, i: int, giver: int) -> int | None:
        """The fullest other bin that has room."""
        at = bisect_left(self.order, (self.size[i], -1))
        while at < len(self.order) and self.order[at][1] == giver:
            at += 1
        return self.order[at][1] if at < len(self.order) else None

    def _items(self) -> tuple[np.ndarray, ...]:
        """The items of underfull bins by bin and length: number, bin, length, free space of the bin, sort key."""
        if self.held is None:
            free = self.free[self.of]
            items = np.flatnonzero(free > 0)
            key = self.of[items] * (self.capacity + 1) + self.lengths[items]
            order = np.argsort(key)
            items = items[order]
            self.held = items, self.of[items], self.lengths[items], free[items], key[order]
        return self.held

    def one(self, i: int, giver: int) -> tuple[int, tuple[int, ...]] | None:
        """The exchange for one shorter item that raises the squared fill most."""
        n = self.size[i]
        items, of, size, free, _ = self._items()
        k = np.flatnonzero((size < n) & (size + free >= n) & (of != giver))
        if not len(k) or (best := self._best(n - size[k], free[k], giver)) is None:
            return None
        return int(of[k[best]]), (int(items[k[best]]),)

    def two(self, i: int, giver: int) -> tuple[int, tuple[int, ...]] | None:
        """The exchange for two items of one bin, together shorter, that raises the squared fill most."""
        n = self.size[i]
        items, of, size, free, key = self._items()
        k = np.flatnonzero((size < n) & (of != giver))
        need = np.maximum(n - free[k] - size[k], 1)  # of the partner, at least
        mate = np.searchsorted(key, key[k] - size[k] + need)
        mate += mate == k
        some = np.flatnonzero(mate < len(key))
        k, mate = k[some], mate[some]
        some = np.flatnonzero((of[mate] == of[k]) & (size[mate] + size[k] < n))
        if not len(some):
            return None
        k, mate = k[some], mate[some]
        if (best := self._best(n - size[k] - size[mate], free[k], giver)) is None:
            return None
        return int(of[k[best]]), (int(items[k[best]]), int(items[mate[best]]))

    def _best(self, shift: np.ndarray, free: np.ndarray, giver: int) -> int | None:
        """By 2 shift (fill of the receiver - fill of the giver + shift), which is what the squared fills gain."""
        gain = shift * (self.free[giver] - free + shift)
        best = int(gain.argmax())
        return best if gain[best] > 0 else None


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Move and exchange documents between underfull bins while that raises the sum of squared fills, until bins empty.

    A pass goes over the underfull bins from the emptiest on.  Each gives, its longest document first: to the fullest bin
    that has room, else in exchange for one shorter document, else for two of one bin that are shorter together.  A bin
    left empty goes.  The search ends with a pass in which no bin could give, or at the least possible number of bins.
    """
    held = Bins(bins, lengths, capacity)
    least = -(-int(lengths.sum()) // capacity)
    alive, gained = len(bins), True
    while alive > least and gained:
        gained = False
        for _, giver in reversed(held.order[:]):
            if not held.bins[giver] or not held.free[giver]:
                continue
            for i in sorted(held.bins[giver], key=held.size.__getitem__, reverse=True):
                if (k := held.move(i, giver)) is not None and held.size[i] + held.free[giver] - held.free[k] > 0:
                    held.put(i, giver, k, ())
                elif (found := held.one(i, giver) or held.two(i, giver)) is not None:
                    held.put(i, giver, *found)
                else:
                    continue
                gained = True
            alive -= not held.bins[giver]
            if alive <= least:
                break
    return [sorted(b) for b in held.bins if b]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Ids are those of the tokenizer's ``encode(text, add_special_tokens=False)`` as it comes from its file.
    A document is its token ids and ``end_id``; null counts as empty.  Documents over ``capacity`` are cut into pieces of
    that length and a rest.  Repeated rows are packed as often as they come in; an empty table gives an empty result.
    """
    groups = max(1, -(-docs.count() // GROUP))

    def place(rows: pa.Table) -> pa.Table:
        group = rows["grp"][0].as_py()
        rows = rows.take(pa.compute.sort_indices(rows[id_col]))  # a lost task packs the same way again
        ids = rows[id_col].combine_chunks().take(pa.array(np.repeat(np.arange(len(rows)), [len(x) for x in rows["starts"].to_pylist()])))
        starts, lengths, crcs = (rows[c].combine_chunks().flatten().to_numpy() for c in ("starts", "lengths", "crcs"))
        part = np.flatnonzero(lengths < capacity)
        bins = packed(lengths[part], capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = np.flatnonzero(lengths == capacity)
        sequence[full] = np.arange(len(full)) + len(bins)
        for k, items in enumerate(bins):
            at = part[items]
            sequence[at] = k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
        columns = (ids, starts // capacity, starts, lengths, crcs, sequence + (group << 32), offset)
        return pa.table({n: pa.array(c, t) for n, c, t in zip((id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), columns, (pa.int64(), pa.int32(), *[pa.int64()] * 5), strict=True)})

    pieces = encoded_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, groups)
    return pieces.groupBy("grp").applyInArrow(common.of_group(place), f"{id_col} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
