"""Fill-in-middle: documents cut at unit boundaries and put together with the middle last.

Counting a text's units also records a sparse index, the byte and code-point offset of every so-many-th unit, block by block.
A cut is then found by binary search among the checkpoints and a short rescan from the one before it, so no array as long as
the text is ever held.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Units between two checkpoints; bytes that one step of counting and of a rescan looks at.
EVERY, BLOCK, STEP = 1024, 1 << 16, 1 << 12


def _begins(piece: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether each byte begins a unit and whether it begins a code point; whether the last byte is a letter."""
    low = piece | 32
    letter = (low >= 97) & (low <= 122)
    within = letter.copy()
    within[0] &= after_letter
    within[1:] &= letter[:-1]
    lead = (piece & 0xC0) != 0x80
    return lead & ~within, lead, bool(letter[-1])


class Checkpoints:
    """Units of a text, each a run of letters A-Z a-z or any other code point, and where to find them."""

    def __init__(self, raw: bytes, every: int = EVERY, block: int = BLOCK):
        self.bytes = np.frombuffer(raw, np.uint8)
        self.n = self.chars = 0
        marks: list[np.ndarray] = []
        letter = False
        for at in range(0, len(self.bytes), block):
            begins, lead, letter = _begins(self.bytes[at : at + block], letter)
            where = np.flatnonzero(begins)
            marked = where[(-self.n) % every :: every]
            if len(marked):
                marks.append(np.stack([self.n + (-self.n) % every + np.arange(len(marked)) * every, at + marked, self.chars + np.cumsum(lead)[marked] - 1]))
            self.n += len(where)
            self.chars += int(lead.sum())
        self.units, self.offsets, self.points = np.concatenate(marks, axis=1) if marks else np.zeros((3, 0), np.int64)

    def at(self, unit: int, step: int = STEP) -> tuple[int, int]:
        """(byte offset, code-point offset) at which ``unit`` begins; the text's end for the number of units."""
        if unit >= self.n:
            return len(self.bytes), self.chars
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        left, at, points = unit - int(self.units[k]), int(self.offsets[k]), int(self.points[k])
        letter = False
        while left:
            begins, lead, letter = _begins(self.bytes[at : at + step], letter)
            where = np.flatnonzero(begins)
            # the checkpoint's own unit begins the first piece
            if at == self.offsets[k]:
                where = where[1:]
            if len(where) >= left:
                to = int(where[left - 1])
                return at + to, points + int(lead[:to].sum())
            left -= len(where)
            points += int(lead.sum())
            at += len(begins)
        return at, points


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits for a document; the same at each run.  A null id stands as no digits."""
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearrange(raw: bytes, doc_id: int | None, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    index = Checkpoints(raw)
    h1, h2, h3, h4 = draws(doc_id, seed)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= plain_from:
        return index.n, "plain", None, None, raw
    (b1, c1), (b2, c2) = (index.at(u) for u in sorted((h1 % (index.n + 1), h2 % (index.n + 1))))
    prefix, middle, suffix = raw[:b1], raw[b1:b2], raw[b2:]
    if h4 % 100 < spm_below:
        return index.n, "spm", c1, c2 - c1, s + suffix + p + prefix + m + middle
    return index.n, "psm", c1, c2 - c1, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs(doc_id long, text)``.

    No shuffle: a text is cut where it lies.  A null text counts as empty and an empty text stays plain; rows that repeat an
    id are cut by the same draws, each in its own text; a row without an id draws as if its id had no digits.  Other columns
    are not read.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [rearrange(raw or b"", i, seed, plain_from, spm_below) for i, raw in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)]
        n, form, prefix, middle, output = zip(*made, strict=True)
        return pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.

    No mark occurs in such a text or across a cut, as none ends with its own beginning; so each stands in ``output`` once.
    """

    def part(text: Column, mark: str, k: int) -> Column:
        return F.split_part(text, F.lit(mark), F.lit(k))

    middle = part(output, MIDDLE, 2)
    psm = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    spm = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, PREFIX, 1), SUFFIX, 2))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
