"""License scans: one Aho-Corasick pass finds identifier tags and notice phrases; expressions after a tag are evaluated."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base phrases, and the further notices and identifiers that the method knows.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "licensed under the apache license": "apache", "apache 2 0": "apache", "permission is hereby granted free of charge": "mit", "mit licensed": "mit", "under the mit license": "mit",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "lesser general public license": "lgpl", "gnu affero general public license": "agpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "boost software license": "bsl", "the unlicense": "unlicense", "public domain": "public-domain", "creative commons": "cc", "licensed under cc": "cc", "cc by": "cc", "cc0": "cc0", "all rights reserved": "proprietary",
}
FAMILIES = {"mit": "mit", "mit-0": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "bsl": "bsl", "unlicense": "unlicense", "cc": "cc", "cc0": "cc0", "zlib": "zlib", "wtfpl": "wtfpl", "artistic": "artistic"}
TAG = "spdx license identifier"
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "bsl", "unlicense", "cc0", "public-domain", "zlib", "wtfpl"})

#: Upper case to lower case and every ASCII byte that is no letter or digit to a space; other bytes are parts of words.
WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9.+-]+")
_AFTER_TAG = re.compile(rb"(?i)spdx[^\x30-\x39A-Za-z\x80-\xff]+license[^\x30-\x39A-Za-z\x80-\xff]+identifier[ \t]*:[ \t]*([^\r\n]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The label of an identifier such as ``GPL-2.0-or-later``; None for one that is not known."""
    name = identifier.lower().rstrip("+")
    return FAMILIES.get(name) or FAMILIES.get(re.split(r"[-.]?\d|-", name)[0])


def postfix(expression: bytes) -> list[str] | None:
    """A licence expression by shunting-yard in postfix order; None if it is not well formed.

    ``with`` binds before ``and``, and that before ``or``.  Text after a complete expression ends it.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        word = token.decode()
        low = word.lower()
        if low in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif word == "(":
            if operand:
                break
            stack.append(word)
        elif word == ")":
            if "(" not in stack:
                break
            if not operand:
                return None
            while (top := stack.pop()) != "(":
                out.append(top)
        else:
            if operand:
                break
            out.append(word)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: bytes) -> tuple[list[str], bool] | None:
    """(labels, whether a choice of permissive licences alone satisfies the expression); None if malformed or unknown.

    An exception after ``with`` keeps the licence's own terms.
    """
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[set[str], bool]] = []
    for token in order:
        if token == "with":
            stack.pop()
        elif token in _RANK:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            stack.append((a | b, free_a or free_b if token == "or" else free_a and free_b))
        else:
            name = family(token)
            stack.append(({name} if name else set(), name in PERMISSIVE))
    labels, free = stack[0]
    return (sorted(labels), free) if labels else None


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: TAG}:
        made.add_word(f" {phrase} ", (phrase, BASE.get(phrase), NOTICES.get(phrase)))
    made.make_automaton()
    return made


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, permissive) of every row.

    Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased; null counts as empty.  n_base counts
    every place where the words of a base phrase stand in sequence, and first_word and last_word are the outermost starts
    of those, null without one.  labels adds the notices and the tagged expressions.  score says how sure the scan is:
    0 without a label, 0.6 for a notice, 0.8 for a base phrase, 1 for a tagged, well-formed expression.  permissive: whether
    the expressions can all be met by permissive licences (null without an expression).  Rows keep their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = [_one(text, machine) for text in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]] if rows else [batch.column(0), *[pa.array([], k) for k in kinds]], [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), common.utf8(text_col).alias("_text"))
    return kept.mapInArrow(run, f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")


def _one(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    words = text.translate(WORDS).split()
    line = b" " + b" ".join(words) + b" "
    base, base_labels, labels, tagged, free = [], set(), set(), False, None
    found = list(machine.iter(line.decode("latin-1")))
    if found:
        data = np.frombuffer(line, np.uint8)
        gaps = np.flatnonzero(data == 32)
        tags = 0
        for end, (phrase, of_base, of_notice) in found:
            if of_base:
                base.append(int(np.searchsorted(gaps, end - len(phrase) - 1)))
                base_labels.add(of_base)
            if of_notice:
                labels.add(of_notice)
            tags += phrase == TAG
        if tags:
            for m in _AFTER_TAG.finditer(text):
                if got := evaluate(m[1]):
                    labels.update(got[0])
                    tagged, free = True, got[1] if free is None else free and got[1]
    labels |= base_labels
    score = 1.0 if tagged else 0.8 if base else 0.6 if labels else 0.0
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, free
