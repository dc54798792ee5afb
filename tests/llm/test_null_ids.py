"""Rows with a null id amid repeated texts: a document each, after all others."""

import hashlib

import corpus_pipeline
import pytest
from tarnwork.llm import decontamination, embeddings, packing, simhash, substrings, suffixes
from tarnwork.llm.queries import tokenizer_path

LONG = " ".join(f"word{i}" for i in range(60))
OWN = " ".join(f"other{i}" for i in range(60))
ROWS = [(1, LONG), (2, "head " + LONG), (None, OWN), (None, "x y z " + LONG), (3, LONG), (None, OWN)]
SCHEMA = "doc_id long, text string"


def result(rows):
    """(id, kept) over the rows in order, nulls last: the long text and the own one go wherever they stand again."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        for passage in (LONG, OWN):
            if passage in text:
                text = text.replace(passage, "") if passage in seen else text
                seen.add(passage)
        out.append((i, text))
    return sorted(((i, t) for i, t in out), key=repr)


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_words(spark, parts):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1) if parts == 1 else spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    got = sorted(((r.doc_id, r.kept) for r in substrings.drop_repeated_windows(docs).collect()), key=repr)
    assert got == [(i, t.strip()) for i, t in result(ROWS)]


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_bytes(spark, parts):
    docs = spark.createDataFrame([(i, t, "c") for i, t in ROWS], SCHEMA + ", lang string")
    got = suffixes.drop_repeated_bytes(docs.coalesce(1) if parts == 1 else docs.repartition(parts), carry=("lang",)).collect()
    found = sorted(((r.doc_id, bytes(r.kept).decode()) for r in got), key=repr)
    want = [(i, t[:-1] if t in ("head ", "x y z ") else t) for i, t in result(ROWS)]  # the space before a passage repeats only with it
    assert [(i, t.rstrip()) for i, t in found] == [(i, t.rstrip()) for i, t in want]
    assert all(r.lang == "c" and r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got)


def test_stage_keeps_documents_without_id(spark):
    data = [(1, LONG), (None, LONG), (None, OWN), (None, OWN), (None, "a text of its own, without an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], SCHEMA + ", lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)
    assert got == sorted([data[0], data[2], data[4]], key=repr)


def test_items_without_id(spark):
    docs = spark.createDataFrame([(1, "some " + LONG), (None, LONG), (2, OWN)], SCHEMA)
    bench = spark.createDataFrame([(None, LONG), (7, LONG)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, None), (1, 7), (None, None), (None, 7)}
    assert [r.doc_id for r in decontamination.without_items(docs, bench).collect()] == [2]


def test_packing_of_rows_without_id(spark):
    docs = spark.createDataFrame([(1 << 60 | 1, LONG), (None, LONG), (None, None)], SCHEMA)
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    assert {r.doc_id for r in got} == {1 << 60 | 1, None}
    assert sum(r.length for r in got if r.doc_id is None) == sum(r.length for r in got if r.doc_id) + 1


def test_fingerprints_of_rows_without_id(spark):
    docs = spark.createDataFrame([(5, LONG), (None, LONG), (2, LONG), (None, OWN), (None, OWN)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == [(2, 2), (5, 2), (None, 2), (None, None), (None, None)]


def test_vectors_without_id(spark):
    rows = [(5, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (7, None, 1), (None, None, 1), (8, [0.0, 1.0], 2)]
    got = sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
    assert got == sorted([(5, 2, 2, False), (None, 2, 2, False), (2, 2, 2, True), (None, 0, None, True), (7, 0, 7, True), (None, 0, None, True), (8, 0, 8, True)], key=repr)
