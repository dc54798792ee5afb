"""The pipeline's stage of near copies against brute force on planted ones."""

import random
import re

import corpus_pipeline
import numpy as np
from tarnwork.llm import nearsets


def planted():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(24):
        base = [rng.choice(words) for _ in range(rng.randint(40, 200))] + ["the", "same", "last", "line", "in", "all"]
        texts.append(base)
        for edits in range(1, 5):
            near = list(base)
            for at in rng.sample(range(len(near)), edits):
                near[at] = f"x{k}{edits}{at}"
            texts.append(near)
    texts += [["One", "two"], ["one", "TWO"], ["one"], []]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None)]


def brute(data):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_stage_drops_all_near_copies(spark):
    data = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute(data)
    assert len(set(want)) < len(data) - 40
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(want)


def test_near_sets_whatever_the_order_and_blocks(spark, monkeypatch):
    data = planted()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    monkeypatch.setattr(nearsets, "BLOCK", 2)
    monkeypatch.setattr(nearsets, "FREQUENT", 3)
    got = {r.doc_id: r.component_id for r in nearsets.near_sets(docs).collect()}
    assert got == dict(enumerate(brute(data)))


def test_near_sets_of_many_connected_documents(spark, monkeypatch):
    data = planted()
    monkeypatch.setattr(nearsets, "GROUP", 3)
    got = {r.doc_id: r.component_id for r in nearsets.near_sets(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute(data)))


def test_two_documents_at_a_shingle_leave_no_place_but_a_star(spark):
    prefix = lambda *h: np.array(h, np.uint64).tobytes()
    rows = [(1, 10, prefix(5, 7 << 40, 9)), (2, 11, prefix(5, 8)), (3, 90, prefix(7 << 40)), (4, 10, prefix(9)), (-6, 10, prefix(9))]
    reps = spark.createDataFrame(rows, "_id long, n long, prefix binary")
    got = {(r.id, r.n, r.place, r.first, r.star, r.many) for r in nearsets.places(reps, nearsets.Fraction("0.8")).collect()}
    # 1 and 3 meet, but their sizes are too far apart; three documents are at 9
    assert got == {(2, 11, 0, 1, True, False), (-6, 10, 0, -6, False, True), (1, 10, 2, -6, False, True), (4, 10, 0, -6, True, True)}


def test_the_sample_of_shingles_keeps_up_with_the_table(spark, monkeypatch):
    """A shingle in every twentieth of many documents is told, however few the least sample has."""
    monkeypatch.setattr(nearsets, "SAMPLE", 4)
    text = lambda i: " ".join([*(f"w{i}_{j}" for j in range(9)), *(f"often{i % 20}_{j}" for j in range(5))])
    docs = spark.createDataFrame([(i, text(i).encode()) for i in range(4000)], "_id long, _text binary")
    keys, times = nearsets.frequent(docs, 4000, 5)
    assert len(keys) >= 20 and (np.diff(keys) > 0).all() and (times > 1).all()


def test_near_sets_of_an_empty_table(spark):
    assert nearsets.near_sets(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_never_exceed_the_difference():
    rng = random.Random(3)
    for _ in range(200):
        x = {rng.getrandbits(64) for _ in range(rng.randint(0, 3000))}
        y = set(rng.sample(sorted(x), rng.randint(0, len(x)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 40))}
        a, b = (nearsets.signature(np.array(sorted(s), np.uint64)) for s in (x, y))
        assert len(a) == len(b) == 16
        assert sum(((i ^ j) & (1 << 64) - 1).bit_count() for i, j in zip(a, b, strict=True)) <= len(x ^ y)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    """A near copy goes though its id stands at another text too, and that text stays; of equal rows one stays."""
    own = lambda p: " ".join(f"{p}{i}" for i in range(60))
    rows = [(3, own("a")), (5, own("b")), (5, own("a") + " z"), (6, own("c")), (6, own("c")), (7, own("d")), (7, own("e")), (8, own("e") + " q"), (9, own("d") + " q"), (None, own("b")), (None, own("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([rows[0], rows[1], rows[3], rows[5], rows[6], rows[10]], key=repr)
    left = {(r.doc_id, r.text) for r in corpus_pipeline.drop_repeated_strings(spark, docs, "").collect()}
    assert {rows[0], rows[1], rows[3], rows[5], rows[6], rows[10], (6, ""), (8, " q"), (9, " q")} <= left


def test_near_copies_of_the_pipeline_come_from_fingerprints_too(spark, monkeypatch):
    """Without any pair of the shingles' prefixes, copies within four bits are still linked, and checked by their sets."""
    from tarnwork.llm import nearsets, simhash

    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearsets, "stars", lambda rows: rows.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(nearsets, "candidates", lambda rows, joined, least: rows.sparkSession.createDataFrame([], "a long, b long"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
