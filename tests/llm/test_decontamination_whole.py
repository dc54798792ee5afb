"""Decontamination over letters of all scripts and over items of every length, against brute force."""

import random

from tarnwork.llm import decontamination


def test_case_of_all_letters(spark):
    items = ["El niño pequeño también cantó canción tras canción en la montaña más lejana", "Élève à l'école, où l'été a été très légèrement gêné par la forêt", "Много слов о том, как большая река впадает в холодное море", "Die große Straße führt über die schöne Brücke zum weißen Schloss"]
    docs = spark.createDataFrame([(i, f"before {t.upper()} after") for i, t in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start, r.edits) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(i, i, 7, 0) for i in range(len(items))}


def least_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edits_in_items_of_every_length():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    items = [word(n) for n in range(1, 60) for _ in range(3)]
    texts = []
    for t in items:
        for _ in range(2):
            near = list(t)
            for _ in range(rng.randint(0, int(len(t) * decontamination.RATE) + 1)):
                at = rng.randrange(len(near))
                near[at : at + 1] = rng.choice(["", "z", near[at] + "y"])
                near = near or [""]
            texts.append(word(5) + "".join(near) + word(5))
    held = decontamination.Items(list(range(len(items))), items)
    got = {(t, i, e) for t, i, _, e in held.found(texts)}
    want = {(t, i, e) for t, text in enumerate(texts) for i, item in enumerate(items) if (e := least_edits(item, text)) <= int(len(item) * decontamination.RATE)}
    assert got == want


def test_hits_of_a_repeated_letter_are_counted_in_parts(monkeypatch):
    items = decontamination.Items([1, 2], ["a" * 300, "b" * 40 + "c" * 60])
    texts = ["a" * 3000, "x " + "b" * 40 + "c" * 60, "a" * 299 + "b", ""]
    whole = [x.tolist() for x in items.bands(texts)]
    monkeypatch.setattr(decontamination, "HITS", 700)
    parts = [x.tolist() for x in items.bands(texts)]
    assert parts == whole
    assert {(t, i) for t, i in zip(*whole[:2])} >= {(0, 0), (1, 1), (2, 0)}
    assert {(t, i) for t, i, *_ in items.found(texts)} == {(0, 1), (1, 2), (2, 1)}


def test_chunks_cover_all():
    import numpy as np

    for count in ([], [5], [0, 0], [9, 1, 1, 0, 20, 3]):
        found = list(decontamination.chunks(np.array(count, int), 10))
        assert [i for a, b in found for i in range(a, b)] == list(range(len(count)))
        assert all(sum(count[a:b]) <= 10 or b == a + 1 for a, b in found)
