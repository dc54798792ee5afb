"""The training-data operators against brute force, and on nulls, empty and repeated rows, empty tables and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tarnwork.llm import decontamination, embeddings, langid, licenses, packing, sharding, simhash, substrings, suffixes, superkmers, toxicity
from tarnwork.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, first long, copy string"  # the last two clash with names used inside


def rows(seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "x", "don't", "naïve", "zeta."]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 160))) for _ in range(24)]
    texts = [*base, base[3], base[3], base[5] + " tail", "head " + base[7], base[8] * 2, "", None, " \n\t", "a" * 400, "word " * 300, None, base[9].replace("x", "y")]
    return [(i, t, None, "c") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(symbols, width):
    """Brute force over [(id, sequence)]: what is covered by a window that also starts earlier."""
    seen, out = set(), {}
    for i, s in sorted(symbols, key=lambda x: x[0]):
        mask = [False] * len(s)
        for j in range(len(s) - width + 1):
            k = tuple(s[j : j + width])
            if k in seen:
                mask[j : j + width] = [True] * width
            seen.add(k)
        out[i] = mask
    return out


def word_result(data):
    want = removed([(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in data], 20)
    return {(i, len(m), sum(m), hashlib.sha256(" ".join(w for w, x in zip(re.findall(r"[^\x20\x09-\x0D]+", t or ""), m, strict=True) if not x).encode()).hexdigest()) for i, t, *_ in data for m in [want[i]]}


def test_repeated_words(docs):
    got = {tuple(r) for r in substrings.drop_repeated_windows(docs).drop("kept").collect()}
    assert got == word_result(rows())


def test_repeated_words_of_hot_anchors(docs, monkeypatch):
    original = superkmers.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda *a: original(*a, 1))
    got = {tuple(r) for r in substrings.drop_repeated_windows(docs).drop("kept").collect()}
    assert got == word_result(rows())


def test_repeated_bytes(docs):
    want = removed([(i, (t or "").encode()) for i, t, *_ in rows()], 100)
    for r in suffixes.drop_repeated_bytes(docs).collect():
        data, mask = (rows()[r.doc_id][1] or "").encode(), want[r.doc_id]
        kept = bytes(b for b, x in zip(data, mask, strict=True) if not x)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(mask), len(re.findall("1+", "".join("1" if x else "0" for x in mask))), hashlib.sha256(kept).hexdigest())


def test_suffix_order():
    rng = random.Random(2)
    for _ in range(50):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        who, length, prefix = suffixes.suffix_order(strings)
        want = sorted((s[i:], k, len(s) - i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert [(k, n) for _, k, n in want] == list(zip(who.tolist(), length.tolist(), strict=True))
        common = [0] + [next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for (a, _, _), (b, _, _) in zip(want, want[1:], strict=False)]
        assert prefix.tolist() == common


def test_simhash(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = []
    for _, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]).encode(), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(i, f"{p:016x}", root[i]) for i, p in enumerate(prints)}


def test_simhash_plan_covers_the_distance():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (1000, 64)).astype(float)
    for n in (100, 10**6, 10**9):
        chosen = simhash.plan(n, bits.T @ bits * n / 1000, 4)
        assert sum(t + 1 for _, t in chosen) == 5
        assert len({b for g, _ in chosen for b in g}) == sum(len(g) for g, _ in chosen)


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = set()
    for i, t, *_ in rows():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for c in range(0, len(ids), 64):
            part = np.array(ids[c : c + 64], "<u4")
            want.add((i, c // 64, c, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-sum(r.length for r in got) // 64) + 3  # 34 rests cannot all fit exactly


def test_local_search_empties_a_bin():
    lengths = np.array([6, 4, 5, 5, 3, 3, 4])
    bins = packing.local_search([[0, 4], [1, 2], [3, 5], [6]], lengths, 10)
    assert sorted(i for b in bins for i in b) == list(range(7)) and len(bins) == 3
    assert all(lengths[b].sum() <= 10 for b in bins)


def test_licenses(spark):
    texts = ["Released under the MIT License. mit  LICENSE", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0", "SPDX-License-Identifier: (MIT OR", "GNU General Public\nLicense and apache-license", None, "", "submit license"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (7, 2, 3, 5, "mit")
    assert got[1].labels == "apache,gpl,mit" and got[1].score == 1.0 and got[1].permissive is False
    assert got[2].labels == "" and got[2].score == 0
    assert (got[3].base_labels, got[3].n_base, got[3].first_word) == ("apache,gpl", 2, 1)
    assert got[4].n_words == got[5].n_words == 0 and got[4].first_word is None
    assert got[6].n_base == 0


def test_licence_expressions():
    assert licenses.postfix(b"MIT OR Apache-2.0 AND BSD-3-Clause") == ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]
    assert licenses.postfix(b"MIT OR") is None and licenses.postfix(b"(MIT") is None and licenses.postfix(b"") is None
    assert licenses.evaluate(b"MIT OR GPL-3.0") == (["gpl", "mit"], True)


def test_alignment():
    def edits(a, b):
        p = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            c = [i]
            for j, y in enumerate(b, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
            p = c
        return min(p)

    rng = random.Random(4)
    for _ in range(300):
        a, b, k = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 18))), rng.randint(0, 4)
        got, want = decontamination.align(decontamination.points(a), decontamination.points(b), k), edits(a, b)
        assert (got[0] if got else None) == (want if want <= k else None)


def test_decontamination(spark):
    rng = random.Random(6)
    item = "".join(rng.choice("abcdefghij ") for _ in range(150)).strip()
    near = item[:40] + "Z" + item[41:90] + item[92:]
    far = item[:70] + "".join(rng.choice("klmnop") for _ in range(80))
    texts = [f"Some text {item.upper()} and on", f"x {near} y", far, None, "", "the short one here"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short one"), (5, item)], "item_id long, text string")
    got = {(r[0], r[1]): r[3] for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(0, 1): 0, (0, 5): 0, (1, 1): 3, (1, 5): 3, (5, 4): 0}
    kept = decontamination.without_items(docs.select("doc_id", "text"), bench)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 4}


def test_sharding(docs):
    got = sharding.shard(docs, 2000).collect()
    assert len(got) == len(rows())
    total = {}
    for r in got:
        total.setdefault((r.shard, r.page), []).append(r.n_bytes)
        assert len(r.shard) == r.depth
    assert all(sum(v) <= 2000 for v in total.values())
    names = sorted({s for s, _ in total})
    assert not any(a != b and b.startswith(a) for a in names for b in names)


def test_sharding_of_one_hot_key(spark):
    docs = spark.createDataFrame([(7, "z" * 100)] * 60, "doc_id long, text string")
    pages = {}
    for r in sharding.shard(docs, 1000).collect():
        pages.setdefault(r.page, []).append(r.n_bytes)
        assert r.shard_bytes == 6000 and r.depth == 32
    assert sum(map(len, pages.values())) == 60 and len(pages) > 3


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 0.12, base[:5] * 2, base[:3]])
    label = np.tile([0, 1, 2], 30)[: len(v)].tolist()
    data = [(i, x.tolist(), int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, base[0].tolist(), None), (904, [None] + [1.0] * 15, 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, label int")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array(label)[:, None] == np.array(label)) & ~np.eye(len(v), dtype=bool)
    root = list(range(len(v)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(v))] == [(int(near[i].sum()), root[i], root[i] == i) for i in range(len(v))]
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903, 904))


def test_language(spark):
    rng = random.Random(5)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    data = [(i, make("abcde" if i % 2 else "vwxyzé"), "aa" if i % 2 else "bb", "s") for i in range(240)]
    data += [(1000, None, "aa", "s"), (1001, "12 34 !", "bb", "s"), (1002, "", None, "s"), (1003, "abc", None, "s")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, score string")).collect()}
    right = [got[i].lang_pred == lang for i, _, lang, _ in data[:240] if got[i].held_out]
    assert len(right) > 50 and np.mean(right) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in ("aa", "bb")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)


def test_language_gradient():
    rng = np.random.default_rng(0)
    model = {"embed": rng.normal(size=(256, langid.EMBED)), "out": rng.normal(size=(48, 3)), "shift": np.zeros(3)}
    for w in langid.WIDTHS:
        model[f"conv{w}"], model[f"bias{w}"] = rng.normal(size=(w, langid.EMBED, langid.FILTERS)), rng.normal(size=langid.FILTERS)
    x, y = rng.integers(1, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -langid.log_softmax(langid.pooled(model, x)[0].astype(float) @ model["out"] + model["shift"])[np.arange(4), y].mean()
    g = langid.gradients(model, x, y)
    for name, at in (("out", (3, 1)), ("conv3", (1, 2, 5)), ("bias2", (4,))):
        old, eps = model[name][at], 1e-3
        model[name][at] = old + eps
        up = loss()
        model[name][at] = old - eps
        down = loss()
        model[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at])


def test_toxicity(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    data, labels = [], []
    for i in range(360):
        w = [rng.choice(words) for _ in range(rng.randint(5, 90))]
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["Vilexx", "vilezz", "nastyq"]))
        data.append((i, " ".join(w), 0.5))
        labels.append((i, int(bad)))
    data += [(1000, None, 0.1), (1001, "", 0.1), (1002, "... !", 0.1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, toxic double")
    got = {r.doc_id: r for r in toxicity.score(docs.drop("toxic"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.85
    assert np.mean([p for p, y in held if y]) >= 0.9
    assert [got[i].score for i in (1000, 1001, 1002)] == [0, 0, 0]
    assert all(got[i].predicted == int(got[i].score >= 0.7) for i in got)


def test_toxicity_gradient(monkeypatch):
    monkeypatch.setattr(toxicity, "HIDE", 0)
    rng = np.random.default_rng(1)
    words = toxicity.Words([b"one two three four five six seven", b"alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omi pi rho sig"])
    model = {k: v.astype(float) for k, v in toxicity.start_model(rng).items()}
    chosen, y = np.arange(len(words.windows)), np.array([1, 0, 1][: len(words.windows)])

    def loss():
        z = toxicity.window_logits(model, words)[chosen]
        return np.mean(np.log1p(np.exp(z)) - y * z)

    known = {"word": np.ones(toxicity.WORD_ROWS, bool), "char": np.ones(toxicity.CHAR_ROWS, bool)}
    g = toxicity.step(model, words, chosen, y, rng, known)
    for name in ("word", "char"):
        whole = np.zeros_like(model[name])
        whole[g[name][0]] = g[name][1]
        g[name] = whole
    for name, at in (("out", (3,)), ("attend", (5, 2)), ("query", (1,)), ("in_f", (4, 7)), ("in_b", (2, 18)), ("back_f", (3, 20)), ("back_b", (1, 4)), ("word", (int(words.word[2]), 3)), ("char", (int(words.grams[0][1]), 2))):
        old, eps = model[name][at], 1e-3
        model[name][at] = old + eps
        up = loss()
        model[name][at] = old - eps
        down = loss()
        model[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-4 + 0.05 * abs(g[name][at]), name


def test_toxicity_windows_by_a_plain_loop():
    """Scores of all windows, and how they make a text's score, word by word and step by step."""
    rng = np.random.default_rng(2)
    texts = [b"", b"one two", " ".join(f"wörd{i}" for i in range(45)).encode(), b"alpha beta gamma " * 9]
    model = {k: v.astype(np.float32) for k, v in toxicity.start_model(rng).items()} | {"head": np.array([0.4, 0.7, -0.2])}
    words = toxicity.Words(texts)
    size, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))

    def states(xs, d):
        h, out = np.zeros(size), []
        for x in xs:
            a, g = x @ model[f"in_{d}"] + model[f"bias_{d}"], h @ model[f"back_{d}"]
            z, r = sig(a[:size] + g[:size]), sig(a[size : 2 * size] + g[size : 2 * size])
            new = np.tanh(a[2 * size :] + r * g[2 * size :])
            h = z * h + (1 - z) * new
            out.append(h)
        return out

    for text, raw in enumerate(texts):
        own = np.flatnonzero(words.text == text)
        assert len(own) == len(raw.split())
        rows = [np.concatenate([model["word"][words.word[w]], np.mean([model["char"][g[p]] for g in words.grams for p in range(words.begins[w], words.begins[w] + words.sizes[w])], axis=0)]) for w in own]
        starts = sorted({min(s, max(0, len(own) - toxicity.WINDOW)) for s in range(0, max(1, len(own) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)}) if len(own) else []
        logits = []
        for s in starts:
            xs = rows[s : s + toxicity.WINDOW]
            pad = toxicity.WINDOW - len(xs)
            xs = [*xs, *[np.zeros(2 * toxicity.EMBED)] * pad]
            both = [np.concatenate([f, b]) for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)][: toxicity.WINDOW - pad]
            weight = np.exp([np.tanh(h @ model["attend"]) @ model["query"] for h in both])
            logits.append((weight / weight.sum()) @ np.array(both) @ model["out"] + model["shift"][0])
        want = 0 if not logits else sig(0.4 * max(logits) + 0.7 * np.log(np.mean(np.exp(logits))) - 0.2)
        assert abs(toxicity.scores(model, texts)[text] - want) < 1e-4


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    named = empty.withColumnRenamed("copy", "lang")
    for out in (substrings.drop_repeated_windows(empty), suffixes.drop_repeated_bytes(empty), simhash.near_duplicates(empty), packing.pack(empty, tokenizer_path()), licenses.scan(empty), decontamination.contaminated(empty, bench), sharding.shard(empty, 100), langid.identify(named), toxicity.score(empty, labels), embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert out.count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.drop_repeated_windows(docs).collect()) == [(1, 0), (1, 0), (2, 60)]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(1, 1), (1, 1), (2, 1)]
    assert packing.pack(docs, tokenizer_path()).count() == 3
