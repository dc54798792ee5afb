"""Licences, languages and the pipeline's stages against plain versions."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import decontamination, langid, licenses, packing, toxicity
from tarnwork.llm.queries import tokenizer_path

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE.items():
        own = phrase.split()
        for i in range(len(words) - len(own) + 1):
            if words[i : i + len(own)] == own:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses_against_plain_search(spark):
    rng = random.Random(4)
    words = ["MIT", "license", "mit-license", "Apache", "LICENSE", "general", "public", "licence", "é", "x", "2", "\n", "submit", "_", "gnu"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(900, None), (901, ""), (902, "mit license mit license"), (903, "mit license " * 3000)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs)
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(df).collect()}
    rows += [tuple(r) for r in docs.collect()]
    assert got == {i: plain_licenses(t) for i, t in rows}
    assert sum(n > 0 for _, n, *_ in got.values()) > 50


def test_language_scores_by_plain_loops(monkeypatch):
    rng = np.random.default_rng(3)
    model = {"embed": rng.normal(size=(256, langid.EMBED)), "out": rng.normal(size=(langid.FILTERS * len(langid.WIDTHS), 3)), "shift": rng.normal(size=3)}
    for w in langid.WIDTHS:
        model[f"conv{w}"] = rng.normal(size=(w, langid.EMBED, langid.FILTERS))
        model[f"bias{w}"] = rng.normal(size=langid.FILTERS)
    model = {k: v.astype(np.float32) for k, v in model.items()}
    model["embed"][0] = 0
    x, counts = langid.windows([langid.prepared(t) for t in (b"short", b"a text that is longer than one window " * 9)])
    got = langid.log_softmax(langid.maxima(langid.tables(model), model, x) @ model["out"] + model["shift"])
    for row, found in zip(x[:3], got[:3]):
        values = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                best = max(sum(float(model["embed"][row[i + j]] @ model[f"conv{w}"][j][:, f]) for j in range(w)) for i in range(len(row) - w + 1))
                values.append(max(0.0, best + float(model[f"bias{w}"][f])))
        z = np.array(values) @ model["out"] + model["shift"]
        assert found == pytest.approx(z - np.log(np.exp(z - z.max()).sum()) - z.max(), abs=2e-3)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    """Documents with copies, shared passages, a benchmark item, toxic texts, and none at all."""
    words = [f"w{i}" for i in range(400)]
    say = lambda n, pool: " ".join(rng.choice(pool) for _ in range(n))
    bad = [f"vile{i}" for i in range(6)]
    passage, item = say(60, words), say(30, words)
    texts = [say(rng.randint(40, 120), words) for _ in range(60)]
    texts += [texts[3], texts[4] + " end", f"{say(50, words)} {passage} {say(20, words)}", f"{say(45, words)} {passage}", f"{say(40, words)} {item} {say(9, words)}", "é" * 90 + passage, None, ""]
    toxic = [say(40, words + bad * 30) for _ in range(36)]
    rows = [(i, t) for i, t in enumerate(texts + toxic)]
    return rows, [(1, item), (2, say(25, words)), (3, None)], {i: int(i >= len(texts)) for i, _ in rows}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    rows, items, toxic = corpus(rng)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items


def texts(df):
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stage_of_toxicity(spark, made):
    folder, rows, _ = made
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = texts(corpus_pipeline.reject_toxic(spark, docs, folder))
    fine = {r["doc_id"] for r in toxicity.score(docs, labels).collect() if r["predicted"] == 0}
    assert kept == {i: t for i, t in rows if i in fine}
    assert 60 < len(kept) < len(rows)


def plain_removed(rows):
    """What is left of each text where bytes of strings of 100 that start earlier go, with what is left of a parted character."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            if (s := raw[k : k + 100]) in seen:
                gone[k : k + 100] = True
            seen.add(s)
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def test_stage_of_repeated_strings(spark, made):
    folder, rows, _ = made
    got = texts(corpus_pipeline.drop_repeated_strings(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert got == plain_removed(rows)
    assert sum(len(got[i]) < len(t or "") for i, t in rows) >= 3


def test_stage_of_benchmark_items(spark, made):
    folder, rows, items = made
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = texts(corpus_pipeline.drop_benchmark(spark, docs, folder))
    held = {r["doc_id"] for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {i for i, _ in rows} - held
    assert {i for i, t in rows if t and items[0][1] in t} == held


def test_stage_of_packing_and_the_whole(spark, made):
    folder, _, _ = made
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    step = key(packing.pack(docs, tokenizer_path()))
    assert key(corpus_pipeline.pack(spark, docs, folder)) == step
    assert key(corpus_pipeline.run(spark, folder)) == step
    assert {i for i, *_ in step} == {r["doc_id"] for r in docs.collect()}
