"""Language identification by a convolutional network over bytes, trained in numpy.

A byte embedding, filters of several widths, their maximum over a window, and a softmax.  Because a filter is linear in
the embedded bytes, its value is a sum of one table row for each byte, and the scoring of windows is nothing but gathers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .simhash import LOWER
from .training import Adam, held_out, sample, texts_of

WINDOW, WIDTHS, EMBED, FILTERS = 128, (2, 3, 4), 8, 16
STRIDE = WINDOW - max(WIDTHS) + 1  # windows overlap so that every byte run of a filter's width lies in one
#: Documents and windows that the network is fitted on, at most.
FIT_DOCS, FIT_WINDOWS, EPOCHS, BATCH = 4000, 16_000, 6, 128
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n x WINDOW bytes, number of windows of each text); the last window of a text is filled up with zeros."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE))
    room = np.zeros(int(((counts - 1) * STRIDE + WINDOW).sum()), np.uint8)
    base = np.cumsum((counts - 1) * STRIDE + WINDOW) - ((counts - 1) * STRIDE + WINDOW)
    for b, t in zip(base.tolist(), texts, strict=True):
        room[b : b + len(t)] = np.frombuffer(t, np.uint8)
    of = np.repeat(np.arange(len(texts)), counts)
    starts = base[of] + (np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return room[starts[:, None] + np.arange(WINDOW)], counts


def prepared(text: bytes | None) -> bytes:
    return b" ".join((text or b"").translate(LOWER).split())


def tables(model: dict[str, np.ndarray]) -> list[list[np.ndarray]]:
    """For each width, the 256 x FILTERS rows that each of its byte places adds; byte zero adds nothing."""
    out = []
    for w in WIDTHS:
        rows = [(model["embed"] @ model[f"conv{w}"][j]).astype(np.float32) for j in range(w)]
        for r in rows:
            r[0] = 0
        out.append(rows)
    return out


def pooled(model: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filters' maxima over each window and where they lie."""
    values, places = [], []
    for w, rows in zip(WIDTHS, tables(model), strict=True):
        n = WINDOW - w + 1
        total = rows[0][x[:, :n]]
        for j in range(1, w):
            total += rows[j][x[:, j : j + n]]
        at = total.argmax(axis=1)
        values.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0] + model[f"bias{w}"])
        places.append(at)
    return np.maximum(np.concatenate(values, axis=1), 0), np.concatenate(places, axis=1)


def maxima(rows: list[list[np.ndarray]], model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """As ``pooled``, without the places, place by place to stay in the processor's cache."""
    values = []
    turned = np.ascontiguousarray(x.T)
    for w, own in zip(WIDTHS, rows, strict=True):
        best = None
        for i in range(WINDOW - w + 1):
            total = own[0][turned[i]]
            for j in range(1, w):
                total += own[j][turned[i + j]]
            best = total if best is None else np.maximum(best, total, out=best)
        values.append(best + model[f"bias{w}"])
    return np.maximum(np.concatenate(values, axis=1), 0)


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit(texts: list[bytes], labels: list[str], seed: int = 7) -> tuple[dict[str, np.ndarray], list[str]]:
    """(model, languages in the order of its outputs)."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, counts = windows([prepared(t) for t in texts])
    y = np.repeat(np.array([names.index(v) for v in labels]), counts)
    if len(x) > FIT_WINDOWS:
        chosen = rng.choice(len(x), FIT_WINDOWS, replace=False)
        x, y = x[chosen], y[chosen]
    model = {"embed": rng.normal(0, 0.5, (256, EMBED))}
    for w in WIDTHS:
        model[f"conv{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))
        model[f"bias{w}"] = np.zeros(FILTERS)
    model["out"] = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names)))
    model["shift"] = np.zeros(len(names))
    adam = Adam(model, {}, 0.01)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            adam.update(gradients(model, x[some], y[some]))
    return {k: v.astype(np.float32) for k, v in model.items()}, names


def gradients(model: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    features, places = pooled(model, x)
    delta = np.exp(log_softmax(features @ model["out"] + model["shift"]))
    delta[np.arange(len(y)), y] -= 1
    delta /= len(y)
    out = {"out": features.T @ delta, "shift": delta.sum(axis=0), "embed": np.zeros_like(model["embed"])}
    back = (delta @ model["out"].T) * (features > 0)
    for k, w in enumerate(WIDTHS):
        g, at = back[:, k * FILTERS : (k + 1) * FILTERS], places[:, k * FILTERS : (k + 1) * FILTERS]
        out[f"bias{w}"] = g.sum(axis=0)
        out[f"conv{w}"] = np.zeros_like(model[f"conv{w}"])
        for j in range(w):
            byte = np.take_along_axis(x, at + j, 1)
            rows = np.bincount((byte.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            rows[0] = 0
            out[f"conv{w}"][j] = model["embed"].T @ rows
            out["embed"] += rows @ model[f"conv{w}"][j].T
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    Learns from the text and label of up to ``FIT_DOCS`` rows that are not held out; ids, labels and sources are no input
    of a prediction.  All windows of a text count; its label has the highest mean log-probability, and score is that
    label's share.  A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.
    """
    known = docs.select(id_col, label_col).filter(~held_out(id_col) & F.col(label_col).isNotNull())
    ids = sample(known, id_col, FIT_DOCS)
    label = {r[0]: r[1] for r in known.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min(label_col)).collect()}
    rows = sorted(texts_of(docs, ids, id_col, text_col), key=lambda r: r.id)
    model, names = fit([bytes(r.t) for r in rows], [label[r.id] for r in rows]) if rows else ({}, [])
    gather = tables(model) if rows else []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in common.steps(texts):
            label, score = ["und"] * (b - a), np.zeros(b - a)
            some = [i for i in range(a, b) if texts[i] and _LETTER.search(texts[i].decode("utf-8", "replace"))] if names else []
            if some:
                x, counts = windows([prepared(texts[i]) for i in some])
                logs = np.concatenate([log_softmax(maxima(gather, model, x[k : k + 1024]) @ model["out"] + model["shift"]) for k in range(0, len(x), 1024)])
                mean = np.add.reduceat(logs, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                share = np.exp(log_softmax(mean))
                for i, k, s in zip(some, share.argmax(axis=1), share.max(axis=1), strict=True):
                    label[i - a], score[i - a] = names[k], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(label), pa.array(score)], [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("binary").alias("_text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return common.map_batches(rows.select(id_col, common.utf8("_text").alias("_text"), "held_out"), work, f"{id_col} long, held_out boolean, lang_pred string, score double")
