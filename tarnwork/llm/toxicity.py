"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a word embedding and as the mean embedding of its character n-grams, both by hashed row, so no word list
is kept.  Embeddings start from what the frequencies of rows under the two labels tell beyond chance; rows of few texts
stay zero.  The network reads windows of ``WINDOW`` words that overlap by half; all windows of a text are scored, and the
text's score comes from its worst window and from the mean odds of all.  Labels are of whole texts, so training picks each
text's witness windows: first by the frequencies of its features, then by the network itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .licenses import WORDS
from .substrings import words_of
from .superkmers import mixed
from .training import Adam, held_out, sample, texts_of

WINDOW, STRIDE, WORD_ROWS, CHAR_ROWS, EMBED, HIDDEN, ATTEND = 16, 8, 1 << 16, 1 << 16, 8, 8, 8
GRAMS = (3, 5, 7)
#: What a hashed row's number takes; there is one for each byte of a text and each of ``GRAMS``.
ROW = np.uint16
#: Documents of label 1 and of label 0 that the network is fitted on, at most, and windows of each of the latter in an epoch.
FIT_DOCS, FIT_CLEAN, NEGATIVES, BATCH = 1000, 1500, 3, 64
#: Rows that fewer fitted documents hold stay zero, as rows do that none holds: a word of one text tells nothing of others.
#: A first embedding is by how many standard errors beyond ``CHANCE`` a row is more frequent under one label.
LEAST_DOCS, CHANCE = 5, 3.0
#: Share of words that a step hides the embedding of, so that their n-grams are learned too, and decay of touched rows.
HIDE, DECAY = 0.5, 0.002
#: In each of the two phases: passes, and steps at least, so that a small sample is learned as well.
PHASES = ((1, 30), (1, 30))
THRESHOLD = 0.7
#: Logits are held within this; one window in so many of a text with label 1 is a witness.
LIMIT, SHARE = 12.0, 8


class Words:
    """Texts as hashed rows of words and of their character n-grams, with the windows over them."""

    def __init__(self, texts: list[bytes]):
        parts = [self._rows(texts[a:b], a) for a, b in common.steps(texts)] or [self._rows([], 0)]
        offsets = np.cumsum([0, *[p[4] for p in parts[:-1]]])
        self.word, self.begins, self.sizes, self.text = (np.concatenate(x) for x in ([p[0] for p in parts], [p[2] + o for p, o in zip(parts, offsets, strict=True)], [p[3] for p in parts], [p[5] for p in parts]))
        held = [p[1] for p in parts]
        del parts
        self.grams = []
        for _ in GRAMS:  # a step's rows go as they are joined
            self.grams.append(np.concatenate([g.pop(0) for g in held]))
        count = np.bincount(self.text, minlength=len(texts)) if len(self.text) else np.zeros(len(texts), np.int64)
        first = np.cumsum(count) - count
        self.per_text = np.where(count > 0, np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1), 0)
        of = np.repeat(np.arange(len(texts)), self.per_text)
        turn = np.arange(len(of)) - np.repeat(np.cumsum(self.per_text) - self.per_text, self.per_text)
        start = np.minimum(turn * STRIDE, np.maximum(count[of] - WINDOW, 0))
        at = first[of][:, None] + start[:, None] + np.arange(WINDOW)
        real = start[:, None] + np.arange(WINDOW) < count[of][:, None]
        self.of, self.windows = of, np.where(real, at, -1).astype(np.int32)  # word numbers; -1: past a short text's end

    @staticmethod
    def _rows(texts: list[bytes], before: int) -> tuple:
        """Of one step: rows of words and of their n-grams, where the words lie in its bytes, and their texts."""
        hashes, docs, buffer, begins, ends = words_of([t.translate(WORDS) for t in texts])
        n, grams, reach = len(buffer), [], max(GRAMS) // 2
        data = np.zeros(n + 2 * reach, np.uint64)  # 0: beyond the space before or after the word
        data[reach : n + reach] = np.frombuffer(buffer, np.uint8)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        left[begins], right[begins] = begins, ends
        left = np.arange(n) - np.maximum.accumulate(left) + 1  # from the space before the word, to the one after it
        right = np.maximum.accumulate(right) - np.arange(n)
        for size in GRAMS:
            h = np.full(n, size, np.uint64)
            for j in range(-(size // 2), size // 2 + 1):
                symbol = data[reach + j : reach + j + n]
                if j < -1:
                    symbol = np.where(left >= -j, symbol, 0)
                elif j > 1:
                    symbol = np.where(right >= j, symbol, 0)
                h = h * np.uint64(0x100000001B3) + symbol
            grams.append((mixed(h) % np.uint64(CHAR_ROWS)).astype(ROW))
        return (hashes % np.uint64(WORD_ROWS)).astype(ROW), grams, begins, ends - begins, n, docs + before

    def parts(self, most: int = 1 << 16) -> Iterator[tuple[int, int, int, int]]:
        """Ranges of words, whole texts each, with the range of bytes that they lie in."""
        ends = np.flatnonzero(np.append(self.text[1:] != self.text[:-1], True)) + 1 if len(self.text) else np.zeros(0, np.int64)
        a = 0
        for k, end in enumerate(ends.tolist()):
            if k + 1 == len(ends) or ends[k + 1] - a > most:
                yield a, end, int(self.begins[a]), int(self.begins[end - 1] + self.sizes[end - 1])
                a = end

    def sums(self, table: np.ndarray, part: tuple[int, int, int, int]) -> np.ndarray:
        """The mean row of the character n-grams of each word of a part."""
        a, b, lo, hi = part
        total = np.zeros((hi - lo + 1, table.shape[1]), table.dtype)
        for g in self.grams:
            total[:-1] += table[g[lo:hi]]
        edges = np.stack([self.begins[a:b] - lo, self.begins[a:b] + self.sizes[a:b] - lo], axis=1).ravel()
        return np.add.reduceat(total, edges, axis=0)[::2] * self.share()[a:b, None].astype(table.dtype)

    def share(self) -> np.ndarray:
        return 1 / (len(GRAMS) * self.sizes)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    model = {"word": rng.normal(0, 0.05, (WORD_ROWS, EMBED)), "char": rng.normal(0, 0.05, (CHAR_ROWS, EMBED))}
    for d in "fb":
        model[f"in_{d}"] = rng.normal(0, 0.4, (2 * EMBED, 3 * HIDDEN))
        model[f"back_{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        model[f"bias_{d}"] = np.zeros(3 * HIDDEN)
    model |= {"attend": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "query": rng.normal(0, 0.3, ATTEND), "out": rng.normal(0, 0.3, 2 * HIDDEN), "shift": np.zeros(1)}
    return model


def gru(x: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, list]:
    """States (n, steps, hidden) from input parts (n, steps, 3 hidden); order of gates: update, reset, new."""
    n, steps, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    states, kept = np.empty((n, steps, HIDDEN), x.dtype), []
    for t in range(steps):
        g = h @ back
        zr = sigmoid(x[:, t, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(x[:, t, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        kept.append((h, z, r, new, g[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        states[:, t] = h
    return states, kept


def gru_back(d_states: np.ndarray, kept: list, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input parts and of the recurrent weights."""
    n, steps, _ = d_states.shape
    d_x, d_back, d_h = np.empty((n, steps, 3 * HIDDEN)), np.zeros_like(back), np.zeros((n, HIDDEN))
    for t in range(steps - 1, -1, -1):
        h, z, r, new, g_new = kept[t]
        d = d_h + d_states[:, t]
        d_n = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_n * g_new * r * (1 - r)
        d_x[:, t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_back += h.T @ d_g
        d_h = d * z + d_g @ back.T
    return d_x, d_back


def read(model: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows (n, WINDOW, 2 EMBED); ``real`` marks words, what lies past a text's end is not attended to."""
    parts = {d: (x if d == "f" else x[:, ::-1]) @ model[f"in_{d}"] + model[f"bias_{d}"] for d in "fb"}
    (sf, kf), (sb, kb) = gru(parts["f"], model["back_f"]), gru(parts["b"], model["back_b"])
    states = np.concatenate([sf, sb[:, ::-1]], axis=2)
    inner = np.tanh(states @ model["attend"])
    weight = np.where(real, inner @ model["query"], -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    weight /= weight.sum(axis=1, keepdims=True)
    pooled = (weight[:, None, :] @ states)[:, 0]
    return pooled @ model["out"] + model["shift"], (states, inner, weight, pooled, kf, kb)


def step(model: dict[str, np.ndarray], words: Words, chosen: np.ndarray, y: np.ndarray, rng: np.random.Generator, known: dict[str, np.ndarray]) -> dict:
    """Gradients of the cross-entropy of the chosen windows."""
    at = words.windows[chosen]
    real = at >= 0
    used, inverse = np.unique(np.maximum(at, 0), return_inverse=True)
    inverse = inverse.reshape(at.shape)
    sizes = words.sizes[used]
    owner = np.repeat(np.arange(len(used)), sizes)
    first = np.cumsum(sizes) - sizes
    places = np.arange(len(owner)) + np.repeat(words.begins[used] - first, sizes)
    share = 1 / (len(GRAMS) * sizes)
    chars = sum(np.add.reduceat(model["char"][g[places]], first, axis=0) for g in words.grams)
    shown = (rng.random(len(used)) >= HIDE)[:, None] / (1 - HIDE)
    inputs = np.concatenate([model["word"][words.word[used]] * shown, chars * share[:, None]], axis=1)
    x = inputs[inverse] * real[:, :, None]
    logit, (states, inner, weight, pooled, kf, kb) = read(model, x, real)
    d_logit = (sigmoid(logit) - y) / len(y)
    out = {"out": pooled.T @ d_logit, "shift": np.array([d_logit.sum()])}
    d_pooled = d_logit[:, None] * model["out"]
    d_states = weight[:, :, None] * d_pooled[:, None, :]
    d_weight = (states @ d_pooled[:, :, None])[:, :, 0]
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
    out["query"] = np.einsum("nt,nta->a", d_score, inner)
    d_inner = d_score[:, :, None] * model["query"] * (1 - inner * inner)
    out["attend"] = np.einsum("nts,nta->sa", states, d_inner)
    d_states = d_states + d_inner @ model["attend"].T
    d_x = np.zeros_like(x)
    for d, kept, part in (("f", kf, d_states[:, :, :HIDDEN]), ("b", kb, d_states[:, ::-1, HIDDEN:])):
        d_in, out[f"back_{d}"] = gru_back(part, kept, model[f"back_{d}"])
        xs = x if d == "f" else x[:, ::-1]
        out[f"in_{d}"] = np.einsum("nti,ntg->ig", xs, d_in)
        out[f"bias_{d}"] = d_in.sum(axis=(0, 1))
        back = d_in @ model[f"in_{d}"].T
        d_x += back if d == "f" else back[:, ::-1]
    d_x *= real[:, :, None]
    d_inputs = np.zeros_like(inputs)
    np.add.at(d_inputs, inverse.ravel(), d_x.reshape(-1, 2 * EMBED))
    out["word"] = _rows(words.word[used], d_inputs[:, :EMBED] * shown, known["word"])
    d_chars = (d_inputs[:, EMBED:] * share[:, None])[owner]
    out["char"] = _rows(np.concatenate([g[places] for g in words.grams]), np.tile(d_chars, (len(words.grams), 1)), known["char"])
    return out


def _rows(rows: np.ndarray, gradients: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known rows that a step touches, each once, and their gradients."""
    held = np.flatnonzero(known[rows])
    rows, gradients = rows[held], gradients[held]
    if not len(rows):
        return rows, gradients
    order = np.argsort(rows, kind="stable")
    own, begin = np.unique(rows[order], return_index=True)
    return own, np.add.reduceat(gradients[order], begin, axis=0)


def window_logits(model: dict[str, np.ndarray], words: Words, size: int = 2048) -> np.ndarray:
    """Logits of all windows.  Words are projected once, however many windows hold them."""
    out = np.zeros(len(words.windows))
    for lo, hi, first, last in words.parts():
        inputs = np.concatenate([model["word"][words.word[lo:hi]], words.sums(model["char"], (lo, hi, first, last))], axis=1)
        parts = {d: np.vstack([inputs @ model[f"in_{d}"] + model[f"bias_{d}"], model[f"bias_{d}"][None]]) for d in "fb"}  # the last row: no word
        begin, end = np.searchsorted(words.of, [words.text[lo], words.text[hi - 1] + 1])
        for a in range(begin, end, size):
            at = words.windows[a : min(a + size, end)]
            at = np.where(at < 0, -1, at - lo)
            states = np.empty((WINDOW, len(at), 2 * HIDDEN), np.float32)
            for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
                h = np.zeros((len(at), HIDDEN), np.float32)
                back = model[f"back_{d}"]
                for t in order:
                    x, g = parts[d][at[:, t]], h @ back
                    zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
                    new = np.tanh(x[:, 2 * HIDDEN :] + zr[:, HIDDEN:] * g[:, 2 * HIDDEN :])
                    h = new + zr[:, :HIDDEN] * (h - new)
                    states[t, :, (0 if d == "f" else HIDDEN) : (HIDDEN if d == "f" else 2 * HIDDEN)] = h
            score = np.tanh(states @ model["attend"]) @ model["query"]
            score[at.T < 0] = -1e9
            weight = np.exp(score - score.max(axis=0))
            value = states @ model["out"]
            out[a : a + len(at)] = (weight * value).sum(axis=0) / weight.sum(axis=0) + model["shift"][0]
    return out


def pooled(values: np.ndarray, words: Words) -> np.ndarray:
    """(text, 2): of the logits of each text's windows the largest, and the logarithm of their mean odds.

    The second tells a text that is toxic all over from a long one with a window that only looks so.  A text without
    words has the least of both.
    """
    out = np.full((len(words.per_text), 2), -LIMIT)
    some = words.per_text > 0
    if some.any():
        values = np.clip(values, -LIMIT, LIMIT)
        first = (np.cumsum(words.per_text) - words.per_text)[some]
        out[some, 0] = np.maximum.reduceat(values, first)
        out[some, 1] = np.log(np.add.reduceat(np.exp(values.astype(np.float64)), first) / words.per_text[some])
    return out


def head(found: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the two pooled logits and a constant: logistic regression, both labels of equal weight, drawn to (0.5, 0.5)."""
    x, prior = np.column_stack([found, np.ones(len(found))]), np.array([0.5, 0.5, 0.0])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    pull, w = np.array([1.0, 1.0, 0.01]), prior.copy()
    for _ in range(50):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + pull * (w - prior)
        curve = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        change = np.linalg.solve(curve, gradient)
        w -= change * min(1.0, 2 / max(1e-9, np.abs(change).max()))
    return w


def first_guess(words: Words, y: np.ndarray) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """For each window the most telling row of its words: by how many standard errors it is more frequent under label 1.

    And the first embeddings of the rows: what their frequencies tell beyond chance; none where few documents hold a row.
    """
    counts = [np.zeros((2, size)) for size in (WORD_ROWS, CHAR_ROWS)]

    def places(a: int, b: int) -> np.ndarray:
        sizes = words.sizes[a:b]
        return np.arange(int(sizes.sum())) + np.repeat(words.begins[a:b] - (np.cumsum(sizes) - sizes), sizes)

    for a, b, *_ in words.parts(1 << 14):
        at, owner = places(a, b), np.repeat(words.text[a:b], words.sizes[a:b])
        for count, texts, rows in ((counts[0], words.text[a:b], [words.word[a:b]]), (counts[1], owner, [g[at] for g in words.grams])):
            size = count.shape[1]
            pairs = np.unique(np.concatenate([texts * size + r for r in rows]))
            np.add.at(count, (y[pairs // size], pairs % size), 1)
    bad, fine = max(1, y.sum()), max(1, (1 - y).sum())
    of_word, of_gram = ((c[1] / bad - c[0] / fine) / np.sqrt((c.sum(axis=0) + 1) / (bad + fine) * (1 / bad + 1 / fine)) for c in counts)
    value = of_word[words.word]
    for a, b, *_ in words.parts(1 << 14):
        at = places(a, b)
        first = np.cumsum(words.sizes[a:b]) - words.sizes[a:b]
        for g in words.grams:
            value[a:b] = np.maximum(value[a:b], np.maximum.reduceat(of_gram[g[at]], first))
    return np.append(value, -99.0)[words.windows].max(axis=1), {k: (c.sum(axis=0) >= LEAST_DOCS, np.sign(z) * np.maximum(np.abs(z) - CHANCE, 0) / CHANCE) for k, c, z in zip(("word", "char"), counts, (of_word, of_gram), strict=True)}


def fit(texts: list[bytes], labels: list[int], seed: int = 11) -> dict[str, np.ndarray]:
    """The network, fitted on four texts of five; the fifth, which it has not seen, tells how its logits make a score."""
    y = np.array(labels)
    turn = np.empty(len(y), np.int64)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum())
    apart = (turn % 5 == 4) if min((y == 0).sum(), (y == 1).sum()) >= 10 else np.zeros(len(y), bool)
    model = network([t for t, x in zip(texts, apart.tolist(), strict=True) if not x], y[~apart], seed)
    common.give_back()
    judged = Words([t for t, x in zip(texts, apart.tolist(), strict=True) if x or not apart.any()])
    model["head"] = head(pooled(window_logits(model, judged), judged), y[apart] if apart.any() else y)
    return model


def network(texts: list[bytes], y: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    words, model = Words(texts), start_model(rng)
    common.give_back()
    if len(words.windows):
        (guess, told), adam = first_guess(words, y), Adam(model, {}, 0.01)
        common.give_back()
        known = {k: rows for k, (rows, _) in told.items()}
        for k, (rows, value) in told.items():
            model[k][:, 0] += value
            model[k][~rows] = 0
        first = np.cumsum(words.per_text) - words.per_text
        toxic = y[words.of] == 1
        for phase, (passes, least) in enumerate(PHASES):
            if phase:
                guess = window_logits({k: v.astype(np.float32) for k, v in model.items()}, words)
                common.give_back()
            order = np.lexsort((-guess, words.of))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            rank -= first[words.of]
            witnesses = np.flatnonzero(rank < np.where(toxic, np.maximum(1, words.per_text[words.of] // SHARE), NEGATIVES))
            bad, fine = witnesses[toxic[witnesses]], witnesses[~toxic[witnesses]]
            bad = np.repeat(bad, max(1, len(fine) // (2 * max(1, len(bad)))))
            for _ in range(max(passes, -(-least * BATCH // (len(bad) + 2 * len(fine) + 1)))):
                others = rng.choice(np.flatnonzero(~toxic), min(int((~toxic).sum()), len(fine)), replace=False)
                chosen = rng.permutation(np.concatenate([bad, fine, others]))
                for a in range(0, len(chosen), BATCH):
                    some = chosen[a : a + BATCH]
                    adam.update(step(model, words, some, y[words.of[some]], rng, known), DECAY)
    return {k: v.astype(np.float32) for k, v in model.items()}


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> dict[str, np.ndarray] | None:
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    label = {r[0]: k for k, n in ((0, FIT_CLEAN), (1, FIT_DOCS)) for r in sample(known.filter(F.col("y") == k), id_col, n).collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in label], f"{id_col} long")
    rows = sorted(texts_of(docs, ids, id_col, text_col), key=lambda r: (label[r.id], r.id))
    texts, y = [bytes(r.t) for r in rows], [label[r.id] for r in rows]
    del rows
    model = fit(texts, y) if set(y) == {0, 1} else None
    common.give_back()
    return model


def scores(model: dict[str, np.ndarray] | None, texts: list[bytes]) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    words = Words(texts)
    found = sigmoid(pooled(window_logits(model, words), words) @ model["head"][:2] + model["head"][2])
    found[words.per_text == 0] = 0
    return found


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The documents whose score is below the threshold, as they are."""
    model = fitted(docs, labels, id_col, text_col, label_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(text_col).cast(pa.binary()).to_pylist()
        keep = [scores(model, [t or b"" for t in texts[a:b]]) < THRESHOLD for a, b in common.steps([t or b"" for t in texts])]
        return batch.filter(pa.array(np.concatenate(keep)))

    return common.map_batches(docs, work, docs.schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    Learns from up to ``FIT_DOCS`` rows with label 1 and ``FIT_CLEAN`` with label 0 that are not held out; ids, labels, languages and sources
    are no input of a score.  A null text or one without words has score 0; so has every text if only one label is known.
    """
    model = fitted(docs, labels, id_col, text_col, label_col)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for a, b in common.steps(texts):
            found = scores(model, texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), common.utf8(text_col).alias("_text"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"))
    return common.map_batches(kept, work, f"{id_col} long, held_out boolean, score double, predicted int")
