"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Each word enters as a vector with a part for the word and a part for its characters: word vectors for the words of the
training sample, and the mean of hashed character-trigram vectors for every word. All windows of WINDOW words, one at
each word, run through one gated recurrent unit in each direction; attention pools the hidden states of a window into one
logit. A text's score is that of its highest window, calibrated on the training sample. All windows of the whole text are
scored; as neighbours differ by one word, a word's projection is computed once and a step reads a shifted view of it.

Defined results: null and empty texts have one empty window, whose score is the calibrated bias; a text shorter than a
window has one window with padding that changes no state; without any labelled row, or with one class only, every score
is 0. Of several labels of an id the largest counts, of several texts of a labelled id one (the least hash) is learned.
Rows are never dropped, equal rows get equal scores; columns named score and predicted are replaced, all others stay.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WINDOW = 8
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_SLOTS, VOCABULARY = 6, 4, 4, 4096, 8192
#: Bounds of the labelled sample that the network is fitted on: rows for each class, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
#: Empty texts that are added as clean ones, so that the empty window has a learned score: one for so many texts.
EMPTY_SHARE = 50
#: Rounds over the sample, and the steps below which a small sample gets more rounds (MOST_EPOCHS at the most).
EPOCHS, STEPS, MOST_EPOCHS = 6, 240, 40
BATCH, RATE = 128, 0.03
BATCH_BYTES = 1 << 20
WINDOWS_AT_ONCE = 4096

TOKENS = shared.Tokenizer(shared.PUNCT_SEPARATORS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Inputs:
    """Of some texts: the word number of each token, and for each distinct word its hash and character slots."""

    def __init__(self, texts: list):
        w = TOKENS.words(texts)
        self.offsets = w.offsets
        self.token, self.hash = pd.factorize(w.hash)
        first = np.zeros(len(self.hash), np.int64)
        first[self.token[::-1]] = np.arange(len(self.token) - 1, -1, -1)
        start, size = w.start[first], w.end[first] - w.start[first]
        # Trigrams of each distinct word with a mark on both sides: as many as it has bytes.
        self.size = size
        self.first = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=self.first[1:])
        at = np.repeat(start - self.first, size) + np.arange(size.sum())
        data = w.data.astype(np.uint32)
        head = np.zeros(len(at), bool)
        tail = np.zeros(len(at), bool)
        head[self.first] = len(size) > 0
        tail[self.first + size - 1] = len(size) > 0
        before = np.where(head, 0, data[at - 1])
        after = np.where(tail, 0, data[np.minimum(at + 1, len(data) - 1)])
        code = (before << np.uint32(16)) | (data[at] << np.uint32(8)) | after
        self.slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int32) % CHAR_SLOTS

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts, each padded to a window at least; where each text begins; whether a window starts there.

        The padding's number is that after the last word's. Every text has a window at its first place.
        """
        n = np.diff(self.offsets)
        size = np.maximum(n, WINDOW)
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(size, out=first[1:])
        out = np.full(first[-1], len(self.hash), np.int32)
        out[np.arange(len(self.token)) + np.repeat(first[:-1] - self.offsets[:-1], n)] = self.token
        left = np.repeat(first[1:], size) - np.arange(first[-1])
        return out, first[:-1], left >= WINDOW


class Network:
    def __init__(self, vocabulary: np.ndarray, prior: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary  # sorted hashes; number 0 is any other word
        word = r.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM))
        word[1:, 0] = prior
        word[0] = 0
        self.p = {
            "word": word.astype(f), "char": r.normal(0, 0.1, (CHAR_SLOTS, CHAR_DIM)).astype(f),
            "Wx": r.normal(0, 0.3, (2, d, 3 * h)).astype(f), "Wh": r.normal(0, 0.3, (2, h, 3 * h)).astype(f), "b": np.zeros((2, 3 * h), f),
            "u": r.normal(0, 0.3, 2 * h).astype(f), "v": r.normal(0, 0.3, 2 * h).astype(f), "c": np.zeros(1, f),
        }
        self.scale, self.shift = 1.0, 0.0

    def word_rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def vectors(self, x: Inputs) -> np.ndarray:
        """The input vector of each distinct word, and zeros for the padding after the last."""
        out = np.zeros((len(x.hash) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(x.hash):
            out[:-1, :WORD_DIM] = self.p["word"][self.word_rows(x.hash)]
            out[:-1, WORD_DIM:] = np.add.reduceat(self.p["char"][x.slot], x.first, axis=0) / x.size[:, None]
        return out

    def window_logits(self, x: Inputs, stream: np.ndarray) -> np.ndarray:
        """The logit of the window at each place of the stream (also of those that no text has)."""
        h, pad = HIDDEN, len(x.hash)
        half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])[:, None]  # a sigmoid is half a tanh of half its argument
        vec = self.vectors(x)
        project = [np.ascontiguousarray((vec @ self.p["Wx"][d] + self.p["b"][d]).T * half) for d in (0, 1)]
        back = [np.ascontiguousarray(self.p["Wh"][d].T * half) for d in (0, 1)]
        pool = np.stack([self.p["u"].reshape(2, h), self.p["v"].reshape(2, h)], 1)
        out = np.full(len(stream), -np.inf, np.float32)
        for a in range(0, max(0, len(stream) - WINDOW + 1), WINDOWS_AT_ONCE):
            token = stream[a : a + WINDOWS_AT_ONCE + WINDOW - 1]
            m = len(token) - WINDOW + 1
            blank = token == pad
            full = not blank.any()
            pooled = np.zeros((WINDOW, 2, m), np.float32)
            for d in (0, 1):
                gx = np.take(project[d], token, axis=1)
                state = np.zeros((h, m), np.float32)
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    gates = back[d][: 2 * h] @ state
                    gates += gx[: 2 * h, t : t + m]
                    np.tanh(gates, out=gates)
                    gates *= np.float32(0.5)
                    gates += np.float32(0.5)
                    move = back[d][2 * h :] @ (gates[h:] * state)
                    move += gx[2 * h :, t : t + m]
                    np.tanh(move, out=move)
                    move -= state
                    move *= gates[:h]
                    if not full:
                        move[:, blank[t : t + m]] = 0
                    state = state + move
                    pooled[t] += pool[d] @ state
            e = pooled[:, 0]
            if not full:
                blanks = np.stack([blank[t : t + m] for t in range(WINDOW)])
                e[blanks] = -1e9
            e -= e.max(0)
            weight = np.exp(e, out=e)
            weight /= weight.sum(0)
            if not full:
                weight[blanks] = 0
            out[a : a + m] = (weight * pooled[:, 1]).sum(0) + self.p["c"][0]
        return out

    def logits(self, x: Inputs) -> np.ndarray:
        """The highest window's logit of each text."""
        stream, first, starts = x.stream()
        return np.maximum.reduceat(np.where(starts, self.window_logits(x, stream), -np.inf), first).astype(np.float64)

    def forward(self, grid: np.ndarray, project: list, pad: int, keep: dict | None = None) -> np.ndarray:
        """Logits of windows given as word numbers (time first); padded places change no state and get no attention."""
        h, n = HIDDEN, grid.shape[1]
        states = np.zeros((2, WINDOW, n, h), np.float32)
        full = not (grid == pad).any()
        for d in (0, 1):
            state = np.zeros((n, h), np.float32)
            wh = self.p["Wh"][d]
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                gx = project[d][grid[t]]
                gates = sigmoid(gx[:, : 2 * h] + state @ wh[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                cand = np.tanh(gx[:, 2 * h :] + (r * state) @ wh[:, 2 * h :])
                new = state + z * (cand - state)
                if not full:
                    new = np.where((grid[t] != pad)[:, None], new, state)
                if keep is not None:
                    keep[d, t] = state, z, r, cand
                states[d, t] = state = new
        e = states[0] @ self.p["u"][:h] + states[1] @ self.p["u"][h:]
        if not full:
            e = np.where(grid != pad, e, np.float32(-1e9))
        weight = np.exp(e - e.max(0))
        weight /= weight.sum(0)
        if not full:
            weight = np.where(grid != pad, weight, 0)
        value = states[0] @ self.p["v"][:h] + states[1] @ self.p["v"][h:]
        if keep is not None:
            keep["states"], keep["weight"], keep["value"] = states, weight, value
        return (weight * value).sum(0) + self.p["c"][0]

    def gradients(self, x: Inputs, grid: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of some windows, by backpropagation through time."""
        h, n, pad, p = HIDDEN, grid.shape[1], len(x.hash), self.p
        used, place = np.unique(grid, return_inverse=True)
        place = place.reshape(grid.shape)
        vec = self.vectors(x)[used]
        keep: dict = {}
        inner = int(np.searchsorted(used, pad))  # the padding's number among the used ones, or one that isn't there
        logit = self.forward(place, [vec @ p["Wx"][d] + p["b"][d] for d in (0, 1)], inner, keep)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dlogit = ((sigmoid(logit) - label) / n).astype(np.float32)
        states, weight, value = keep["states"], keep["weight"], keep["value"]
        g["c"][0] = dlogit.sum()
        dvalue = weight * dlogit
        de = weight * (value - (weight * value).sum(0)) * dlogit
        dvec = np.zeros_like(vec)
        for d in (0, 1):
            part = slice(d * h, (d + 1) * h)
            g["v"][part] = np.einsum("tn,tnh->h", dvalue, states[d])
            g["u"][part] = np.einsum("tn,tnh->h", de, states[d])
            outer = dvalue[..., None] * p["v"][part] + de[..., None] * p["u"][part]
            wh, carry = p["Wh"][d], np.zeros((n, h), np.float32)
            for t in range(WINDOW - 1, -1, -1) if d == 0 else range(WINDOW):
                state, z, r, cand = keep[d, t]
                alive = (place[t] != inner)[:, None]
                total = carry + outer[t]
                dnew = np.where(alive, total, 0)
                dcand = dnew * z * (1 - cand * cand)
                dz = dnew * (cand - state) * z * (1 - z)
                drs = dcand @ wh[:, 2 * h :].T
                dr = drs * state * r * (1 - r)
                gates = np.concatenate([dz, dr], 1)
                carry = np.where(alive, dnew * (1 - z) + drs * r + gates @ wh[:, : 2 * h].T, total)
                g["Wh"][d][:, : 2 * h] += state.T @ gates
                g["Wh"][d][:, 2 * h :] += (r * state).T @ dcand
                every = np.concatenate([gates, dcand], 1)
                g["b"][d] += every.sum(0)
                g["Wx"][d] += vec[place[t]].T @ every
                np.add.at(dvec, place[t], every @ p["Wx"][d].T)
        real = used < pad
        ids, dvec = used[real], dvec[real]
        np.add.at(g["word"], self.word_rows(x.hash[ids]), dvec[:, :WORD_DIM])
        g["word"][0] = 0
        many = x.size[ids]
        slots = np.repeat(x.first[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        np.add.at(g["char"], x.slot[slots], np.repeat(dvec[:, WORD_DIM:] / many[:, None], many, axis=0))
        return g

    def scores(self, texts: list) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(Inputs(texts)) + self.shift, -500, 500)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """A network fitted on labelled texts: each text is represented by its highest window, and clean ones by random ones too."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    blank = max(1, len(y) // EMPTY_SHARE)
    texts, y = [*texts, *[""] * blank], np.append(y, np.zeros(blank, np.float32))
    x = Inputs(texts)
    owner = np.repeat(np.arange(len(y)), np.diff(x.offsets))
    pair = np.unique(owner * max(1, len(x.hash)) + x.token)  # each word of a text once
    text_of, word_of = pair // max(1, len(x.hash)), pair % max(1, len(x.hash))
    bad = np.bincount(word_of[y[text_of] > 0], minlength=len(x.hash))
    good = np.bincount(word_of[y[text_of] == 0], minlength=len(x.hash))
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / (len(y) - y.sum() + 1))
    often = np.argsort(-(bad + good), kind="stable")[:VOCABULARY]
    often = often[(bad + good)[often] >= 5]
    often = often[np.argsort(x.hash[often])]
    # A word's first coordinate starts at its shrunken log odds, so that the first pick of windows is useful.
    shrunk = odds * (bad + good) / (bad + good + 20.0)
    net = Network(x.hash[often], shrunk[often] / 2, seed)
    stream, first, starts = x.stream()
    text = np.repeat(np.arange(len(y)), np.diff(np.append(first, len(stream))))
    known = np.zeros(len(x.hash) + 1)
    known[often] = np.maximum(shrunk[often], 0)
    sums = np.append(0, np.cumsum(known[stream]))
    score = sums[np.minimum(np.arange(len(stream)) + WINDOW, len(stream))] - sums[:-1]
    r = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    a_round = -(-2 * len(y) // BATCH)
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS // a_round)))
    step = 0
    place = np.flatnonzero(starts)
    some = place[y[text[place]] == 0]
    for epoch in range(epochs):
        if epoch in (epochs // 3, 2 * epochs // 3):  # from here on the network picks the windows itself
            score = net.window_logits(x, stream)
        order = place[np.lexsort((r.random(len(place)), score[place], text[place]))]
        top = order[np.append(np.flatnonzero(np.diff(text[order])), len(order) - 1)]
        pick = np.concatenate([top, r.choice(some, min(len(some), len(y)), replace=False)])
        r.shuffle(pick)
        rate = RATE * (1 - epoch / epochs)
        for a in range(0, len(pick), BATCH):
            own = pick[a : a + BATCH]
            step += 1
            for k, g in net.gradients(x, stream[own + np.arange(WINDOW)[:, None]], y[text[own]]).items():
                m, s = moment[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    # Platt's calibration of the highest window's logit, by Newton's method.
    logit = net.logits(x)
    a, b = 1.0, 0.0
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        w = q * (1 - q) + 1e-9
        g = np.array([((q - y) * logit).sum() + 1e-3 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * logit * logit).sum() + 1e-3, (w * logit).sum()], [(w * logit).sum(), w.sum()]])
        move = np.linalg.solve(hess + 1e-6 * np.eye(2), g)
        a, b = a - move[0], b - move[1]
    net.scale, net.shift = (float(a), float(b)) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)
    return net


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network | None:
    """A network fitted on at most `rows` labelled texts of each class, of at most `chars` characters, picked by a hash of the id.

    Ids are drawn by a bound on their hash, which follows from the number of labels of a class, so a task sees a few
    times `rows` of them, however many there are. Where too few of the drawn ids have such a text, more are drawn. One
    task trains; the driver gets the network alone (about half a megabyte).
    """
    one = labels.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("_id")).agg(F.max(label).alias("_y"))
    own = docs.where(F.col(text).isNotNull() & (F.length(text) <= chars)).select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    counts = {r["_y"]: r["count"] for r in one.groupBy("_y").count().collect()}
    drawn = 2 * rows
    while True:
        few = one.where(shared.drawn("_y", counts, drawn, F.xxhash64("_id")))
        sample = own.join(F.broadcast(few), "_id").groupBy("_id", "_y").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
        sample = shared.written(sample, "labelled")
        got = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
        if all(got.get(y, 0) >= rows or drawn >= n for y, n in counts.items()):
            break
        drawn *= 4
    rank = Window.partitionBy("_y").orderBy(F.xxhash64("_id"), "_id")
    sample = sample.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= rows).select("_id", "_y", "_text").coalesce(1)

    def trained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        net = pickle.dumps(train([t for _, _, t in got], [int(y) for _, y, _ in got]))
        got.clear()
        shared.trim()
        yield pd.DataFrame({"net": [net]})

    nets = sample.mapInPandas(trained, "net binary").collect()
    return pickle.loads(nets[0]["net"]) if nets else None


def score(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with score and predicted (in place of columns of those names), all other columns kept as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.drop("score", "predicted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in shared.pieces(batches, text, BATCH_BYTES):
            s = shipped.value.scores(pdf[text].tolist()) if shipped.value else np.zeros(len(pdf))
            yield pdf.assign(score=s, predicted=(s >= 0.5).astype(np.int32))

    return kept.mapInPandas(run, kept.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    labels = shared.table(spark, sf_dir, "labels")
    held = shared.remainder(F.col("doc_id"), 5) == 0
    net = fit(docs, labels.where(~held))
    out = score(docs.select("doc_id", held.alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "score", "predicted")
