"""A hidden Markov language model: states emit word classes, classes emit words.

Tokens are words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and one end. A word's class is a hash of its last three bytes
and of its length up to four, so a short word has a class nearly of its own; the end is a class, too. The probability of
a text is the sum over all paths of states, by the scaled forward recursion, of the classes' probabilities, times that of
each word in its class:
    known word: (c - D) / N_k, unknown: D V_k / N_k   (c, N_k, V_k: the word's count, the class's tokens and kinds)
with the absolute discount D estimated from words seen once and twice; a class without training tokens gives 1.
These are probabilities over the known words and one unknown word for each class.

The states model runs of word classes (endings and short words: language, style, kind of text), not words; what grows with
the corpus is the table of word counts, from which each word gets its share in its class.

Training: states start from a bounded sample (SAMPLE_ROWS texts, fitted on the driver), because Baum-Welch needs unequal
states to begin with; it only breaks the symmetry, as passes over all training rows follow, whose expected counts are
summed across partitions, until a pass gains less than TOLERANCE of the log likelihood or ITERATIONS are done. Counts of
words, N_k and V_k come from all training rows.

How it runs: the texts are read once into a table with a row for each text (its classes in order, and its distinct words
as numbers in a chunk's word list) and a row for each word of a chunk's list. Counts are summed by word, in part before they
move, and return to the chunks by a join, whose skew (a frequent word has a row in each chunk) Spark may split; so the
corpus's vocabulary is never in one place. A chunk is at most CHUNK_BYTES of text of one input partition (a longer text alone).

Defined results: null and empty texts have the end token only; rows with equal ids keep apart; a null id is a training
row; without training rows N and V are 0 and states are alike; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

STATES, CLASSES = 6, 1 << 14
#: The most passes over all training rows, and the relative gain of log likelihood that ends them before.
ITERATIONS, TOLERANCE = 4, 1e-3
#: The sample that the states start from: rows, tokens of a row, and rounds of each of its two steps.
SAMPLE_ROWS, SAMPLE_TOKENS, SAMPLE_ROUNDS = 400, 2000, 10
PRIOR = 50.0
CHUNK_BYTES, BATCH_BYTES = 12 << 20, 1 << 20

TOKENS = shared.Tokenizer(shared.SPACE_SEPARATORS)
END = CLASSES


def classes_of(w: shared.Words) -> np.ndarray:
    if not len(w.hash):
        return np.zeros(0, np.uint16)
    size = w.end - w.start
    d = w.data.astype(np.uint32)
    code = d[w.end - 1] | (np.where(size > 1, d[w.end - 2], 0) << np.uint32(8)) | (np.where(size > 2, d[np.maximum(w.end - 3, 0)], 0) << np.uint32(16)) | (np.minimum(size, 4).astype(np.uint32) << np.uint32(24))
    code *= np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return (code >> np.uint32(18)).astype(np.uint16)


def with_ends(cls: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with an end after each text, and the texts' new offsets."""
    n = len(offsets) - 1
    out = np.full(len(cls) + n, END, np.uint16)
    out[np.arange(len(cls)) + np.repeat(np.arange(n), np.diff(offsets))] = cls
    return out, offsets + np.arange(n + 1)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = (x.astype(np.float32) for x in (start, move, emit))  # emit: class by state

    def run(self, cls: np.ndarray, offsets: np.ndarray, counts: tuple | None = None) -> np.ndarray:
        """Natural log likelihood of each sequence; counts (start, move, emit) get the expected counts added."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        first, size = offsets[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        total = np.zeros(len(size))
        if not longest:
            return total
        # Tokens in order of time, so that a step works on one stretch; sequences with more than t tokens come first.
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        edge = np.zeros(longest + 1, np.int64)
        np.cumsum(alive, out=edge[1:])
        t = np.repeat(np.arange(longest), alive)
        seen = cls[first[np.arange(edge[-1]) - edge[t]] + t]
        alpha = self.emit[seen]
        emitted = alpha.copy() if counts else alpha
        scale = np.empty(len(seen), np.float32)
        alpha[: alive[0]] *= self.start
        for t in range(longest):
            n, now = alive[t], alpha[edge[t] : edge[t + 1]]
            if t:
                now *= alpha[edge[t - 1] : edge[t - 1] + n] @ self.move
            s = now.sum(1)
            scale[edge[t] : edge[t + 1]] = s
            now /= s[:, None]
            total[:n] += np.log(s)
        if counts:
            self._backward(seen, alive, edge, alpha, emitted, scale, counts)
        out = np.empty(len(size))
        out[order] = total
        return out

    def _backward(self, seen: np.ndarray, alive: np.ndarray, edge: np.ndarray, alpha: np.ndarray, emitted: np.ndarray, scale: np.ndarray, counts: tuple) -> None:
        emitted /= scale[:, None]
        back = np.ascontiguousarray(self.move.T)
        beta = np.ones((alive[-1], STATES), np.float32)
        pairs = np.zeros((STATES, STATES), np.float64)
        for t in range(len(alive) - 2, -1, -1):
            n, m = alive[t], alive[t + 1]
            ahead = emitted[edge[t + 1] : edge[t + 2]]
            ahead *= beta
            now = alpha[edge[t] : edge[t + 1]]
            pairs += now[:m].T @ ahead
            alpha[edge[t + 1] : edge[t + 2]] *= beta  # the posterior of each state takes the place of alpha
            beta = np.ones((n, STATES), np.float32)
            beta[:m] = ahead @ back
        alpha[: alive[0]] *= beta
        counts[0][:] += alpha[: alive[0]].sum(0)
        counts[1][:] += pairs * self.move
        for s in range(STATES):
            counts[2][:, s] += np.bincount(seen, alpha[:, s], CLASSES + 1)


def empty_counts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))


def maximised(counts: tuple) -> Model:
    """The model of expected counts; each state's classes are smoothed with those of all states."""
    start, move, emit = counts
    overall = emit.sum(1) + 1.0 / (CLASSES + 1)
    overall /= overall.sum()
    own = (emit + PRIOR * overall[:, None]) / (emit.sum(0) + PRIOR)
    return Model((start + 0.1) / (start + 0.1).sum(), (move + 0.1) / (move + 0.1).sum(1, keepdims=True), own)


def beginning(cls: np.ndarray, at: np.ndarray, seed: int = 3) -> Model:
    """A model fitted on the classes of a few texts: a mixture over whole texts first, whose parts become sticky states."""
    r = np.random.default_rng(seed)
    n = len(at) - 1
    if not n:
        return maximised(empty_counts())
    text = np.repeat(np.arange(n), np.diff(at))
    key, many = np.unique(text * (CLASSES + 1) + cls.astype(np.int64), return_counts=True)
    row, col = key // (CLASSES + 1), key % (CLASSES + 1)
    part = r.dirichlet(np.full(STATES, 0.3), n)
    for _ in range(SAMPLE_ROUNDS * 2):
        emit = np.stack([np.bincount(col, many * part[row, s], CLASSES + 1) for s in range(STATES)], 1)
        overall = emit.sum(1, keepdims=True) / emit.sum()
        log = np.log((emit + 5 * overall + 1e-9) / (emit.sum(0) + 5))
        like = np.stack([np.bincount(row, many * log[col, s], n) for s in range(STATES)], 1) + np.log(part.mean(0) + 1e-3)
        part = np.exp(like - like.max(1, keepdims=True))
        part /= part.sum(1, keepdims=True)
    move = np.full((STATES, STATES), 0.02 / STATES) + 0.98 * np.eye(STATES)
    model = maximised((part.sum(0), move * 1000, emit))
    for _ in range(SAMPLE_ROUNDS):
        counts = empty_counts()
        model.run(cls, at, counts)
        model = maximised(counts)
    return model


CODED = "kind int, g long, d long, id long, held boolean, n long, cls binary, idx binary, tf binary, word long, own int, c long"


def coded(docs: DataFrame, id: str, text: str, held) -> DataFrame:
    """The table described above: kind 0 for texts (g, d, id, held, n, cls, idx, tf), kind 1 for words (g, idx as d, word, own, c)."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = TaskContext.get().partitionId() << 24
        size, rows, lists = 0, [], []
        for pdf in shared.pieces(batches, "text", BATCH_BYTES):
            w = TOKENS.words(pdf["text"].tolist())
            cls = classes_of(w)
            ends, at = with_ends(cls, w.offsets)
            token, words = pd.factorize(w.hash)
            of_word = np.zeros(len(words), np.uint16)
            of_word[token] = cls
            trained = np.repeat(~pdf["held"].to_numpy(bool), w.counts)
            base = sum(len(x[0]) for x in lists)
            lists.append((words, of_word, np.bincount(token[trained], minlength=len(words))))
            pair, tf = np.unique(np.repeat(np.arange(len(pdf)), w.counts) * max(1, len(words)) + token, return_counts=True)
            cut = np.searchsorted(pair, np.arange(len(pdf) + 1) * max(1, len(words)))
            local = base + pair % max(1, len(words))
            for k in range(len(pdf)):
                rows.append((None if pdf["_null"].iat[k] else int(pdf["id"].iat[k]), pdf["held"].iat[k], int(at[k + 1] - at[k]), ends[at[k] : at[k + 1]].tobytes(), local[cut[k] : cut[k + 1]], tf[cut[k] : cut[k + 1]].astype(np.uint32).tobytes()))
            size += len(w.data)
            if size >= CHUNK_BYTES:
                yield from close(g, rows, lists)
                g, size, rows, lists = g + 1, 0, [], []
        if rows:
            yield from close(g, rows, lists)

    def close(g: int, rows: list, lists: list) -> Iterator[pd.DataFrame]:
        place, words = pd.factorize(np.concatenate([x[0] for x in lists]))
        own = np.zeros(len(words), np.int32)
        own[place] = np.concatenate([x[1] for x in lists])
        c = np.bincount(place, np.concatenate([x[2] for x in lists]), len(words)).astype(np.int64)
        frame = pd.DataFrame(rows, columns=["id", "held", "n", "cls", "idx", "tf"])
        frame["id"] = pd.array([x[0] for x in rows], "Int64")
        frame["idx"] = [place[x].astype(np.uint32).tobytes() for x in frame["idx"]]
        yield frame.assign(kind=0, g=g, d=np.arange(len(frame)), word=None, own=None, c=None)[[x.split()[0] for x in CODED.split(", ")]]
        for a in range(0, len(words), 100_000):
            part = slice(a, a + 100_000)
            n = len(words[part])
            yield pd.DataFrame({"kind": 1, "g": g, "d": np.arange(a, a + n), "id": None, "held": None, "n": None, "cls": None, "idx": None, "tf": None, "word": words[part].view(np.int64), "own": own[part], "c": c[part]})

    spark = docs.sparkSession
    path = shared.folder(spark, "coded")
    slim.select(*shared.whole("id"), "held", "text").mapInPandas(run, CODED).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(CODED).parquet(path)


def expected(texts: DataFrame, model: Model) -> tuple[tuple, float]:
    """The expected counts of all training texts, summed across partitions, and their log likelihood; CLASSES * STATES numbers come to the driver."""
    shipped = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, like = empty_counts(), np.zeros((1, STATES))
        for pdf in sequences(batches):
            like[0, 0] += shipped.value.run(*pdf[1], counts).sum()
        start, move, emit = counts
        every = np.concatenate([emit, move, start[None], like])
        used = np.flatnonzero(every.any(1))
        yield pd.DataFrame({"row": used} | {f"s{s}": every[used, s] for s in range(STATES)})

    columns = [f"s{s}" for s in range(STATES)]
    rows = texts.where(~F.col("held")).select("n", "cls").mapInPandas(run, "row long, " + ", ".join(f"{c} double" for c in columns))
    got = rows.groupBy("row").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    every = np.zeros((CLASSES + 1 + STATES + 2, STATES))
    every[got["row"].to_numpy(np.int64)] = got[columns].to_numpy()
    return (every[-2], every[CLASSES + 1 : -2], every[: CLASSES + 1]), float(every[-1, 0])


#: Tokens whose forward recursion runs at once, about (a longer text alone).
TOKENS_AT_ONCE = 500_000


def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray]]]:
    """The rows in groups of about TOKENS_AT_ONCE tokens, whatever the batches, with their classes and offsets."""
    held, size = [], 0
    for pdf in batches:
        part = (size + np.cumsum(pdf["n"].to_numpy())) // TOKENS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(part, prepend=0)) if len(pdf) else []), len(pdf)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if k and held:
                yield _sequence(held)
                held, size = [], 0
            if b > a:
                held.append(pdf.iloc[a:b])
        size = sum(int(p["n"].sum()) for p in held)
    if held:
        yield _sequence(held)


def _sequence(held: list[pd.DataFrame]) -> tuple[pd.DataFrame, tuple[np.ndarray, np.ndarray]]:
    own = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
    at = np.zeros(len(own) + 1, np.int64)
    np.cumsum(own["n"].to_numpy(), out=at[1:])
    return own, (np.frombuffer(b"".join(own["cls"]), np.uint16), at)


def word_counts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each word of the corpus with its class and its count in all training rows (own, c), and the chunks' words with those (cg, i, own, c)."""
    words = table.where("kind = 1").select("word", F.col("d").cast("int").alias("i"), "g", "own", "c")
    totals = shared.written(words.groupBy("word").agg(F.min("own").alias("own"), F.sum("c").alias("c")), "totals")
    return totals, words.select("word", "g", "i").join(totals, "word").select(F.col("g").alias("cg"), "i", "own", "c")


def sample_of(texts: DataFrame, rows: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes and offsets of at most `rows` training texts of at most `tokens` tokens, drawn by a bound on their hash: about that many move."""
    own = texts.where((~F.col("held")) & (F.col("n") <= tokens) & (F.col("n") > 1)).select("cls", F.xxhash64("id", "cls").alias("h"), F.lit(0).alias("one"))
    few = own.where(shared.drawn("one", {0: own.count()}, rows + 5 * int(rows**0.5) + 20, F.col("h")))
    got = [np.frombuffer(r["cls"], np.uint16) for r in few.orderBy("h", "cls").limit(rows).select("cls").collect()]
    at = np.zeros(len(got) + 1, np.int64)
    np.cumsum([len(x) for x in got], out=at[1:])
    return np.concatenate([np.zeros(0, np.uint16), *got]), at


class Words:
    """What a class says about its words."""

    def __init__(self, totals: DataFrame):
        own = totals.where("c > 0").groupBy("own").agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)), F.sum(F.when(F.col("c") == 2, 1).otherwise(0))).collect()
        self.tokens, self.kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
        once = twice = 0
        for k, n, v, one, two in own:  # a row for each class
            self.tokens[k], self.kinds[k] = n, v
            once, twice = once + one, twice + two
        self.discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
        self.n_words, self.v_words = int(self.tokens.sum()), int(self.kinds.sum())

    def log10(self, c: np.ndarray, own: np.ndarray) -> np.ndarray:
        n = self.tokens[own]
        p = np.where(c > 0, c - self.discount, self.discount * self.kinds[own]) / np.maximum(n, 1)
        return np.log10(np.where(n > 0, p, 1.0))


def score(docs: DataFrame, id: str, text: str, held, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    table = coded(docs, id, text, held)
    texts = table.where("kind = 0")
    model, was = beginning(*sample_of(texts, SAMPLE_ROWS, SAMPLE_TOKENS)), -np.inf
    for _ in range(iterations):
        counted, like = expected(texts, model)
        model = maximised(counted)
        if like - was < tolerance * abs(like):
            break
        was = like
    totals, counts = word_counts(table)
    words = Words(totals)
    ends = texts.where(~F.col("held")).count()
    n_all, v_all = words.n_words + ends, words.v_words + (ends > 0)
    shipped, known = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(words)

    def forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own, seq in sequences(batches):
            yield pd.DataFrame({"g": own["g"], "d": own["d"], "ll": shipped.value.run(*seq) / np.log(10)})

    likes = texts.select("g", "d", "n", "cls").mapInPandas(forward, "g long, d long, ll double")
    floor = float(np.log10(n_all + v_all + 1))
    end = float(np.log10(ends + 1) - floor)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Texts of a chunk and its word list."""
        size = len(right)
        c, own = np.zeros(size, np.int64), np.zeros(size, np.int64)
        c[right["i"].to_numpy()], own[right["i"].to_numpy()] = right["c"].to_numpy(), right["own"].to_numpy()
        base, log = np.log10(c + 1.0) - floor, known.value.log10(c, own) if size else np.zeros(0)
        out = np.zeros((len(left), 3))
        for k, (idx, tf) in enumerate(zip(left["idx"], left["tf"], strict=True)):
            i, n = np.frombuffer(idx, np.uint32), np.frombuffer(tf, np.uint32)
            out[k] = n @ (c[i] > 0), n @ base[i], n @ log[i]
        return pd.DataFrame({"g": left["g"], "d": left["d"], "id": left["id"], "_null": left["_null"], "held": left["held"], "n": left["n"], "k": out[:, 0].astype(np.int64) + (1 if ends else 0), "base": out[:, 1] + end, "own": out[:, 2]})

    left = texts.select("g", "d", *shared.whole("id"), "held", "n", "idx", "tf").groupBy("g")
    met = left.cogroup(counts.groupBy("cg")).applyInPandas(meet, "g long, d long, id long, _null boolean, held boolean, n long, k long, base double, own double")
    out = met.join(likes, ["g", "d"])
    return out.select(shared.unwhole("id").alias(id), F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("k").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("own") + F.col("ll")).alias("score"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return score(docs, "doc_id", "text", shared.remainder(F.col("doc_id"), 7) == 2)
