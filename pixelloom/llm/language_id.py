"""Language identification by prediction by partial matching.

For each language a context tree over the bytes of lower-cased sample texts (contexts of 0 to `order` bytes, escape
method C with exclusion) is frozen after training. The code length of a byte then depends on its context alone, so
the trees are laid out as one table: a row for each context known to any language, a column for each byte class and
language. A text's code length in a language is the exact sum over all its bytes; the shortest code wins.

Defined results: a null text, or one without a letter, gives `und` with score 0; with no labelled row at all every text
gives `und`; ties go to the language that sorts first. Equal rows get equal results; rows are never dropped. Columns named
lang_pred, score and bits_per_byte are replaced, all others pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ORDER = 3
#: Bounds of the labelled sample that the trees are fitted on: rows for each language, and characters of a row.
SAMPLE_ROWS, SAMPLE_CHARS = 400, 20_000
#: A context needs as many bytes in the sample to get a row of its own; rarer ones use the next shorter context.
LEAST = 3
#: Numbers in the table of all languages, which the driver builds and broadcasts: with many languages the least count of a
#: context is doubled until the table is no larger.
CELLS = 32 << 20
BATCH_BYTES = 1 << 19
UND = "und"
LETTER = regex.compile(r"\p{L}")


class Trees:
    """The frozen context trees of all languages as lookup tables."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, least: int = LEAST, cells: int = CELLS):
        self.langs = sorted(samples)
        self.order = order
        streams = {k: [t.lower().encode("utf-8", "surrogatepass") for t in v] for k, v in samples.items()}
        seen = np.zeros(256, bool)
        for texts in streams.values():
            for t in texts:
                seen[np.frombuffer(t, np.uint8)] = True
        # Class 0 stands for the start of a text, the last class for bytes that no language has shown.
        self.classes = np.full(256, int(seen.sum()) + 1, np.int64)
        self.classes[seen] = np.arange(1, int(seen.sum()) + 1)
        self.m = int(seen.sum()) + 2
        grams = {k: [self._grams(v, n) for n in range(1, order + 2)] for k, v in streams.items()}
        known = self._known(grams, least)
        while sum(map(len, known)) * self.m * len(self.langs) > cells and least < 1 << 40:
            least *= 2
            known = self._known(grams, least)
        # rows[n][context]: the row of the longest known context among its last n bytes.
        rows, first = np.zeros(1, np.int64), 1
        for n in range(1, order + 1):
            wide = np.tile(rows, self.m) if n > 1 else np.zeros(self.m, np.int64)
            wide[known[n]] = first + np.arange(len(known[n]))
            first += len(known[n])
            rows = wide
        self.row_of = rows.astype(np.int32)
        self.bits = np.empty((first, self.m, len(self.langs)), np.float32)
        for j, k in enumerate(self.langs):
            self.bits[:, :, j] = self._lengths(grams[k], known)

    def _known(self, grams: dict, least: int) -> list[np.ndarray]:
        """The contexts of each length that have rows, as numbers in base m."""
        known = [np.zeros(1, np.int64)]
        for n in range(1, self.order + 1):
            heads = [g[n][0] // self.m for g in grams.values()]
            tails = [g[n][1] for g in grams.values()]
            key, where = np.unique(np.concatenate([*heads, np.zeros(0, np.int64)]), return_inverse=True)
            total = np.bincount(where, np.concatenate([*tails, np.zeros(0)]), len(key))
            keep = key[total >= least]
            known.append(keep[np.isin(keep % self.m ** (n - 1), known[n - 1])] if n > 1 else keep)
        return known

    def _grams(self, texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of byte classes, each text after n - 1 start marks, and their counts."""
        data, at = self._laid_out(texts, self.order)
        code = np.zeros(len(data), np.int64)
        for i in range(n):
            code[n - 1 :] = code[n - 1 :] * self.m + data[i : len(data) - n + 1 + i]
        code = code[data > 0]
        key, count = np.unique(code, return_counts=True)
        return key, count.astype(np.float64)

    def _laid_out(self, texts: list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + pad for t in texts], out=at[1:])
        joined = np.frombuffer(b"".join(bytes(pad) + t for t in texts), np.uint8)
        data = self.classes[joined]
        for i in range(pad):
            data[at[:-1] + i] = 0
        return data, at

    def _lengths(self, grams: list, known: list[np.ndarray]) -> np.ndarray:
        """Bits of each byte class in each context for one language: method C, symbols seen higher up are excluded."""
        m = self.m
        shorter = np.zeros((1, m), np.float64)  # counts in the context of length 0
        key, count = grams[0]
        shorter[0, key] = count
        counts = [shorter]
        for n in range(1, len(known)):
            c = np.zeros((len(known[n]), m))
            key, count = grams[n]
            row = np.searchsorted(known[n], key // m)
            row[row == len(known[n])] = 0
            hit = known[n][row] == key // m if len(known[n]) else np.zeros(len(key), bool)
            c[row[hit], key[hit] % m] = count[hit]
            counts.append(c)
        out = []
        for n in range(len(known)):
            p = np.zeros_like(counts[n])
            left = np.ones(len(p))
            free = np.ones(p.shape, bool)
            free[:, 0] = False  # the start mark is never coded
            for k in range(n, -1, -1):
                up = known[n] % m**k if k else np.zeros(len(p), np.int64)
                at = np.searchsorted(known[k], up) if k else up
                c = np.where(free, counts[k][at], 0.0)
                total, kinds = c.sum(1), (c > 0).sum(1)
                whole = total + kinds
                p += np.where(whole > 0, left / np.maximum(whole, 1), 0.0)[:, None] * c
                left = np.where(whole > 0, left * kinds / np.maximum(whole, 1), left)
                free &= c == 0
            # Order -1: the rest is dealt evenly; the last class stands for each of the unseen bytes.
            unseen = max(1, 256 - (m - 2))
            weight = free.astype(np.float64)
            weight[:, m - 1] *= unseen
            share = left / np.maximum(weight.sum(1), 1)
            p[free] = np.broadcast_to(share[:, None], p.shape)[free]
            p[:, 0] = 1.0
            out.append(-np.log2(p))
        return np.concatenate(out).astype(np.float32)

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text in each language, and the number of bytes; nulls count as empty."""
        raw = [t.lower().encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        n = np.array([len(r) for r in raw], np.int64)
        data, at = self._laid_out(raw, self.order)
        if not n.sum():
            return np.zeros((len(raw), len(self.langs))), n
        context = np.zeros(len(data), np.int64)
        for i in range(self.order):
            context[self.order :] = context[self.order :] * self.m + data[i : len(data) - self.order + i]
        cell = self.row_of[context].astype(np.int64) * self.m + data
        # Start marks cost nothing, so a text's sum is that of its own bytes.
        sums = np.add.reduceat(self.bits.reshape(-1, len(self.langs))[cell], at[:-1], axis=0, dtype=np.float64)
        return sums, n


def predict(trees: Trees, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and bits a byte of each text."""
    if not trees.langs:
        return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    bits, n = trees.score(texts)
    best = bits.argmin(1)
    # The posterior of the best language, for at most 64 bytes' worth of evidence so that it doesn't saturate.
    gap = (bits - bits.min(1, keepdims=True)) * np.minimum(1.0, 64.0 / np.maximum(n, 1))[:, None]
    score = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(1)
    rate = bits.min(1) / np.maximum(n, 1)
    und = np.array([not isinstance(t, str) or LETTER.search(t) is None for t in texts], bool)
    return [UND if u else trees.langs[b] for u, b in zip(und, best, strict=True)], np.where(und, 0.0, score), rate


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, order: int = ORDER) -> Trees:
    """Trees of at most `rows` labelled texts of at most `chars` characters for each language, picked by a hash of id and text.

    Rows are drawn by a bound on their hash, which follows from the number of rows of a language, and only the drawn ones
    are ranked, so a task sees about `rows` of a language, however many there are.
    """
    own = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= chars))
    own = own.select(F.col(lang).alias("_lang"), F.xxhash64(id, text).alias("_h"), F.col(text).alias("_text"))
    counts = {r["_lang"]: r["count"] for r in own.groupBy("_lang").count().collect()}  # a row for each language
    few = own.where(shared.drawn("_lang", counts, rows + 5 * int(rows**0.5) + 20, F.col("_h")))
    rank = Window.partitionBy("_lang").orderBy("_h", "_text")
    chosen = few.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= rows).select("_lang", "_text")
    samples: dict[str, list[str]] = {}
    for k, t in sorted(map(tuple, chosen.collect())):
        samples.setdefault(k, []).append(t)
    return Trees(samples, order)


def identify(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte (in place of columns of those names), all other columns kept as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    names = ["lang_pred", "score", "bits_per_byte"]
    kept = docs.drop(*names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in shared.pieces(batches, text, BATCH_BYTES):
            lang, score, rate = predict(shipped.value, pdf[text].tolist())
            yield pdf.assign(lang_pred=lang, score=score, bits_per_byte=rate)

    schema = kept.select("*", F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(0.0).alias(names[2])).schema
    return kept.mapInPandas(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    held = shared.remainder(F.col("doc_id"), 3) == 1
    trees = fit(docs.where(~held))
    slim = docs.select("doc_id", held.alias("held_out"), "text")
    shipped = spark.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in shared.pieces(batches, "text", BATCH_BYTES):
            lang, score, rate = predict(shipped.value, pdf["text"].tolist())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": lang, "score": score, "bits_per_byte": rate})

    return slim.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
