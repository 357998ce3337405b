"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: each distinct word (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased) weighs the square root
of its count times its length in bytes, so that long words say more than short ones. For each of SAMPLES seeds a word
draws r and c from gamma(2, 1) and b from uniform(0, 1), all from hashes of word and seed, so that every text draws the
same; with weight w it gets t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The word with the least
a, together with its t, is the seed's sample. Two texts get equal samples with the probability of their generalised
Jaccard similarity, sum of minima over sum of maxima of the weights.

A fingerprint is the text of all samples, 8 hexadecimal digits each; the likeness of two is the share of equal ones.

Defined results: a text without words (null and empty ones, too) has samples of zeros only, equal to its like and to
nothing else; equal texts have equal fingerprints; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SAMPLES = 64
#: Documents of a bucket in `with_next` and the most buckets (their bounds come to the driver); a larger one is sorted on disk and streams through.
BUCKET, BUCKETS = 1000, 10_000
BATCH_BYTES = 1 << 20
AT_ONCE = 1 << 11

TOKENS = shared.Tokenizer(shared.PUNCT_SEPARATORS)
SEEDS = (shared.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3 (32 bits, public domain)."""
    h = h ^ (h >> np.uint32(16))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes of 32 bits."""
    u = (h >> np.uint32(8)).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-24)
    return u


def draws(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each word (rows) and seed (columns)."""
    h = mixed((words ^ (words >> np.uint64(32))).astype(np.uint32)[:, None] ^ SEEDS)
    u = []
    for _ in range(5):
        u.append(uniform(h))
        h = mixed(h + np.uint32(0x9E3779B9))
    return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), u[4]


def packed(ln_a: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """A number that sorts as ln_a and carries the 32 bits of the sample."""
    bits = ln_a.view(np.int32)
    bits = bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))
    out = bits.astype(np.int64) << 32
    out |= sample
    return out


def outcome(words: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
    """ln a, and the word with its t, of each word with its weight and each seed, packed for minima."""
    r, ln_c, b = draws(words)
    t = np.floor(ln_w[:, None] / r + b)
    b -= t
    b -= 1
    b *= r
    b += ln_c
    own = ((words >> np.uint64(20)).astype(np.uint32)[:, None] ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))) | np.uint32(1)
    return packed(b, own)


def samples(texts: list) -> np.ndarray:
    """The samples of each text, as numbers of 32 bits; zeros for texts without words."""
    w = TOKENS.words(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    if not len(w.hash):
        return out
    token, words = pd.factorize(w.hash)
    size = np.zeros(len(words), np.float32)
    size[token] = w.end - w.start
    pair = np.repeat(np.arange(len(texts)), w.counts) * len(words) + token
    pair, count = np.unique(pair, return_counts=True)
    text, word = pair // len(words), pair % len(words)
    # A word that a text has once, by far the most frequent case, has the same outcome in all such texts.
    single = np.concatenate([outcome(words[a : a + AT_ONCE], np.log(size[a : a + AT_ONCE])) for a in range(0, len(words), AT_ONCE)])
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    filled = np.flatnonzero(np.diff(first))
    done = 0
    while done < len(filled):  # some texts at a time, of about AT_ONCE words
        stop = max(done + 1, int(np.searchsorted(first[filled + 1], first[filled[done]] + AT_ONCE, "right")))
        rows = slice(first[filled[done]], first[filled[stop - 1] + 1])
        value = single[word[rows]]
        more = np.flatnonzero(count[rows] > 1)
        if len(more):
            k = word[rows][more]
            value[more] = outcome(words[k], np.log(size[k]) + np.float32(0.5) * np.log(count[rows][more]).astype(np.float32))
        least = np.minimum.reduceat(value, first[filled[done:stop]] - rows.start, axis=0)
        out[filled[done:stop]] = (least & 0xFFFFFFFF).astype(np.uint32)
        done = stop
    return out


def written_out(sample: np.ndarray) -> str:
    return sample.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(-1)


def with_next(docs: DataFrame, id: str, text: str, bucket: int) -> DataFrame:
    """id, text, bucket and tail of all rows, dealt to buckets by ranges of the id and sorted inside each.

    The first row of the next bucket follows each bucket's rows as its tail, so that every row meets its successor.
    Range bounds are approximate quantiles, one for about `bucket` rows; they are the same for the whole run.
    """
    slim = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    n = slim.count()
    parts = min(BUCKETS, max(1, n // bucket))
    inner = [k / parts for k in range(1, parts)]
    bounds = np.unique(np.array(slim.where(F.col("_id").isNotNull()).approxQuantile("_id", inner, 0.1 / parts) if inner else [], np.float64))

    @F.pandas_udf("long")
    def at(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.float64), "right")))

    dealt = slim.withColumn("_bucket", at("_id"))
    firsts = dealt.groupBy("_bucket").agg(F.min(F.struct(F.col("_id").isNotNull(), "_id")).alias("_f")).select("_bucket", "_f._id").collect()
    order = sorted((r["_bucket"], r["_id"]) for r in firsts)  # one row for each bucket
    heads = {i: a for (a, _), (_, i) in zip(order[:-1], order[1:], strict=True)}
    if len(order) > 1:
        heads_df = docs.sparkSession.createDataFrame([(i, a) for i, a in heads.items()], "_id long, _prev long")
        # Of a head's id the first text alone, however often the id occurs.
        tails = dealt.join(F.broadcast(heads_df), "_id").groupBy("_id", "_prev").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text")).select("_id", "_text", F.col("_prev").alias("_bucket"))
        rows = dealt.withColumn("_tail", F.lit(False)).unionByName(tails.withColumn("_tail", F.lit(True)))
    else:
        rows = dealt.withColumn("_tail", F.lit(False))
    return rows.repartition(max(1, min(parts, len(order))), "_bucket").sortWithinPartitions("_bucket", "_tail", F.col("_id").asc_nulls_first(), "_text")


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses; rows in ascending id (nulls first, ties by text).

    A text's last half is replaced by the beginning of the next text; after the last row comes the first.
    """
    rows = with_next(docs, id, text, bucket).select(*shared.whole("_id"), "_text", "_bucket", "_tail")
    own = docs.select(F.col(id).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    least = own.agg(F.min(F.struct(F.col("_id").isNotNull(), "_id")).alias("_f")).first()["_f"]
    wrap = own.where(F.col("_id").eqNullSafe(F.lit(least["_id"]).cast("long"))).agg(F.min("_text")).first()[0] if least else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None  # the last row seen: bucket, id, text, tail; its successor isn't known yet
        for pdf in shared.pieces(batches, "_text", BATCH_BYTES):
            texts = [t if isinstance(t, str) else "" for t in pdf["_text"]]
            ids = [None if none else int(i) for i, none in zip(pdf["_id"], pdf["_null"], strict=True)]
            rows = [*([held] if held else []), *zip(pdf["_bucket"], ids, texts, pdf["_tail"], strict=True)]
            held = rows[-1]
            if len(rows) > 1:
                yield finish(rows, False)
        if held:
            yield finish([held], True)

    def finish(rows: list[tuple], last: bool) -> pd.DataFrame:
        """Results of all rows but the last (of it, too, at the end); a bucket without a tail is the last of all."""
        out = []
        for k, (bucket, i, t, tail) in enumerate(rows):
            if not tail and (k < len(rows) - 1 or last):
                follows = k + 1 < len(rows) and rows[k + 1][0] == bucket
                out.append((i, t, rows[k + 1][2] if follows else wrap))
        changed = [edited(t, n) for _, t, n in out]
        # One call for all, so that words are drawn once.
        texts = list(dict.fromkeys([t for _, t, _ in out] + changed + [n for _, _, n in out]))
        place = {t: k for k, t in enumerate(texts)}
        every = samples(texts)
        mine, theirs, after = (every[np.array([place[t] for t in own], np.int64)].reshape(-1, SAMPLES) for own in ([t for _, t, _ in out], changed, [n for _, _, n in out]))
        return pd.DataFrame({
            id: pd.array([i for i, *_ in out], "Int64"), "n_chars": [len(t) for _, t, _ in out],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [written_out(s) for s in mine], "edited_fingerprint": [written_out(s) for s in theirs],
            "near_edited": likeness(mine, theirs), "near_next": likeness(mine, after),
        }).astype({"edited_sha256": object, "fingerprint": object, "edited_fingerprint": object})

    return rows.mapInPandas(run, f"`{id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark, sf_dir: str) -> DataFrame:
    return compare(shared.table(spark, sf_dir, "documents"))
