"""What the corpus operators share: the shared folder, bounded batches, and a vectorised tokenizer.

Everything here handles null and empty texts (no words) and texts of any length.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separator bytes of the two word definitions; all are ASCII, so they can be found in UTF-8 bytes.
SPACE_SEPARATORS = frozenset([0x20, *range(0x09, 0x0E)])
PUNCT_SEPARATORS = frozenset([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows that go to a Python worker at once, at most: with Spark's 10,000 a batch of long texts takes a gigabyte.
ARROW_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Keeps the session's batches for Python workers small; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "0")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Only where the session has none (tests in local mode) a temporary one is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


#: Folders of intermediate tables that this process has written and not removed.
_WRITTEN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """The URI of a new folder in the shared one; it is removed when the driver's JVM ends, or by `remove`."""
    sc = spark.sparkContext
    base = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pixelloom-{sc.applicationId}")
    store = base.getFileSystem(sc._jsc.hadoopConfiguration())
    store.mkdirs(base)
    store.deleteOnExit(base)
    uri = f"{store.makeQualified(base).toString()}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(uri)
    return uri


def live() -> list[str]:
    """The URIs of the intermediate tables, the one written last at the end."""
    return list(_WRITTEN)


def remove(spark: SparkSession, keep: list[str]) -> None:
    """Removes all intermediate tables but those under the URIs in keep; for use when what reads them has been written."""
    for uri in [u for u in _WRITTEN if u not in keep]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(uri)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again (smaller than a checkpoint)."""
    spark = df.sparkSession
    bounded(spark)
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffles and checkpoints nobody needs any more, and gives the driver's free memory back."""
    bounded(spark)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim()


def trim() -> None:
    """Gives the free memory of this process back, where the C library can."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def remainder(col: Column, k: int) -> Column:
    """crc32 of the id's text modulo k; null ids give null."""
    return F.crc32(col.cast("string").cast("binary")) % k


def drawn(group: str, counts: dict, rows: int, hash: Column) -> Column:
    """Whether a row is drawn: about `rows` of each group, whose sizes are counts, by a bound on a hash of 64 bits.

    The rows drawn are those with the least hashes, so a larger draw holds every smaller one; `rows` is exceeded by five
    standard deviations with a probability of 1 in a million only, and all rows of a group of at most `rows` are drawn.
    """
    out = F.lit(False)
    for value, n in counts.items():
        bound = -(2**63) + int(2**64 * rows / max(1, n))
        mine = F.col(group).eqNullSafe(F.lit(value))
        out = out | (mine if n <= rows else mine & (hash < F.lit(bound)))
    return out


def whole(col: str) -> list[Column]:
    """The column with 0 for nulls, and whether it is null (as `_null`): of longs with nulls pandas makes floating-point numbers, which hold 53 bits."""
    return [F.coalesce(F.col(col), F.lit(0).cast("long")).alias(col), F.col(col).isNull().alias("_null")]


def unwhole(col: str) -> Column:
    """The column that `whole` took, with its nulls."""
    return F.when(~F.col("_null"), F.col(col)).alias(col)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def pieces(batches: Iterable[pd.DataFrame], col: str, max_bytes: int) -> Iterator[pd.DataFrame]:
    """The rows again in batches of about max_bytes of text (a longer text alone).

    After the last one the worker's free memory goes back, so that an idle worker doesn't hold what its largest task took.
    """
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf[col].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
        part = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pdf.iloc[a:b].reset_index(drop=True)
    trim()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (public-domain constants of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Tokenizer:
    """Words of many texts at once, as 64-bit hashes, after lower-casing A-Z."""

    def __init__(self, separators: frozenset[int]):
        self.word = np.array([b not in separators for b in range(256)])
        if 0x41 not in separators or separators is PUNCT_SEPARATORS:
            for b in range(0x41, 0x5B):  # upper-case letters become lower-case ones before words are cut
                self.word[b] = True
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[0x41:0x5B] += 32
        self.weight = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.power = self._powers(64)

    @staticmethod
    def _powers(n: int) -> np.ndarray:
        return np.cumprod(np.full(n, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)

    def bytes_of(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, each after one space, and where each starts (one more at the end)."""
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=at[1:])
        return np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8), at

    def words(self, texts: list, at_once: int = 2 << 20) -> Words:
        """The words of all texts; about at_once characters are worked on at a time, which bounds the memory."""
        part = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts]) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(texts)]
        done = [self._words(texts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if len(done) == 1:
            return done[0]
        tokens = np.cumsum([0, *(len(w.hash) for w in done)])
        places = np.cumsum([0, *(len(w.data) for w in done)])
        offsets = np.concatenate([[0], *(w.offsets[1:] + n for w, n in zip(done, tokens, strict=False))]).astype(np.int64)
        start, end = (np.concatenate([getattr(w, k) + n for w, n in zip(done, places, strict=False)]) for k in ("start", "end"))
        return Words(np.concatenate([w.hash for w in done]), offsets, start, end, np.concatenate([w.data for w in done]))

    def _words(self, texts: list) -> Words:
        data, at = self.bytes_of(texts)
        isw = self.word[data]
        edge = np.flatnonzero(isw[1:] != isw[:-1]) + 1
        start, end = edge[0::2], edge[1::2]
        offsets = np.searchsorted(start, at)
        if not len(start):
            none = np.zeros(0, np.int64)
            return Words(np.zeros(0, np.uint64), offsets, none, none, self.fold[data])
        size = end - start
        if size.max() > len(self.power):
            self.power = self._powers(int(size.max()))
        low = self.fold[data]
        letters = low[isw]
        first = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(len(letters), dtype=np.int64)
        place -= np.repeat(first, size)
        value = self.weight[letters]
        value *= self.power[place]
        return Words(mix(np.add.reduceat(value, first) + size.astype(np.uint64)), offsets, start, end, low)


class Words:
    """hash: of each word; offsets[d]:offsets[d + 1] are the words of text d; start, end: bytes in data (lower-cased)."""

    def __init__(self, hash: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray):
        self.hash, self.offsets, self.start, self.end, self.data = hash, offsets, start, end, data

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by keys, cut so that no run of equal keys is divided."""
    rest = None
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        same = np.ones(len(pdf), bool)
        for k in keys:
            same &= (pdf[k] == pdf[k].iloc[-1]).to_numpy()
        at = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        if at:
            yield pdf.iloc[:at].reset_index(drop=True)
        rest = pdf.iloc[at:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest
