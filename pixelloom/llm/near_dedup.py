"""Near-duplicate documents: minima of universal hashes, banding, verification, connected components.

A document's set holds its distinct shingles of WORDS words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); one with fewer
words has its whole sequence as its one element. Documents with the same set are one class, and only the class's
smallest id goes on. Its signature has MINIMA minima of multiply-add hashes; ROWS of them make a band, and documents
that share a band are candidates. At a similarity of 0.75 all 32 bands of 4 miss a pair with a probability of 6e-6.

A document also has an odd sketch: PARITIES bits, each the parity of the number of its shingles that hash to it. Two
sketches differ in at most as many bits as the sets have unequal shingles, and a similarity of 0.75 allows at most
(|A| + |B|) / 7 of those; so a pair whose sketches differ in more can be dropped without loss. Pairs are compared on full
sets only if they pass this and their signatures agree in SURE of all places or more. SURE lies 4.4 standard deviations
under 0.75, so it loses one true pair in 10**5; every link is confirmed on full sets.

Links are found in rounds, without all pairs of a band's bucket; after each the components of the links so far are taken:
1. each document with the smallest id of each of its buckets, the two most alike of them;
2. in each bucket that still has more than one component, each document with the most alike one of each other component;
3. in each such bucket, all pairs of different components that pass the two tests.
Pairs of one component need no further link; links of rounds 2 and 3 join the components before them. Large buckets
are cut into blocks, so that no task holds one whole: sets whose sizes differ by more than the similarity allows can't
be linked, so documents are put into cells by the logarithm of their set's size, and a block meets those of its own cell
and of the two beside it only.

Defined results: null and empty texts, or those of white space, have an empty set and no link; null ids are never
linked; rows with equal ids and texts are one document (rows with equal ids and other texts are compared text by text and
are not joined by their id, so the pipeline hands over a key for each row); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import connected, extended

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
MINIMA, ROWS = 128, 4
SURE = 0.58
PARITIES = 2048
#: A similarity of NUMERATOR / DENOMINATOR leaves at most (|A| + |B|) / ODD_LIMIT unequal shingles.
ODD_LIMIT = (DENOMINATOR + NUMERATOR) / (DENOMINATOR - NUMERATOR)
BATCH_BYTES = 1 << 20
#: Cells of set sizes: a little wider than the widest ratio of linked sets, against rounding.
CELL = float(np.log(1.001 * DENOMINATOR / NUMERATOR))
#: Documents of one block of a bucket, and of one group of pairs with the same first document.
BLOCK, GROUP = 1000, 200
#: Ids (16 bytes each) up to which the list of candidates is broadcast to pick their texts; beyond, it is joined by shuffles.
BROADCAST_IDS = 200_000

TOKENS = shared.Tokenizer(shared.SPACE_SEPARATORS)
_SEEDS = shared.mix(np.arange(1, 2 * MINIMA + 1, dtype=np.uint64))
FACTORS = (_SEEDS[:MINIMA] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
TERMS = (_SEEDS[MINIMA:] >> np.uint64(32)).astype(np.uint32)
STEPS = shared.mix(np.arange(7, 7 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles (repeated ones, too) of all texts, and where each text's begin (one more at the end)."""
    w = TOKENS.words(texts)
    n = w.counts
    own = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(own, out=at[1:])
    if not at[-1]:
        return np.zeros(0, np.uint64), at
    start = np.repeat(w.offsets[:-1] - at[:-1], own) + np.arange(at[-1])
    padded = np.append(w.hash, np.zeros(WORDS, np.uint64))
    out = np.zeros(at[-1], np.uint64)
    for k in range(WORDS):
        out += padded[start + k] * STEPS[k]
    few = np.flatnonzero((n > 0) & (n < WORDS))
    for d in few:
        h = w.hash[w.offsets[d] : w.offsets[d + 1]]
        out[at[d]] = (h * STEPS[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
    return shared.mix(out), at


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minima of each text that has shingles (rows)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    first = at[:-1][np.diff(at) > 0]
    out = np.empty((len(first), MINIMA), np.uint32)
    for k in range(MINIMA):
        out[:, k] = np.minimum.reduceat(x * FACTORS[k] + TERMS[k], first)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The hash of each band (columns) of each signature (rows)."""
    h = np.zeros((len(signature), MINIMA // ROWS), np.uint64)
    for k in range(ROWS):
        h = shared.mix(h ^ signature[:, k::ROWS].astype(np.uint64)) + np.arange(1, MINIMA // ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h.view(np.int64)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in shared.pieces(batches, "_text", BATCH_BYTES):
        hashes, at = shingles(pdf["_text"].tolist())
        n = np.zeros(len(pdf), np.int64)
        keys = np.zeros((2, len(pdf)), np.uint64)
        signs: list[bytes | None] = [None] * len(pdf)
        odd: list[bytes | None] = [None] * len(pdf)
        if len(hashes):
            for d in np.flatnonzero(np.diff(at)):
                own = np.unique(hashes[at[d] : at[d + 1]])
                n[d] = len(own)
                keys[0, d] = shared.mix(own).sum(dtype=np.uint64)
                keys[1, d] = shared.mix(own ^ STEPS[1]).sum(dtype=np.uint64)
                odd[d] = np.packbits(np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes()
            for d, s in zip(np.flatnonzero(np.diff(at)), signatures(hashes, at), strict=True):
                signs[d] = s.tobytes()
        yield pd.DataFrame({"_id": pdf["_id"], "_null": pdf["_null"], "_n": n, "_k1": keys[0].view(np.int64), "_k2": keys[1].view(np.int64), "_sig": signs, "_odd": odd})


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            h = bands(np.frombuffer(b"".join(pdf["_sig"]), np.uint32).reshape(-1, MINIMA))
            yield pd.DataFrame({"_h": h.ravel(), "_rep": np.repeat(pdf["_rep"].to_numpy(), h.shape[1])})


def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in shared.pieces(batches, "_text", BATCH_BYTES):
        hashes, at = shingles(pdf["_text"].tolist())
        yield pd.DataFrame({"_doc": pdf["_id"], "_set": [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]})


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity; in whole numbers."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum()) if len(a) else 0
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are sorted by group, in each the first document's set stands before all others."""
    group, first = None, None
    for pdf in batches:
        out = []
        for a, c, doc, raw in zip(pdf["_a"], pdf["_c"], pdf["_doc"], pdf["_set"], strict=True):
            own = np.frombuffer(raw, np.uint64)
            if (a, c) != group:
                group, first = (a, c), own
            elif alike(first, own):
                out.append((a, doc))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def confirmed(pairs: DataFrame, sets: DataFrame, group: int = GROUP) -> DataFrame:
    """The pairs(a, b) whose sets reach the similarity. Of a document with many partners a set goes to every `group` of them."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / group).alias("_groups"))
    dealt = pairs.join(many, "a").select(F.col("a").alias("_a"), F.pmod(F.xxhash64("b"), F.col("_groups")).alias("_c"), "b")
    firsts = many.select(F.col("a").alias("_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_groups") - 1)).alias("_c"), F.col("a").alias("_doc"), F.lit(0).alias("_place"))
    rows = dealt.select("_a", "_c", F.col("b").alias("_doc"), F.lit(1).alias("_place")).unionAll(firsts)
    met = rows.join(sets, "_doc")
    return met.repartition("_a", "_c").sortWithinPartitions("_a", "_c", "_place").select("_a", "_c", "_doc", "_set").mapInPandas(_confirm, "a long, b long")


def _bucket_pairs(every: bool):
    """Pairs of different components that pass the tests, in each run of rows of one bucket and pair of blocks.

    Unless `every`, a document is paired with one document of each other component only, that with the most alike sketch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in shared.runs(batches, ["_h", "_i", "_j"]):
            sig, odd = sketches(pdf["_sig"], pdf["_odd"])
            rep, comp, block, n = (pdf[c].to_numpy(np.int64) for c in ("_rep", "_comp", "_block", "_n"))
            key = np.stack([pdf[c].to_numpy() for c in ("_h", "_i", "_j")])
            edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), len(pdf)]
            found = [np.zeros((2, 0), np.int64)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                cross = key[1, x] != key[2, x]
                for k in range(x, y, 32):
                    some = slice(k, min(k + 32, y))
                    ok = (comp[some, None] != comp[None, x:y]) & (rep[some, None] < rep[None, x:y])
                    if cross:
                        ok &= block[some, None] != block[None, x:y]
                    small, large = np.minimum(n[some, None], n[None, x:y]), np.maximum(n[some, None], n[None, x:y])
                    ok &= DENOMINATOR * small >= NUMERATOR * large
                    if not ok.any():
                        continue
                    unlike = np.bitwise_count(odd[some, None] ^ odd[None, x:y]).sum(2, dtype=np.int64)
                    ok &= unlike * ODD_LIMIT <= n[some, None] + n[None, x:y]
                    p, q = np.nonzero(ok)
                    gap = unlike[p, q] / (n[p + k] + n[q + x])
                    p, q = p + k, q + x
                    good = (sig[p] == sig[q]).mean(1) >= SURE
                    p, q, gap = p[good], q[good], gap[good]
                    if not every:
                        order = np.lexsort((rep[q], gap, comp[q], p))
                        p, q = p[order], q[order]
                        new = np.ones(len(p), bool)
                        new[1:] = (p[1:] != p[:-1]) | (comp[q[1:]] != comp[q[:-1]])
                        p, q = p[new], q[new]
                    found.append(np.stack([rep[p], rep[q]]))
            a, b = np.concatenate(found, 1)
            yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return run


def sketches(sig: pd.Series, odd: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(sig), np.uint8).reshape(-1, MINIMA), np.frombuffer(b"".join(odd), np.uint64).reshape(-1, PARITIES // 64)


def dedupe(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id and kept."""
    shared.release(docs.sparkSession)
    own = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    described = own.select(*shared.whole("_id"), "_text").mapInPandas(_describe, "_id long, _null boolean, _n long, _k1 long, _k2 long, _sig binary, _odd binary")
    described = shared.written(described.select(shared.unwhole("_id"), "_n", "_k1", "_k2", "_sig", "_odd"), "signatures")
    classes = described.where("_n > 0 AND _id IS NOT NULL").groupBy("_k1", "_k2", "_n").agg(F.min("_id").alias("_rep"), F.min_by(F.struct("_sig", "_odd"), "_id").alias("_s")).select("_k1", "_k2", "_n", "_rep", "_s._sig", "_s._odd")
    classes = shared.written(classes, "classes")
    buckets = shared.written(classes.select("_rep", "_sig").mapInPandas(_band_rows, "_h long, _rep long"), "bands")
    # Buckets of several documents; of those with the same documents one is enough.
    shared_by = buckets.groupBy("_h").agg(F.count("*").alias("_many"), F.min("_rep").alias("_center"), F.sum(F.xxhash64("_rep").cast("decimal(38,0)")).alias("_who")).where("_many > 1")
    shared_by = shared_by.groupBy("_many", "_center", "_who").agg(F.min("_h").alias("_h"))
    members = shared.written(buckets.join(shared_by.select("_h", "_center", "_many"), "_h"), "buckets")
    # A quarter of each minimum is enough to compare signatures: unequal ones agree by chance once in 256 places.
    quarters = F.expr("unhex(regexp_replace(hex(_sig), '(..)......', '$1'))")
    candidates = members.select(F.col("_rep").alias("_id")).distinct()
    few = candidates.count()
    if few == 0:
        edges = None
    else:
        if few <= BROADCAST_IDS:
            candidates = F.broadcast(candidates)
        sets = shared.written(own.join(candidates, "_id", "left_semi").mapInPandas(_set_rows, "_doc long, _set binary").dropDuplicates(["_doc", "_set"]), "sets")
        short = shared.written(classes.join(candidates.select(F.col("_id").alias("_rep")), "_rep", "left_semi").select("_rep", "_n", quarters.alias("_sig"), "_odd"), "sketches")
        edges = links(members, sets, short)
    out = described.select("_id", "_n", "_k1", "_k2")
    of_class = classes.select("_k1", "_k2", "_n", "_rep")
    if edges is not None:
        of_class = of_class.join(edges.withColumnsRenamed({"node": "_rep", "component": "_comp"}), "_rep", "left")
    else:
        of_class = of_class.withColumn("_comp", F.lit(None).cast("long"))
    if few <= BROADCAST_IDS and classes.count() <= BROADCAST_IDS // 4:
        of_class = F.broadcast(of_class)
    found = out.join(of_class, ["_k1", "_k2", "_n"], "left")
    component = F.when(F.col("_id").isNull() | (F.col("_n") == 0), F.col("_id")).otherwise(F.coalesce("_comp", "_rep"))
    return found.select(F.col("_id").alias(id), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def links(members: DataFrame, sets: DataFrame, short: DataFrame) -> DataFrame:
    """Components (node, component) of the documents in buckets(_h, _rep, _center, _many)."""
    pairs = members.where("_rep <> _center").select(F.col("_center").alias("a"), F.col("_rep").alias("b")).distinct()
    a, b = (short.withColumnsRenamed({"_rep": x, "_sig": f"_s{x}", "_odd": f"_o{x}", "_n": f"_n{x}"}) for x in "ab")
    rated = pairs.join(b, "b").join(a, "a").mapInPandas(_rate, "a long, b long, r double")
    best = Window.partitionBy("b").orderBy(F.col("r").desc(), "a")
    # `confirmed` reads its pairs more than once, so they are cut before: else each reading makes them anew.
    chosen = shared.cut(rated.withColumn("_k", F.row_number().over(best)).where("_k <= 2").select("a", "b"))
    known = connected(confirmed(chosen, sets))
    large = members.agg(F.max("_many")).first()[0] > BLOCK
    rows = None
    for every in (False, True):
        if rows is None:
            placed = members.join(known.withColumnRenamed("node", "_rep"), "_rep", "left").select("_h", "_rep", "_many", F.coalesce("component", "_rep").alias("_comp"))
            mixed = placed.groupBy("_h").agg(F.min("_comp").alias("_x"), F.max("_comp").alias("_y")).where("_x < _y").select("_h")
            rows = shared.written(placed.join(mixed, "_h").join(short.select("_rep", "_n"), "_rep"), "mixed")
        if large:
            dealt = blocked(rows)
        else:  # each bucket is one block, and needs no counts
            dealt = rows.drop("_many").select("*", *(F.lit(0).cast("long").alias(c) for c in ("_block", "_i", "_j")))
        dealt = dealt.join(short.drop("_n"), "_rep")
        met = shared.cut(dealt.repartition("_h", "_i", "_j").sortWithinPartitions("_h", "_i", "_j").mapInPandas(_bucket_pairs(every), "a long, b long").distinct())
        if met.isEmpty():  # no pair passes the tests, so there is none for all pairs either
            break
        more = shared.cut(confirmed(met, sets))
        if not more.isEmpty():
            known, rows = extended(known, more), None
    return known


def blocked(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows(_h, _many, _rep, _n, ...) once for each pair of blocks (_i, _j) that their block (_block) is part of; a bucket of at most `block` documents is one block."""
    cell = F.when(F.col("_many") > block, F.floor(F.log(F.col("_n").cast("double")) / CELL) + 1).otherwise(0)
    rows = rows.withColumn("_cell", cell.cast("long"))
    # Small buckets need no counts; of a large one, each cell's number of blocks goes to the cell and its neighbours.
    counts = rows.where("_many > " + str(block)).groupBy("_h", "_cell").agg(F.ceil(F.count("*") / block).alias("_b"))
    spread = counts.select("_h", F.explode(F.array(*(F.struct((F.col("_cell") + d).alias("_cell"), F.lit(-d).alias("_d"), F.col("_b")) for d in (-1, 0, 1)))).alias("_s")).select("_h", "_s.*")
    beside = spread.groupBy("_h", "_cell").agg(*(F.max(F.when(F.col("_d") == d, F.col("_b"))).alias(name) for d, name in ((-1, "_under"), (0, "_own"), (1, "_over"))))
    met = rows.join(beside, ["_h", "_cell"], "left")
    at = lambda c, salt: c * (1 << 32) + salt
    own = F.coalesce("_own", F.lit(1))

    def all_of(d: int, name: str) -> Column:
        first = at(F.col("_cell") + d, F.lit(0).cast("long"))
        return F.when(F.col(name) > 0, F.sequence(first, first + F.col(name) - 1)).otherwise(F.array().cast("array<long>"))

    others = [all_of(d, name) for d, name in ((-1, "_under"), (0, "_mine"), (1, "_over"))]
    met = met.withColumn("_mine", own).withColumn("_block", at(F.col("_cell"), F.pmod(F.xxhash64("_rep"), own)))
    each = met.withColumn("_other", F.explode(F.concat(*others)))
    return each.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_cell", "_under", "_own", "_over", "_mine", "_other", "_many")


def _rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs that pass both tests, with the share of equal minima."""
    for pdf in batches:
        if len(pdf):
            (x, p), (y, q) = sketches(pdf["_sa"], pdf["_oa"]), sketches(pdf["_sb"], pdf["_ob"])
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "r": (x == y).mean(1)})
            yield out[(out["r"] >= SURE) & (np.bitwise_count(p ^ q).sum(1, dtype=np.int64) * ODD_LIMIT <= pdf["_na"] + pdf["_nb"])]


def op6(spark, sf_dir: str) -> DataFrame:
    return dedupe(shared.table(spark, sf_dir, "documents"))
