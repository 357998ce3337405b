"""Packing: optimal length buckets by dynamic programming, and batches of a token budget inside each bucket.

A document's length is its number of words (`[^\\x20\\x09-\\x0D]+`) and one end token; one longer than `longest` is cut
into consecutive pieces, so that nothing is lost. The histogram of all pieces' lengths (at most `longest` numbers, whatever
the corpus) comes to the driver, where dynamic programming picks the bucket boundaries with the least padding overall:
the cost of a bucket from one length to another is Monge, so the best split moves one way and each layer is solved by
divide and conquer. Every piece is padded to its bucket's length; a batch takes as many rows as fit the budget.

Pieces are numbered inside a bucket without gathering it: a bucket is dealt by hash into slots of about SLOT pieces,
each slot numbers its own, and running totals over the slots shift them.

Defined results: null and empty texts have length 1; rows with equal ids keep apart (they are ordered by id, text hash,
piece; equal rows get neighbouring places in parts of a slot); no rows give no batches. Other columns are not read by `pack`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

LONGEST, BUDGET, BUCKETS = 4096, 65_536, 12
SLOT = 20_000
SEPARATOR = r"[\x20\x09-\x0D]+"


def padding(hist: dict[int, int], bounds: list[int]) -> int:
    """The padding of all pieces of a histogram when each is padded to the next boundary."""
    return sum(n * (min(b for b in bounds if b >= length) - length) for length, n in hist.items())


def best_bounds(hist: dict[int, int], buckets: int) -> list[int]:
    """The (at most) `buckets` boundaries with the least padding; of equal ones, those found first from the left."""
    lengths = np.array(sorted(k for k, n in hist.items() if n > 0), np.int64)
    if not len(lengths):
        return []
    count = np.concatenate([[0], np.cumsum([hist[int(k)] for k in lengths])]).astype(object)
    total = np.concatenate([[0], np.cumsum([hist[int(k)] * int(k) for k in lengths])]).astype(object)
    if total[-1] < 2**52 and lengths[-1] * count[-1] < 2**62:
        count, total = count.astype(np.int64), total.astype(np.int64)
    m, k = len(lengths), min(buckets, len(lengths))
    best = lengths * count[1:] - total[1:]  # one bucket for the first j + 1 lengths
    choices = []
    for _ in range(1, k):
        new, choice = best.copy(), np.full(m, -1, np.int64)
        todo = [(1, m - 1, 0, m - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)  # the last length of the buckets before
            cost = best[i] + lengths[j] * (count[j + 1] - count[i + 1]) - (total[j + 1] - total[i + 1])
            at = int(np.argmin(cost))
            if cost[at] < new[j]:
                new[j], choice[j] = cost[at], i[at]
            at = int(i[at])
            todo += [(lo, j - 1, first, at), (j + 1, hi, at, last)]
        choices.append(choice)
        best = new
    bounds, j = [], m - 1
    for choice in reversed(choices):
        if j < 0:
            break
        bounds.append(int(lengths[j]))
        j = int(choice[j])
        if j < 0:
            return sorted(bounds)
    if j >= 0:
        bounds.append(int(lengths[j]))
    return sorted(bounds)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", longest: int = LONGEST, budget: int = BUDGET, buckets: int = BUCKETS, slot: int = SLOT) -> DataFrame:
    """One row for each piece: id, piece, n_tokens, bucket (its padded length), batch and place (its row in the batch)."""
    spark = docs.sparkSession
    n = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATOR), "")) + 1
    whole = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_h"), n.alias("_n"))
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / longest).cast("int"))))
    sized = cut.select("_id", "_h", "piece", F.least(F.lit(longest), F.col("_n") - F.col("piece") * longest).cast("int").alias("n_tokens"))
    # Equal pieces are one row with their number, cut into parts of a slot, so that no task numbers all of a frequent one.
    alike = sized.groupBy("_id", "_h", "piece", "n_tokens").agg(F.count("*").alias("_k"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_k") - 1) / slot))).alias("_part")
    sized = alike.select("_id", "_h", "piece", "n_tokens", "_k", part).withColumn("_k", F.least(F.lit(slot), F.col("_k") - F.col("_part") * slot))
    sized = shared.written(sized, "lengths")
    hist = {r["n_tokens"]: r["n"] for r in sized.groupBy("n_tokens").agg(F.sum("_k").alias("n")).collect()}
    bounds = best_bounds(hist, buckets)
    # Buckets, their slots and their batch sizes: one row for each length, at most `longest` rows.
    filled: dict[int, int] = {b: 0 for b in bounds}
    of = {length: min(b for b in bounds if b >= length) for length in hist}
    for length, many in hist.items():
        filled[of[length]] += many
    rows = [(length, b, max(1, budget // b), max(1, -(-filled[b] // slot))) for length, b in of.items()]
    plan = spark.createDataFrame(rows, "n_tokens int, bucket int, _rows int, _slots int")
    placed = sized.join(F.broadcast(plan), "n_tokens").withColumn("_slot", F.pmod(F.xxhash64("_id", "_h", "piece", "_part"), F.col("_slots")))
    before = Window.partitionBy("bucket").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("bucket", "_slot").agg(F.sum("_k").alias("_all")).select("bucket", "_slot", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("bucket", "_slot").orderBy("_id", "_h", "piece", "_part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_i", F.coalesce(F.sum("_k").over(own), F.lit(0))).join(totals, ["bucket", "_slot"])
    every = numbered.withColumn("_at", F.explode(F.sequence(F.col("_before") + F.col("_i"), F.col("_before") + F.col("_i") + F.col("_k") - 1)))
    batch = F.format_string("%d-%d", F.col("bucket"), F.floor(F.col("_at") / F.col("_rows")))
    return every.select(F.col("_id").alias(id), "piece", "n_tokens", "bucket", batch.alias("batch"), (F.col("_at") % F.col("_rows")).cast("int").alias("place"))


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))
