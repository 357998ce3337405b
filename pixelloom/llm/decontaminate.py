"""Benchmark decontamination: a prefix-filtered set join with DataFrame functions only.

Every window of SIZE consecutive words of a benchmark item (an item of fewer words is one window) must be found in the
documents in full. Containment of the whole window needs an overlap of all its words, so the prefix of a window, with
its words ordered by their frequency in the documents, is its one rarest word. Documents' words are joined with these
prefix words; a match must leave room for the window before and after it (positional and length bounds), and the words
of the document at that place are compared with the window exactly.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. The join compares words lower-cased as Unicode
has it, which can only add candidates (such folding moves no word boundary); the exact comparison folds A-Z alone.

The window index is sent to all executors in portions of about PORTION windows and PORTION_BYTES bytes at most; a larger
benchmark takes more passes.

Defined results: null and empty texts have no words and no hits; items without words have no windows; a null item_id
counts as an empty string; a document row that occurs several times gets its result each time; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

SIZE = 10
#: Windows and words, and bytes of windows with their items' ids, that are broadcast at once.
PORTION, PORTION_BYTES = 100_000, 32 << 20
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def window_table(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Each distinct window: win (its words, joined by spaces), words, len and items (the sorted ids of the items that have it)."""
    own = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("_item"), words(shared.ascii_lower(F.col(text))).alias("_w")).where(F.size("_w") > 0)
    starts = own.select("_item", "_w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - (size - 1)))).alias("_s"))
    wins = starts.select("_item", F.slice("_w", F.col("_s"), F.lit(size)).alias("_words"))
    return wins.groupBy("_words").agg(F.sort_array(F.collect_set("_item")).alias("_items")).select(F.array_join("_words", " ").alias("_win"), "_words", F.size("_words").alias("_len"), "_items")


def window_index(docs: DataFrame, wins: DataFrame, text: str, portion: int) -> DataFrame:
    """The windows with the rarest word of each (`_anchor`) and its place in the window (`_off`)."""
    places = wins.select("_win", F.posexplode(F.transform("_words", F.lower)).alias("_off", "_anchor"))
    vocabulary = places.select("_anchor").distinct()
    said = docs.select(F.explode(words(F.lower(F.col(text)))).alias("_anchor"))
    if vocabulary.count() <= portion:
        counts = said.join(F.broadcast(vocabulary), "_anchor", "left_semi").groupBy("_anchor").count()
    else:
        counts = said.groupBy("_anchor").count().join(vocabulary, "_anchor", "left_semi")
    rarest = places.join(counts, "_anchor", "left").groupBy("_win").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "_anchor", "_off")).alias("_rare"))
    return wins.join(rarest, "_win").select("_win", "_len", "_items", F.col("_rare._anchor").alias("_anchor"), F.col("_rare._off").alias("_off"))


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, len), each word once."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["start"] + s["len"])
        return F.struct(end.alias("end"), (acc["n"] + (end - F.greatest(acc["end"], s["start"]))).cast("long").alias("n"))

    return F.aggregate(F.sort_array(spans), zero, step, lambda a: a["n"])


def overlaps(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = SIZE, portion: int = PORTION) -> DataFrame:
    """One row for each row of docs: the id, n_words, n_hit, n_items, items_sha256, contaminated and the hit spans."""
    wins = shared.cut(window_table(items, item, item_text, size))
    index = shared.cut(window_index(docs, wins, text, portion))
    keys = [F.col(id).alias("_id"), F.xxhash64(text).alias("_h")]
    all_words = docs.select(*keys, words(F.col(text)).alias("_w"))
    placed = all_words.select("_id", "_h", "_w", F.size("_w").alias("_n"), F.posexplode("_w").alias("_pos", "_word")).withColumn("_word", F.lower("_word"))
    size = F.length("_win") + F.aggregate("_items", F.lit(0), lambda s, i: s + F.length(i) + 16) + 100
    many, total = index.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    passes = max(1, -(-many // portion), -(-total // PORTION_BYTES))
    found = []
    for k in range(passes):
        part = index.where(F.pmod(F.xxhash64("_win"), F.lit(passes)) == k) if passes > 1 else index
        at = F.col("_pos") - F.col("_off")
        same = shared.ascii_lower(F.array_join(F.slice("_w", at + 1, F.col("_len")), " ")) == F.col("_win")
        found.append(placed.join(F.broadcast(part), (F.col("_word") == F.col("_anchor")) & (at >= 0) & (at + F.col("_len") <= F.col("_n")) & same).select("_id", "_h", at.alias("start"), F.col("_len").alias("len"), "_items"))
    hits = reduce(DataFrame.unionAll, found).groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("_items"))).alias("_items"))
    hits = hits.select("_id", "_h", F.sort_array("spans").alias("spans"), covered(F.col("spans")).alias("n_hit"), F.sort_array("_items").alias("items"))
    left = all_words.select("_id", "_h", F.size("_w").cast("long").alias("n_words")).alias("l")
    hits = hits.withColumnsRenamed({"_id": "_hid", "_h": "_hh"})
    out = left.join(hits, F.col("_id").eqNullSafe(F.col("_hid")) & F.col("_h").eqNullSafe(F.col("_hh")), "left")
    return out.select(
        F.col("_id").alias(id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), "spans",
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return overlaps(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark")).drop("spans")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(list_slice(w, s, s + 9), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT len(string_split(win, ' ')) AS n FROM wins),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n
),
hits AS (
  SELECT DISTINCT p.doc_id, p.s, p.n, item FROM (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win FROM places) p JOIN wins USING (win)
),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
