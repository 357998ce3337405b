"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again as the next one's input.

Language identification removes documents without an identified language, toxicity those predicted toxic, near-duplicate
removal all but one document of each component, benchmark decontamination those with a benchmark window; packing lays
out what is left. Rows with null ids or texts take part: a null text has no language and goes. Rows are rejected one by one,
by a key of their own, also where ids are null or repeated; rows with equal texts are near duplicates of each other, and the
first in the order of ids (nulls last) and text hashes stays. Extra columns stay as they are, whatever their names; an empty
table gives empty results, with the same columns. Each stage first gives back the driver's memory that the one before it took, and after training what that took.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import decontaminate, language_id, near_dedup, packing, shared, toxicity

#: Bits a byte under the best language beyond which a text is in none of the learned languages (8: no better than chance).
MOST_BITS = 6.5
#: Ids (16 bytes each) up to which a list of rejected documents is broadcast; beyond, it is joined by shuffles.
BROADCAST_IDS = 1_000_000


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.release(spark)
    trees = language_id.fit(docs.where(shared.remainder(F.col("doc_id"), 3) != 1))
    shipped = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("boolean")
    def identified(texts: pd.Series) -> pd.Series:
        out = []
        for pdf in shared.pieces([texts.to_frame("text")], "text", language_id.BATCH_BYTES):
            lang, _, bits = language_id.predict(shipped.value, pdf["text"].tolist())
            out.append((np.array(lang, object) != language_id.UND) & (bits <= MOST_BITS))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(identified("text"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.release(spark)
    labels = shared.table(spark, sf_dir, "labels").where(shared.remainder(F.col("doc_id"), 5) != 0)
    shipped = spark.sparkContext.broadcast(toxicity.fit(docs, labels))
    shared.release(spark)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        net, out = shipped.value, []
        for pdf in shared.pieces([texts.to_frame("text")], "text", toxicity.BATCH_BYTES):
            out.append(net.scores(pdf["text"].tolist()) < 0.5 if net else np.ones(len(pdf), bool))
        return pd.Series(np.concatenate(out) if out else np.zeros(0, bool))

    return docs.where(clean("text"))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    return name


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a number for each row in the order of ids: the id itself where no id is null or repeated."""
    id = F.col("doc_id").cast("long")
    rows = docs.agg(F.count("*").alias("n"), F.countDistinct(id).alias("k")).first()
    if rows["n"] == rows["k"]:
        return docs.withColumn(key, id)
    ordered = docs.orderBy(id.asc_nulls_last(), F.xxhash64("text"))
    return shared.written(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose key is in the one column of rejected, and without the key."""
    rejected = shared.cut(rejected.distinct()).toDF(name := fresh(docs, "_rejected"))
    if rejected.count() <= BROADCAST_IDS:
        rejected = F.broadcast(rejected)
    return docs.join(rejected, F.col(key) == F.col(name), "left_anti").drop(key)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.release(spark)
    docs = keyed(docs, key := fresh(docs, "_key"))
    found = near_dedup.dedupe(docs.select(key, "text"), key)
    return without(docs, key, found.where(~F.col("kept")).select(key))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.release(spark)
    docs = keyed(docs, key := fresh(docs, "_key"))
    found = decontaminate.overlaps(docs.select(key, "text"), shared.table(spark, sf_dir, "benchmark"), key)
    return without(docs, key, found.where("contaminated").select(key))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shared.release(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language ID", languages),
    ("toxicity", toxic),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the context trees nor the network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    others = shared.live()
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        shared.remove(spark, [*others, shared.live()[-1]])  # what the stage and the ones before it left is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
