"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame functions only.

A block is a line, or a window of as many words as the template has and SLACK more, at any place of the whole text, so that
a notice may go on over line ends. Template and block are sets of words; a block meets a template that it contains to at
least THRESHOLD, that is, if it has `need` of its words, and all of its REQUIRED ones, which tell it from other licenses'
notices. All template words are ordered by their frequency in the documents,
rarest first. Of two sets that share `need` words, the block must have one of the template's first
size - need + 1 words (prefix filter), at least `need` template words in all (length filter), and enough of them from
the matched one on (positional filter); what passes is compared in full. Windows are looked at around the places of prefix
words only, as each that meets a template has one of them.

Beside this, the places of three fixed phrases are counted exactly. Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after
lower-casing A-Z.

Defined results: null and empty texts have no words, no places and no labels, and score 0. The score is the highest
containment that met the threshold, 1 where a phrase stands. Rows that occur several times get their result each time;
other columns are not read. The SQL has lines as its only blocks and no required words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decontaminate, shared

THRESHOLD = 0.8
#: Words that may stand between those of a notice.
SLACK = 4
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under a creative commons attribution sharealike 4 0 international license",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    # The opening or telling sentences of published license texts, which go over several lines.
    "agpl-notice": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    "boost-1.0": "distributed under the boost software license version 1 0",
    "bsd-3-clause": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc0": "to the extent possible under law has waived all copyright and related or neighboring rights to this work",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-notice": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
}
#: Words without which a text isn't about the license, whatever else it shares with the template.
REQUIRED = {
    "apache-2.0": "apache 2",
    "bsd": "redistribution source binary",
    "cc-by-nc-4.0": "cc nc 4",
    "cc-by-sa-4.0": "commons sharealike 4",
    "gpl-3.0": "gnu general 3",
    "mit": "mit",
    "mpl-2.0": "mozilla 2",
    "agpl-notice": "affero general",
    "apache-basis": "applicable license basis",
    "boost-1.0": "boost 1",
    "bsd-3-clause": "endorse promote contributors",
    "cc0": "waived copyright rights",
    "epl-2.0": "eclipse 2",
    "gpl-notice": "gnu general redistribute program",
    "isc": "permission distribute fee",
    "lgpl-notice": "lesser general",
    "mit-text": "permission charge deal",
    "unlicense": "unencumbered domain",
    "zlib": "authors liable warranty",
}


def frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of a fixed vocabulary stands in the documents; one number for each comes to the driver."""
    said = docs.select(F.explode(decontaminate.words(F.lower(F.col(text)))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["count"] for r in said.groupBy("w").count().collect()}


def matches(docs: DataFrame, text: str, templates: dict[str, str], threshold: float, required: dict[str, str], slack: int) -> DataFrame:
    """The similarity join: `_id`, `_h` of each document row with matching blocks, its labels and best containment."""
    sets = {k: set(v.split()) for k, v in templates.items()}
    vocabulary = sorted(set().union(*sets.values()))
    count = frequencies(docs, text, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    spans = {k: len(v.split()) + slack for k, v in templates.items()}
    index = []
    for label, tokens in sets.items():
        need = math.ceil(threshold * len(tokens) - 1e-9)
        ranked = sorted(tokens, key=rank.get)
        must = [w for w in required.get(label, "").split() if w in tokens]
        index += [(w, label, ranked, must, len(ranked), need, spans[label]) for w in ranked[: len(ranked) - need + 1]]
    prefix = sorted({row[0] for row in index})
    index_df = docs.sparkSession.createDataFrame(index, "_token string, _label string, _tokens array<string>, _must array<string>, _size int, _need int, _span int")
    literal = F.array(*map(F.lit, order))
    some = docs.where(F.arrays_overlap(decontaminate.words(F.lower(F.col(text))), F.array(*map(F.lit, prefix))))
    lines = some.select("_id", "_h", F.posexplode(F.split(shared.ascii_lower(F.col(text)), "\n")).alias("_line", "_block"))
    blocks = lines.select("_id", "_h", "_line", F.array_intersect(literal, decontaminate.words(F.col("_block"))).alias("_own")).where(F.size("_own") > 0)
    tokens = blocks.select("_id", "_h", "_own", F.posexplode("_own").alias("_at", "_token"))
    room = (F.size("_own") >= F.col("_need")) & (F.size("_own") - F.col("_at") >= F.col("_need"))
    # The index has a few rows for each template, whatever the documents are.
    met = tokens.join(F.broadcast(index_df), "_token").where(room)
    met = met.select("_id", "_h", "_label", "_size", "_need", met_words(F.col("_own")).alias("_n"))
    near = around(some.select("_id", "_h", decontaminate.words(shared.ascii_lower(F.col(text))).alias("_w")), prefix, max(spans.values()))
    near = near.join(F.broadcast(index_df), "_token").where(F.size(F.array_intersect("_region", "_tokens")) >= F.col("_need"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("_own_at") - F.col("_span") + 1), F.col("_own_at"))
    best = F.array_max(F.transform(starts, lambda s: met_words(F.slice(F.col("_region"), s + 1, F.col("_span")))))
    met = met.unionAll(near.select("_id", "_h", "_label", "_size", "_need", best.alias("_n")))
    met = met.where("_n >= _need").select("_id", "_h", "_label", (F.col("_n") / F.col("_size")).alias("_c"))
    return met.groupBy("_id", "_h").agg(F.collect_set("_label").alias("_labels"), F.max("_c").alias("_best"))


def met_words(block: Column) -> Column:
    """How many of a template's words stand in the block, 0 if a required one doesn't."""
    whole = F.size(F.array_intersect("_must", block)) == F.size("_must")
    return F.when(whole, F.size(F.array_intersect("_tokens", block))).otherwise(0)


def around(docs: DataFrame, prefix: list[str], span: int) -> DataFrame:
    """For each place of a prefix word in `_w`: the word, `_region` (the words nearer than span) and its place in that."""

    def near(word: Column, i: Column) -> Column:
        first = F.greatest(F.lit(0), i - (span - 1))
        region = F.slice(F.col("_w"), first + 1, i - first + span)
        return F.when(word.isin(prefix), F.struct(word.alias("_token"), region.alias("_region"), (i - first).alias("_own_at")))

    return docs.select("_id", "_h", F.explode(F.array_compact(F.transform("_w", near))).alias("_s")).select("_id", "_h", "_s.*")


def places(words: Column, phrase: str) -> Column:
    """The starts of a phrase's words among the words."""
    own = phrase.split()
    n = len(own)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        ok = F.get(words, i) == own[0]
        for k in range(1, n):
            ok = ok & (F.get(words, i + k) == own[k])
        return ok

    return F.when(F.array_contains(words, own[-1]), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, required: dict[str, str] = REQUIRED, slack: int = SLACK) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    own = docs.select(F.col(id).alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    met = matches(own, "_text", templates, threshold, required, slack).withColumnsRenamed({"_id": "_mid", "_h": "_mh"})
    lasts = F.array(*(F.lit(p.split()[-1]) for p in phrases))
    folded = decontaminate.words(F.lower(F.col("_text")))
    some = own.select("_id", "_h", F.size(folded).cast("long").alias("n_words"), F.when(F.arrays_overlap(folded, lasts), decontaminate.words(shared.ascii_lower(F.col("_text")))).otherwise(F.array().cast("array<string>")).alias("_w"))
    found = some.select("_id", "_h", "n_words", *(places(F.col("_w"), p).alias(f"_p{i}") for i, p in enumerate(phrases)))
    every = F.flatten(F.array(*(f"_p{i}" for i in range(len(phrases)))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"_p{i}") > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    base = found.select("_id", "_h", "n_words", every.alias("_all"), F.array_sort(F.array_distinct(labels)).alias("_base"))
    out = base.join(met, F.col("_id").eqNullSafe(F.col("_mid")) & F.col("_h").eqNullSafe(F.col("_mh")), "left")
    both = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>"))))
    return out.select(
        F.col("_id").alias(id), "n_words", F.size("_all").cast("long").alias("n_base"), F.array_min("_all").cast("long").alias("first_word"), F.array_max("_all").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), F.when(F.size("_all") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    return scan(shared.table(spark, sf_dir, "documents"))


_FOLD = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_PLACES = " ".join(
    f"UNION ALL SELECT doc_id, s, '{label}' AS label FROM spots WHERE " + " AND ".join(f"w[s + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
    for phrase, label in PHRASES.items()
).removeprefix("UNION ALL ")
_TEMPLATE_ROWS = ", ".join(f"('{k}', ['{"', '".join(sorted(set(v.split())))}'], {math.ceil(THRESHOLD * len(set(v.split())) - 1e-9)})" for k, v in TEMPLATES.items())

ORACLE9 = f"""
WITH d AS (SELECT doc_id, {_SPLIT.format(_FOLD.format("text"))} AS w, string_split({_FOLD.format("text")}, chr(10)) AS lines FROM documents),
spots AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d),
base AS ({_PLACES}),
t(label, tokens, need) AS (VALUES {_TEMPLATE_ROWS}),
blocks AS (SELECT doc_id, {_SPLIT.format("line")} AS own FROM (SELECT doc_id, unnest(lines) AS line FROM d)),
met AS (SELECT doc_id, label, len(list_intersect(own, tokens)) / len(tokens) AS c FROM blocks, t WHERE len(list_intersect(own, tokens)) >= need),
b AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
m AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id)
"""
