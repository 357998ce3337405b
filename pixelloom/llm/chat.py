"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role form a block. Blocks of the
assistant are written `<s> text </s>`, all others `[INST] role [ROLE] text [/INST]`, one block a line, turns that were
merged into one block divided by ` [NEXT] `. Control strings inside roles and texts are escaped by a backslash, as are
backslashes, so a formatted string can be read back exactly (`read_back`). The loss mask is kept as segments: the
formatted string cut in pieces, each with a flag that is true for the assistant's texts alone.

Defined results: null roles and texts count as empty; null ids form one conversation, turns are sorted nulls first and
ties by role, then text; repeated rows are repeated turns; other columns are ignored; no rows give no conversations.
A conversation is one output string, so all its turns meet in one task, whatever else is in the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ASSISTANT = "assistant"
#: All control strings of the template.
CONTROLS = ("[INST]", "[/INST]", "[ROLE]", "[NEXT]", "<s>", "</s>")


def escape(col: Column) -> Column:
    out = F.replace(col, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each conversation: its id, `segments` (array of text, loss) and `formatted`, their concatenation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    # Where blocks begin: the first turn, and each whose role differs from the one before.
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.get("turns", i - 1)["role"]))
    blocks = turns.select("conv_id", "turns", begins.alias("begins"))
    block = F.transform(
        "begins",
        lambda b, i: F.slice("turns", b + 1, F.coalesce(F.get("begins", i + 1), F.size("turns")) - b),
    )

    def segments(own: Column) -> Column:
        loss = own[0]["role"] == ASSISTANT
        head = F.when(loss, F.lit("<s> ")).otherwise(F.concat(F.lit("[INST] "), escape(own[0]["role"]), F.lit(" [ROLE] ")))
        tail = F.when(loss, F.lit(" </s>")).otherwise(F.lit(" [/INST]"))
        texts = F.transform(
            own,
            lambda t, i: F.array(
                F.struct(F.when(i == 0, F.lit("")).otherwise(F.lit(" [NEXT] ")).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(t["text"]).alias("text"), loss.alias("loss")),
            ),
        )
        return F.concat(F.array(F.struct(head.alias("text"), F.lit(False).alias("loss"))), F.flatten(texts), F.array(F.struct(tail.alias("text"), F.lit(False).alias("loss"))))

    between = F.array(F.struct(F.lit("\n").alias("text"), F.lit(False).alias("loss")))
    parts = F.transform(block, lambda own, i: F.when(i == 0, segments(own)).otherwise(F.concat(between, segments(own))))
    out = blocks.select("conv_id", F.flatten(parts).alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, an array of role and text."""

    def turns(block: Column) -> Column:
        own = F.startswith(block, F.lit("<s> "))
        body = F.when(own, F.substr(block, F.lit(5), F.length(block) - 9)).otherwise(F.substr(block, F.lit(8), F.length(block) - 15))
        parts = F.split(body, r" \[ROLE\] ", 2)
        role = F.when(own, F.lit(ASSISTANT)).otherwise(unescape(parts[0]))
        texts = F.split(F.when(own, body).otherwise(F.get(parts, F.lit(1))), r" \[NEXT\] ")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(F.split(formatted, r"\n(?=\[INST\] |<s> )"), turns))


def op7(spark, sf_dir: str) -> DataFrame:
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    kinds = rows.schema
    extra = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{planted}'), (-1, 1, 'assistant', '{planted}') AS t(conv_id, turn, role, text)")
    extra = extra.select(*(F.col(f.name).cast(f.dataType) for f in kinds))
    done = format_chats(rows.unionByName(extra))
    back = done.select("conv_id", "segments", "formatted", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in CONTROLS:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '\\{_c}')"

ORACLE7 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role) OVER w AS before, lead(role) OVER w AS after FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), parts AS (
  SELECT *,
    CASE WHEN before IS NOT NULL AND before = role THEN ' [NEXT] '
         ELSE CASE WHEN i = 1 THEN '' ELSE chr(10) END || CASE WHEN role = 'assistant' THEN '<s> ' ELSE '[INST] ' || {_ESCAPED.format("role")} || ' [ROLE] ' END END
    || {_ESCAPED.format("text")}
    || CASE WHEN after IS NOT NULL AND after = role THEN '' WHEN role = 'assistant' THEN ' </s>' ELSE ' [/INST]' END AS part
  FROM placed
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(part))::BIGINT AS formatted_chars
FROM parts GROUP BY conv_id
"""
