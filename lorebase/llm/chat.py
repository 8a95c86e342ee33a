"""Chat formatting as relational algebra: sort the collected turns, merge neighbours of one role, concatenate.

Every control string starts with ``<|``; inside texts and roles each ``<`` before any number of ``\\`` and a ``|`` gets
one ``\\`` more, so a text never holds a control string and reading back takes that one away. Adjacent turns of one
role form one block; ``<|sep|>`` inside it keeps them apart, so the turns can be told again.

``<|start|>role<|text|>first<|sep|>second<|end|>`` per block. The loss mask covers the texts of assistant turns.

Defined cases: null text and null role are empty; turns are ordered by (turn, role, text), null turns first; repeated
rows are turns of their own; a null conversation id is one conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, SEP, END = "<|start|>", "<|text|>", "<|sep|>", "<|end|>"


def escaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescaped(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted), from conv_id, turn, role, text. One shuffle by conv_id."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    seq = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role = lambda i: F.get(F.col("turns"), i)["role"]
    # a turn opens a block unless the one before has its role, and closes one unless the one after has it
    opens = lambda i: (i == 0) | (role(i - 1) != role(i))
    closes = lambda i: (i == F.size("turns") - 1) | (role(i + 1) != role(i))
    pieces = F.transform(
        "turns",
        lambda t, i: F.concat(
            F.when(opens(i), F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT))).otherwise(F.lit(SEP)),
            escaped(t["text"]),
            F.when(closes(i), F.lit(END)).otherwise(F.lit("")),
        ),
    )
    return seq.select("conv_id", F.array_join(pieces, "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``, an array of (role, text), told from ``formatted`` alone."""
    blocks = F.filter(F.split("formatted", r"<\|start\|>", -1), lambda b: b != "")
    body = lambda b: F.expr("1") if b is None else F.split(b, r"<\|text\|>", 2)
    each = lambda b: F.transform(
        F.split(F.regexp_replace(F.get(body(b), F.lit(1)), r"<\|end\|>$", ""), r"<\|sep\|>", -1),
        lambda x: F.struct(unescaped(F.get(body(b), F.lit(0))).alias("role"), unescaped(x).alias("text")),
    )
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, each)))


def digests(turns: DataFrame) -> DataFrame:
    """The columns of query op9, all read back from the formatted text."""
    all_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read_back(format_chats(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(all_text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    turn = lambda i, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), said.alias("text"))
    more = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    return digests(rows.unionByName(more))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS erole, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS etext,
    lag(role) OVER w AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN before IS NULL OR before <> role THEN 17 + length(erole) ELSE 7 END
      + CASE WHEN after IS NULL OR after <> role THEN 7 ELSE 0 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
