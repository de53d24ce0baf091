"""Relational chat formatting, in Spark expressions only.

Rows of (conv_id, turn, role, text) are collected per conversation, sorted, merged where neighbours have
the same role, and concatenated. The template marks every block with its role::

    <|user|>text<|+|>next text of the same role<|end|>
    <|assistant|>text<|end|>

Roles and texts are escaped so that no ``<|`` of theirs can be taken for a mark: a backslash is doubled and
``<|`` becomes ``<\\|`` (and in roles ``|>`` becomes ``|\\>``). All steps can be undone, and a merged block keeps its joints, so the original
turns can be read back.

The loss mask is a list of flags, one for each of the segments whose concatenation is the formatted text.

A conversation becomes one string, so a conversation must fit in one task; a table of many conversations
needs one shuffle on conv_id. Edge cases: null roles and texts count as empty, ties in turn are ordered by
role and text, repeated rows are kept, null conv_ids form one conversation, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import table

TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|>"), F.lit("|\\>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("|\\>"), F.lit("|>")))


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, segments, loss_mask, formatted): formatted is the segments' concatenation, loss_mask
    says which of them are trained on."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # a block opens where the role changes, else the turn joins the block before it
    opened = turns.select(
        "conv_id",
        F.transform(
            F.arrays_zip(F.col("turns").alias("t"), F.concat(F.array(F.lit(None).cast("string")), F.col("turns.role")).alias("p"), F.concat(F.slice(F.col("turns.role"), F.lit(2), F.size("turns")), F.array(F.lit(None).cast("string"))).alias("f")),
            lambda x: F.struct(
                F.when(x["t"]["role"].eqNullSafe(x["p"]), F.lit("<|+|>")).otherwise(F.concat(F.lit("<|"), escape_role(x["t"]["role"]), F.lit("|>"))).alias("open"),
                escape(x["t"]["text"]).alias("body"),
                F.when(x["t"]["role"].eqNullSafe(x["f"]), F.lit("")).otherwise(F.lit("<|end|>\n")).alias("close"),
                (x["t"]["role"] == TRAINED_ROLE).alias("trained"),
            ),
        ).alias("parts"),
        F.size("turns").alias("n"),
    )
    parts = opened.select("conv_id", F.slice("parts", 1, F.col("n")).alias("parts"))  # the shifted roles are one longer
    return parts.select(
        "conv_id",
        F.flatten(F.transform("parts", lambda p: F.array(p["open"], p["body"], p["close"]))).alias("segments"),
        F.flatten(F.transform("parts", lambda p: F.array(F.lit(False), p["trained"], F.lit(False)))).alias("loss_mask"),
    ).withColumn("formatted", F.array_join("segments", ""))


def read_turns(formatted: Column) -> Column:
    """The turns, as structs of role and text, out of a formatted conversation."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape_role(F.regexp_extract(block, r"(?s)^<\|(.*?)\|>", 1))
        body = F.regexp_replace(block, r"(?s)^<\|.*?\|>", "")
        return F.transform(F.split(body, r"<\|\+\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_trained(segments: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    kept = F.filter(F.arrays_zip(segments.alias("s"), loss_mask.alias("m")), lambda x: x["m"])
    return F.array_join(F.transform(kept, lambda x: unescape(x["s"])), "")


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts look like a template's marks."""
    probe = r"\### Assistant: </turn> ok"
    extra = rows.sparkSession.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(extra)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_chats(with_probe(table(spark, sf_dir, "conversations")))
    read = out.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_trained(F.col("segments"), F.col("loss_mask")).alias("trained"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after,
         replace(replace(role, '\', '\\'), '<|', '<\|') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS x
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, (CASE WHEN before = role THEN '<|+|>' ELSE '<|' || r || '|>' END) || x || (CASE WHEN after = role THEN '' ELSE '<|end|>' || chr(10) END) AS piece FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
