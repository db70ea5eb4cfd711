"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A turn is ``### role``, a line end, the text, a line end, ``</turn>``, a line end. A deterministic parser, written as SQL, reads
rendered text back: it splits at the closing line and at the first line end of each part, and takes one backslash
away before each control string (``### `` and ``</turn>``). A turn is first rendered as it is; if the parser doesn't give the same turn back, a backslash is put
before each control string in its text. The whole conversation is then parsed, and a
difference from the source stops the job. Percent signs and line ends in roles are percent-coded.

Defined results: turns are sorted by turn, nulls first, then role, then text, so ties and repeated rows have one order. A null role or
text is empty. Rows with a null conv_id are one conversation. An empty table gives no conversation; other columns, whatever their names, are ignored.
A conversation is held in one row, as its digest needs, so all its text has 2 GB at most; its turns are sorted on disk where they don't fit. A very long text is a turn like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CONTROL = r"(### |</turn>)"
CLOSE = "\n</turn>\n"
HARD = r"\### Assistant: </turn> ok"
LEARNT = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def head(role: Column) -> Column:
    coded = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit("### "), coded, F.lit("\n"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(head(role), text, F.lit(CLOSE))


def parsed(text: Column) -> Column:
    """The turns (role, text) of rendered text; a part without a head gives null fields."""
    parts = F.split(text, CLOSE, -1)

    def turn(part: Column) -> Column:
        cut = F.instr(part, "\n")
        ok = part.startswith(F.lit("### ")) & (cut > 0)
        role = F.replace(F.replace(F.substring(part, F.lit(5), cut - 5), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
        body = F.substring(part, cut + 1, F.length(part))
        return F.struct(F.when(ok, role).alias("role"), F.when(ok, unescaped(body)).alias("text"))

    # outside the lambda, so that the text is split once and not for each part
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(whole, turn)


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, spans for each conversation; a span (start, length) is the text of a turn to learn from, in code points from 0."""
    empty = F.lit("")
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), empty).alias("role"), F.coalesce(F.col(text).cast("string"), empty).alias("text"))
    plain = rendered(F.col("role"), F.col("text"))
    source = F.array(F.struct("role", "text"))
    # a text without a control string can't be mistaken for anything, so only the others are parsed to decide
    safe = ~F.col("text").rlike(CONTROL)
    marked_turn = ~safe & ~F.coalesce(parsed(plain) == source, F.lit(False))
    rows = rows.withColumn("marked", marked_turn)
    body = F.when(F.col("marked"), escaped(F.col("text"))).otherwise(F.col("text"))
    # where each turn begins is a running sum, so a conversation takes time in proportion to its length
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("body", body).withColumn("head", F.length(head(F.col("role")))).withColumn("at", F.coalesce(F.sum(F.col("head") + F.length("body") + len(CLOSE)).over(order), F.lit(0)))
    turn_at = F.struct("at", F.struct((F.col("at") + F.col("head")).alias("start"), F.length("body").cast("long").alias("length")).alias("span"), "role", "text", "body")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn_at)).alias("t"))

    whole = grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: rendered(t["role"], t["body"])), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["role"] == LEARNT), lambda t: t["span"]).alias("spans"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    return whole.withColumn("turns", parsed(F.col("formatted"))).select(
        "conv_id", "formatted", "spans", F.when(F.coalesce(F.col("turns") == F.col("source"), F.lit(False)), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation doesn't survive the round trip"))).alias("turns")
    )


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted text; the learnt texts are those of the parsed turns, which is what the spans hold, unescaped."""
    learnt = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNT), lambda t: t["text"]), "")
    return conversations.withColumn("_learnt", learnt).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return digests(formatted(rows.unionByName(hard)))


#: formatted_chars: a head of 5 characters and a role, a close of 9, and in texts that need it a backslash for each control string.
OP8_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 14
      + CASE WHEN regexp_matches(text, '\\(### |</turn>)') OR contains(chr(10) || text || chr(10), chr(10) || '</turn>' || chr(10))
             THEN len(regexp_extract_all(text, '### |</turn>')) ELSE 0 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
