"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: its text holds all preceding turns as context and then its reply, and only
the reply is trained on. Turns after the last reply make a last example that trains on nothing. The template is `[role]text</s>` and
a line break a turn; the characters that its marks need are escaped inside roles and texts, reversibly.

Turns sort by turn (nulls last), then role, then text; null roles and texts count as empty; a null conv_id is one
conversation of its own; repeated rows are turns of their own; an empty table gives an empty result; other columns are
ignored. One conversation is held in one row, since its digest is one sequential hash; its examples are made one after the
other, so that they aren't in memory together, though their texts add up to about half the replies times the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import let

#: Escapes in the order in which they are put in; they are taken out in the reverse order.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lb;"), ("]", "&rb;")]
END = "</s>\n"


def escape(x: Column) -> Column:
    for a, b in ESCAPES:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column) -> Column:
    for a, b in reversed(ESCAPES):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, example_no, n_turns, text, loss_start, loss_end, trained, whole): a reply with all turns before it; offsets are code points
    in the text; whole: the conversation's last example, with all its turns."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    conv = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.isnull("turn").alias("last"), "turn", role.alias("role"), text.alias("text")))).alias("turns"))

    def ends(t: Column) -> Column:
        replies = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: F.get(t, i - 1)["role"] == "assistant")
        each = lambda e: let(F.get(t, e - 1), lambda x: F.struct(e.alias("n_turns"), F.length(escape(x["text"])).alias("reply"), (x["role"] == "assistant").alias("trained"), (e == F.size(t)).alias("whole")))
        return F.transform(F.array_distinct(F.concat(replies, F.array(F.size(t)))), each)

    shown = F.transform("turns", lambda x: F.concat(F.lit("["), escape(x["role"]), F.lit("]"), escape(x["text"]), F.lit(END)))
    rows = conv.select("conv_id", shown.alias("shown"), let(F.col("turns"), ends).alias("ends"))
    rows = rows.select("conv_id", "shown", F.posexplode("ends").alias("example_no", "x"))
    rows = rows.select("conv_id", "example_no", "x", F.array_join(F.slice("shown", F.lit(1), F.col("x.n_turns")), "").alias("text"))
    stop = F.length("text") - len(END)
    return rows.select(
        "conv_id", "example_no", "x.n_turns", "text",
        F.when(F.col("x.trained"), stop - F.col("x.reply")).alias("loss_start"), F.when(F.col("x.trained"), stop).alias("loss_end"), "x.trained", "x.whole",
    )


def expanded(rows: DataFrame) -> DataFrame:
    """Each trained example's whole text (context and reply) with the span that is trained on."""
    return rows.filter("trained").select("conv_id", "example_no", "text", "loss_start", "loss_end")


def digests(rows: DataFrame) -> DataFrame:
    """What the examples hold, read back from their texts and spans, per conversation: turns from the one with all of them, the loss from each."""
    masked = F.when(F.col("trained"), unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))).otherwise("")
    rows = rows.select("conv_id", "example_no", masked.alias("loss"), F.when(F.col("whole"), F.col("text")).alias("full"))
    conv = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example_no", "loss"))).alias("e"), F.max("full").alias("full"))
    full, loss = F.col("full"), F.array_join("e.loss", "")
    parts = F.split(full, END, -1)
    body = F.filter(parts, lambda x: x != "")
    said = F.transform(body, lambda x: F.concat(unescape(F.substring_index(F.substring(x, 2, 1 << 30), "]", 1)), F.lit("\n"), unescape(F.substring(x, F.instr(x, "]") + 1, F.length(x))), F.lit("\n")))
    return conv.select(
        "conv_id", F.size(body).cast("long").alias("n_turns"), F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length(full).cast("long").alias("formatted_chars"),
    )


def query(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return digests(examples(turns.unionByName(more)))


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(r) + length(x) + 7 + length(regexp_replace(r || x, '[^&]', '', 'g')) * 4 + length(regexp_replace(r || x, '[^<>\[\]]', '', 'g')) * 3 AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  sum(n + 0)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""
