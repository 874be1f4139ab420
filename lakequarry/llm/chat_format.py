r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as "[INST] text [/INST]" (user), "<s> text </s>" (assistant), "<<SYS>> text <</SYS>>" (system) or
"<|role|> role <|text|> text <|end|>" (any other role). The rendered conversation is parsed again by one regular expression, each alternative of which
ends at the first end marker, and the recovered turns are compared to the source. A conversation that differs, or whose texts hold control strings, is
rendered again with its texts escaped: one backslash goes before each control string and the backslashes right before it. Removing one gives the text
back. An escaped text holds no marker, as every control string in it follows a backslash and every marker follows a blank or a turn's end. So one round of escaping
is enough; the escaped rendering is parsed and compared too, and a conversation that still differed would stop the job with an error instead of being written.

Defined results: a null text or role is an empty one. Turns are ordered by turn, role and text (null turns first); repeated rows are turns of their own. Rows with a null
conv_id form one conversation, as in SQL's grouping. An empty table gives an empty result. Other columns are not looked at. A conversation is one row of the result, so
its turns come together in one task; nothing larger does.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

MARKERS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
CONTROL = "|".join(re.escape(x) for x in [y for pair in MARKERS.values() for y in pair] + [ROLE, TEXT, END])
TURN = "(?s)" + "|".join(f"{re.escape(a)} .*? {re.escape(b)}" for a, b in [*MARKERS.values(), (ROLE, END)])


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*(?:{CONTROL}))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*(?:{CONTROL}))", "$1")


def opening(role: Column, written: Column) -> Column:
    """What stands before a turn's text; written: the role's name as it is written."""
    case = F.concat(F.lit(f"{ROLE} "), written, F.lit(f" {TEXT} "))
    for name, (a, _) in MARKERS.items():
        case = F.when(role == name, f"{a} ").otherwise(case)
    return case


def closing(role: Column) -> Column:
    case = F.lit(f" {END}")
    for name, (_, b) in MARKERS.items():
        case = F.when(role == name, f" {b}").otherwise(case)
    return case


def parse(formatted: Column) -> Column:
    """Turns as an array of (role, text) recovered from a rendered conversation."""
    def turn(x: Column) -> Column:
        head = F.regexp_extract(x, rf"(?s)^{re.escape(ROLE)} (.*?) {re.escape(TEXT)} ", 1)
        role, start = F.lit(None), F.length(head) + len(f"{ROLE}  {TEXT} ")
        stop, name = F.lit(len(END) + 1), unescape(head)
        for known, (a, b) in MARKERS.items():
            own = F.startswith(x, F.lit(f"{a} "))
            name, start, stop = (F.when(own, F.lit(y)).otherwise(z) for y, z in ((known, name), (len(a) + 1, start), (len(b) + 1, stop)))
        return F.struct(name.alias("role"), unescape(F.substring(x, start + 1, F.length(x) - start - stop)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), turn)


def _rendered(turns: Column, rewrite) -> Column:
    def piece(t: Column) -> Column:
        written, body = rewrite(t["role"]), rewrite(t["text"])
        return F.struct(opening(t["role"], written).alias("head"), body.alias("body"), closing(t["role"]).alias("tail"), (t["role"] == "assistant").alias("loss"))

    return F.transform(turns, piece)


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], p["tail"])), "")


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (array of start from 0 and chars, in code points), escaped and identical (booleans)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    turns = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    clash = F.exists("turns", lambda t: t["text"].rlike(CONTROL) | t["role"].rlike(CONTROL))
    plain = turns.withColumn("pieces", _rendered(F.col("turns"), lambda x: x)).withColumn("escaped", clash | (parse(_joined(F.col("pieces"))) != F.col("turns")))
    done = plain.withColumn("pieces", F.when(F.col("escaped"), _rendered(F.col("turns"), escape)).otherwise(F.col("pieces")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        head, body = F.length(p["head"]), F.length(p["body"])
        span = F.array(F.struct((a["at"] + head).alias("start"), body.alias("chars")))
        return F.struct((a["at"] + head + body + F.length(p["tail"])).alias("at"), F.when(p["loss"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    out = done.select("conv_id", "turns", "escaped", _joined(F.col("pieces")).alias("formatted"), F.aggregate("pieces", start, step, lambda a: a["spans"]).alias("loss_spans"))
    failed = F.raise_error(F.concat(F.lit("a conversation differs after its round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    identical = F.when(parse(F.col("formatted")) == F.col("turns"), True).otherwise(failed.cast("boolean")).alias("identical")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "loss_spans", "escaped", identical).where("identical")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["chars"]))), "")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    found = format_conversations(rows.unionByName(extra))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = found.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_SQL_ESCAPED = rf"regexp_replace({{}}, '(\\*(?:{CONTROL}))', '\\\1', 'g')"
SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(i)
), f AS (
  SELECT *, length({_SQL_ESCAPED.format('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
    ELSE {len(ROLE) + len(TEXT) + len(END) + 4} + length({_SQL_ESCAPED.format('role')}) END AS chars
  FROM t
), c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

QUERIES = {"op10_chat_format": op10_chat_format}
ORACLES = {"op10_chat_format": SQL}
