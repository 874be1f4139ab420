"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Two base rules reject what is too short or repeats itself; the others are about one kind of junk each. Each rule's cost and rejection rate are measured on a
random sample: the seconds of a job that evaluates the rule alone over the sample's texts, less those of a job without a rule. The rules are ordered by rejections
per second, and one CASE expression evaluates them in that order and stops at the first that rejects. Statistics are expressions of the rules, so keep_good() computes only
what the rules that it comes to need. The order changes the cost and the name of the first failed rule, never the verdict, which is "no rule rejects".

Defined results: a null or empty text has no words and all statistics 0, so base_failed is true. Repeated rows
stay repeated rows. An empty table gives an empty result. Other columns of the input are not looked at, whatever their names are.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, whole_text, words_of

WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: a condition, true for documents to reject, over the statistics of a document."""

    name: str
    rejects: Callable[[Text], Column]


def _count(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]", ""))


class Text:
    """A document's statistics as expressions of its text and words."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    n_words = property(lambda self: F.size(self.words).cast("long"))
    word_chars = property(lambda self: F.length(F.array_join(self.words, "")).cast("long"))
    n_symbols = property(lambda self: _count(self.text, "#*$%&|<>").cast("long"))
    lines = property(lambda self: F.filter(F.split(self.text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    n_lines = property(lambda self: F.size(self.lines).cast("long"))
    n_dup_lines = property(lambda self: let(self.lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    n_repeat_words = property(lambda self: repeated_words(self.words).cast("long"))


class Counted:
    """A document's statistics as columns that base_stats() made."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


BASE_RULES = (
    Rule("short", lambda t: t.n_words < 10),
    Rule("repeats", lambda t: t.n_repeat_words * 100 > t.n_words * 20),
)
#: Limits far from what prose in any language has; each rule is about one kind of junk.
RULES = (
    Rule("symbols", lambda t: t.n_symbols * 4 > t.n_words),
    Rule("duplicate_lines", lambda t: (t.n_lines >= 4) & (t.n_dup_lines * 10 > t.n_lines * 6)),
    Rule("word_length", lambda t: (t.word_chars < t.n_words * 2) | (t.word_chars > t.n_words * 20)),
    Rule("shouting", lambda t: _count(t.text, "!") * 2 > t.n_words),
    Rule("letters", lambda t: F.length(F.regexp_replace(t.text, r"[^\p{L}]", "")) * 2 < t.word_chars),
)


def repeated_words(words: Column) -> Column:
    """How many words lie in 5-word windows that the text has twice or more.

    Windows are compared by a 64-bit hash. Only texts with an equal pair are sorted: their repeated windows'
    places, in order, cover min(5, distance to the place before) words each.
    """
    def hashes(w: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), at)

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda p, k: (p["h"] == F.get(s, k - 1)["h"]).eqNullSafe(True) | (p["h"] == F.get(s, k + 1)["h"]).eqNullSafe(True)))
        places = F.sort_array(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    counted = let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(counted)


def base_stats(docs: DataFrame) -> DataFrame:
    """docs (text, others) with the columns BASE (long) and base_failed; text without nulls."""
    docs = docs.drop(*BASE, "base_failed", "_words", "_lines").withColumn("text", whole_text())
    split = docs.withColumn("_words", words_of(F.col("text"))).withColumn("_lines", Text(F.col("text"), F.lit(None)).lines)
    t = Text(F.col("text"), F.col("_words"))
    counted = split.select(
        *docs.columns, t.n_words.alias("n_words"), t.word_chars.alias("word_chars"), t.n_symbols.alias("n_symbols"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), let(F.col("_words"), repeated_words).cast("long").alias("n_repeat_words"),
    )
    failed = [rule.rejects(Counted()) for rule in BASE_RULES]
    return counted.withColumn("base_failed", failed[0] | failed[1])


def order_rules(docs: DataFrame, rules=(*BASE_RULES, *RULES), sample_rows: int = 1000, repeats: int = 3) -> list[dict]:
    """Rules with the cost and rejection rate measured on a random sample of some sample_rows rows, best first.

    The sample bounds only what is measured for the order; the rules run over all rows.
    """
    texts = docs.select(whole_text().alias("text"))
    sample = texts.sample(min(1.0, sample_rows / max(1, docs.count())), seed=11).repartition(1).cache()
    rows = max(1, sample.count())

    def seconds(condition) -> tuple[float, int]:
        found = sample.agg(F.count_if(let(words_of(F.col("text")), lambda words: condition(Text(F.col("text"), words)))))
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            rejected = found.first()[0]
            took.append(time.perf_counter() - began)
        return min(took), rejected

    idle, _ = seconds(lambda t: F.size(t.words) < 0)
    out = []
    for rule in rules:
        cost, rejected = seconds(rule.rejects)
        out.append({"rule": rule, "cost_s": max(cost - idle, 1e-4), "rejection": rejected / rows})
    sample.unpersist()
    return sorted(out, key=lambda x: (-(x["rejection"] + 1e-6) / x["cost_s"], x["rule"].name))


def cascade(rules, statistics) -> Column:
    """Name of the first rule, in the given order, that rejects; null if none does. Later rules are not evaluated."""
    case = F.when(F.lit(False), "")
    for rule in rules:
        case = case.when(rule.rejects(statistics), rule.name)
    return case


def apply_rules(docs: DataFrame, rules=(*BASE_RULES, *RULES), sample_rows: int = 1000) -> DataFrame:
    """docs with the base statistics, first_failed (string, null: kept) and kept (boolean)."""
    ordered = [x["rule"] for x in order_rules(docs, rules, sample_rows)]
    return base_stats(docs).withColumn("first_failed", cascade(ordered, Counted())).withColumn("kept", F.col("first_failed").isNull())


def keep_good(docs: DataFrame, rules=(*BASE_RULES, *RULES), sample_rows: int = 1000) -> DataFrame:
    """docs without the rows that a rule rejects, other columns as they are; statistics are computed as far as a document's verdict needs them."""
    ordered = [x["rule"] for x in order_rules(docs, rules, sample_rows)]
    text = whole_text()
    return docs.where(let(words_of(text), lambda words: cascade(ordered, Text(text, words))).isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), g AS (
  SELECT r, unnest(list_transform(range(1, len(words) - 3), lambda i: struct_pack(i := i, s := array_to_string(words[i:i+4], ' ')))) AS x FROM w
), twice AS (
  SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap
  FROM (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.s) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, CAST(sum(least(5, coalesce(gap, 5))) AS BIGINT) AS n_repeat_words FROM twice GROUP BY r
), s AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 4 > n_words OR (n_lines >= 4 AND n_dup_lines * 10 > n_lines * 6)
    OR word_chars < n_words * 2 OR word_chars > n_words * 20
    OR (length(text) - length(replace(text, '!', ''))) * 2 > n_words
    OR length(regexp_replace(text, '[^\pL]', '', 'g')) * 2 < word_chars) AS kept
FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
