r"""Text functions as Column expressions. White space is Unicode's, with U+FEFF; lengths and slices count code points.

Null texts are empty ones wherever a function says "or empty"; elsewhere null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: the characters that count as white space.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def quoted(literal: str) -> str:
    """A regular expression that matches just this text."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def strip(text: Column) -> Column:
    """Without white space at the ends. A run of it is read once, wherever it stands: only its first character can begin a match."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}](?<![{SPACE}]{{2}})[{SPACE}]*$", "")


def filled(text: Column) -> Column:
    """True where something is left after strip(), told by the first such character; null of a null."""
    return text.rlike(f"[^{SPACE}]")


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def normalize(text: Column) -> Column:
    """Without a byte order mark and white space at the ends; or empty."""
    return strip(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^\x{FEFF}", ""))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _named_entities(text: Column, names: tuple[tuple[str, str], ...]) -> Column:
    for name, char in names:
        text = F.regexp_replace(text, f"(?i)&{name};", char)
    return text


# The entities that are decoded, in this order, so that "&amp;lt;" becomes "<".
BASIC = (("amp", "&"), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"))
WITH_BLANK = (("nbsp", " "), *BASIC)


def _numeric_entities(text: Column, pattern: str, digits) -> Column:
    """digits(code): a code's hexadecimal digits; the last four make a UTF-16 unit."""
    char = lambda code: F.decode(F.unhex(F.lpad(F.right(digits(code), F.lit(4)), 4, "0")), "UTF-16BE")

    def decoded(text: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), char)
        joined = F.array_join(F.zip_with(F.split(text, pattern, -1), codes, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
        return F.when(text.rlike(pattern), joined).otherwise(text)

    return let(text, decoded)


def _where_any(text: Column, decoded) -> Column:
    """decoded(text) where it has an ampersand; a text without any is not searched."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def decode_basic_entities(text: Column) -> Column:
    """The five basic entities only."""
    return _where_any(text, lambda t: _named_entities(t, BASIC))


def decode_entities(text: Column) -> Column:
    """Named entities, then hexadecimal, then decimal ones."""
    def decoded(t: Column) -> Column:
        t = _numeric_entities(_named_entities(t, WITH_BLANK), "(?i)&#x([0-9a-f]+);", lambda c: c)
        return _numeric_entities(t, "&#([0-9]+);", lambda c: F.conv(c, 10, 16))

    return _where_any(text, decoded)


def escape_markup(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def text_of_markup(html: Column) -> Column:
    """Tags go first, then entities are decoded: an escaped tag stays as text."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>(?=.)", "\n")
    return collapse(decode_entities(F.regexp_replace(broken, "<[^>]+>", " ")))


def text_of_escaped_markup(html: Column) -> Column:
    """Entities are decoded first: escaped tags go too."""
    broken = F.regexp_replace(decode_entities(html), r"(?i)<br\s*/?>", "\n")
    return collapse(F.regexp_replace(broken, "<[^>]*>", " "))


def text_of_simple_markup(html: Column) -> Column:
    """Tags go first, then the five basic entities."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    return collapse(decode_basic_entities(F.regexp_replace(broken, "<[^>]*>", " ")))


def text_of_cell(html: Column) -> Column:
    """Tags go without a blank in their place."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>", " ")
    return collapse(_where_any(F.regexp_replace(broken, "<[^>]*>", ""), lambda t: _named_entities(t, WITH_BLANK)))


def label_of(text: Column) -> Column:
    """Without colons, full- or half-width, and white space at the ends."""
    return strip(F.translate(text, "：:", ""))


def without_trailing_separators(text: Column) -> Column:
    return F.regexp_replace(text, f"[,，{SPACE}](?<![,，{SPACE}]{{2}})[,，{SPACE}]*$", "")


def occurrences(text: Column, keyword: str) -> Column:
    """How often the keyword occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("long")


def snippets(text: Column, keyword: str, most: int = 3, padding: int = 45) -> Column:
    """The first most passages around the keyword, as an array.

    Each occurrence reaches padding characters to both sides; passages that meet are one. White space is collapsed, and "..." stands where the text goes on.
    One pass over the occurrences keeps the open passage and at most the passages asked for.
    """
    n, size = F.length(text), len(keyword)
    passage = "struct<start:int,stop:int>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(passage).alias("open"), F.array().cast(f"array<{passage}>").alias("done"))

    def step(state: Column, gap: Column) -> Column:
        at = state["at"] + F.length(gap)
        start, stop = F.greatest(F.lit(0), at - padding), F.least(n, at + size + padding)
        meets = start <= state["open"]["stop"]
        begin = F.when(meets, state["open"]["start"]).otherwise(start)
        closed = F.when(state["open"].isNull() | meets | (F.size(state["done"]) >= most), state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.struct((at + size).alias("at"), F.struct(begin.alias("start"), stop.alias("stop")).alias("open"), closed.alias("done"))

    gaps = F.split(text, quoted(keyword), -1)
    found = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), zero, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.slice(F.concat(s["done"], F.array(s["open"])), 1, most)))
    dots = lambda there: F.when(there, "...").otherwise("")
    return F.transform(found, lambda p: F.concat(dots(p["start"] > 0), collapse(F.substring(text, p["start"] + 1, p["stop"] - p["start"])), dots(p["stop"] < n)))


def context(text: Column, keyword: str, before: int = 100, after: int = 500) -> Column:
    """The characters around the first occurrence; null without one."""
    at = F.instr(text, keyword)
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(text, start, at + after - start))
