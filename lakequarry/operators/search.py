"""Literal keyword search over flat and nested records. `_pos` is the order of the source; limits keep the first rows by it.

Every filter is literal and case-sensitive. An absent filter lets all rows through; null values match nothing. Filters come before any sort, so
they reach the scan; a limited sort keeps only the rows asked for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused

EXCERPT_CHARS = 80


def contains_all(filters: dict[str, str | None]) -> Column:
    """True where each column contains its text; columns without a text are not asked."""
    asked = [F.contains(F.col(c), F.lit(t)) for c, t in filters.items() if t]
    return reduce(lambda a, b: a & b, asked, F.lit(True))


def contains_any(columns: list[str], keyword: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.col(c), F.lit(keyword)), F.lit(False)) for c in columns])


def first(df: DataFrame, n: int, order: tuple[Column, ...] = ()) -> DataFrame:
    """The first n rows by the order, then by _pos."""
    return df.orderBy(*order, "_pos").limit(n)


def search_nested(df: DataFrame, keyword: str, column: str, items: str, item_text: str, item_label: str, filters: dict[str, str | None] | None = None, limit: int = 10) -> DataFrame:
    """Rows whose column, or some item's text in the array items, contains the keyword, with matched (array of excerpts "label: text...")."""
    holds = lambda item: F.coalesce(F.contains(item[item_text], F.lit(keyword)), F.lit(False))
    wanted = contains_all(filters or {}) & (contains_any([column], keyword) | F.coalesce(F.exists(items, holds), F.lit(False)))
    excerpt = lambda item: F.concat(item[item_label].cast("string"), F.lit(": "), F.substring(item[item_text], 1, EXCERPT_CHARS), F.lit("..."))
    return first(df.where(wanted), limit).withColumn("matched", F.transform(F.filter(items, holds), excerpt))


def search_flat(df: DataFrame, keyword: str, columns: list[str], order: tuple[Column, ...] = (), limit: int = 10) -> DataFrame:
    return first(df.where(contains_any(columns, keyword)), limit, order)


def latest(df: DataFrame, time: str, filters: dict[str, str | None] | None = None, limit: int = 10) -> DataFrame:
    """The newest rows; times that cannot be read come last."""
    return first(df.where(contains_all(filters or {})), limit, (F.desc_nulls_last(time),))


def first_match(df: DataFrame, id_column: str, wanted_id: str | None, name_column: str, wanted_name: str | None) -> DataFrame:
    """The first row whose id equals wanted_id or whose name contains wanted_name."""
    if not wanted_id and not wanted_name:
        raise Refused("INVALID_ARGUMENT", f"{id_column} or {name_column} is missing")
    tests = [t for t in (F.col(id_column) == wanted_id if wanted_id else None, F.contains(F.col(name_column), F.lit(wanted_name)) if wanted_name else None) if t is not None]
    return first(df.where(reduce(lambda a, b: a | b, tests)), 1)


def lines_with_context(df: DataFrame, key: str, text: str, keyword: str, around: int = 8) -> DataFrame:
    """key, line (from 1), content and hit of the lines that hold the keyword and of those up to `around` lines from one. Texts are taken apart in their row."""
    lines = F.split(F.col(text), "\n", -1)
    holds = F.transform(lines, lambda line: F.contains(line, F.lit(keyword)))
    near = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line"), line.alias("content"), F.get(F.col("_holds"), i).alias("hit"), F.exists(F.slice("_holds", F.greatest(F.lit(1), i + 1 - around), F.lit(2 * around + 1) - F.greatest(F.lit(0), F.lit(around) - i)), lambda h: h).alias("near")))
    rows = df.where(F.contains(F.col(text), F.lit(keyword))).select(F.col(key), F.col(text), holds.alias("_holds")).select(key, F.explode(near).alias("l"))
    return rows.where("l.near").select(key, "l.line", "l.content", "l.hit")
