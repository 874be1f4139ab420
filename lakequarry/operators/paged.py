"""Full-text search over records of numbered pages: hits, snippets, page texts, and bounded scans over many records.

Pages are rows (record_id, page, text). All matching is done within a page's row, without a shuffle; only the counts by record are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.text import occurrences, snippets


def pages_of(records: DataFrame, pages: str = "pages") -> DataFrame:
    """Rows of each record's page, from an array of (page, text)."""
    return records.select("record_id", F.explode(pages).alias("p")).select("record_id", "p.page", "p.text")


def pages_from_text(df: DataFrame, key: str, text: str = "text", separator: str = "\n") -> DataFrame:
    """A text's parts as pages from 1 on."""
    return df.select(F.col(key).alias("record_id"), F.posexplode(F.split(F.col(text), separator, -1)).alias("page", "text")).withColumn("page", F.col("page") + 1)


def complete() -> Column:
    """True for a record (record_id, total_pages, pages) that has total_pages pages, numbered from 1 on, with texts, and a number as its id; false for any other, nulls too."""
    numbered = F.forall(F.transform("pages", lambda p, i: (p["page"] == i + 1) & p["text"].isNotNull()), lambda ok: ok)
    return F.coalesce((F.size("pages") == F.col("total_pages")) & numbered & F.col("record_id").rlike("^[0-9]+$"), F.lit(False))


def require_complete(records: DataFrame) -> DataFrame:
    """Records, refused unless each is complete."""
    bad = records.where(~complete()).limit(1).collect()
    if bad:
        raise Refused("CACHE_CONTRACT_INVALID", f"record {bad[0].record_id} has other pages than it says")
    return records


def matches(pages: DataFrame, keyword: str, most: int = 3, padding: int = 45) -> DataFrame:
    """record_id, page, match_count and snippets of the pages that hold the keyword."""
    hit = pages.where(F.contains("text", F.lit(keyword)))
    return hit.select("record_id", "page", occurrences(F.col("text"), keyword).alias("match_count"), snippets(F.col("text"), keyword, most, padding).alias("snippets"))


def page_text(pages: DataFrame, record_id: str, page: int) -> str:
    """The text of one page; refused when the record has no such page."""
    found = pages.where((F.col("record_id") == record_id) & (F.col("page") == page)).select("text").first()
    if found is None:
        raise Refused("INVALID_ARGUMENT", f"record {record_id} has no page {page}")
    return found.text


def by_record(found: DataFrame) -> DataFrame:
    """record_id, matched_pages_count, match_count and matches (array by page) of what matches() gives. A record's matches are its answer: one row."""
    return found.groupBy("record_id").agg(
        F.count("*").alias("matched_pages_count"), F.sum("match_count").alias("match_count"), F.array_sort(F.collect_list(F.struct("page", "match_count", "snippets"))).alias("matches"),
    )


def scan(index: DataFrame, pages: DataFrame | Callable[[DataFrame], DataFrame], keyword: str, records: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches by record, failures, statistics in one row) over the first records of the index (_pos, record_id).

    The limit comes before the search. pages: the pages of all records, or a function that gives the pages of the chosen ones from their ids (record_id), so that nothing else is read or taken apart. A record without any page fails
    with a reason and the scan goes on.
    """
    chosen = index.orderBy("_pos").limit(records)
    ids = F.broadcast(chosen.select("record_id"))  # `records` rows at most
    own = pages(ids) if callable(pages) else pages.join(ids, "record_id", "left_semi")
    known = own.groupBy("record_id").agg(F.count("*").alias("total_pages"))
    read = chosen.join(known, "record_id", "left")
    failures = read.where("total_pages IS NULL").select("record_id", F.lit("RECORD_UNREADABLE").alias("reason"))
    found = chosen.join(by_record(matches(own, keyword)), "record_id")
    hits = found.agg(F.count("*").alias("matched"))
    stats = read.agg(F.count("*").alias("attempted_records_count"), F.count("total_pages").alias("succeeded_records_count")).join(F.broadcast(hits))  # one row to one row
    failed = F.col("attempted_records_count") - F.col("succeeded_records_count")
    return found, failures, stats.select(
        F.lit(keyword).alias("keyword"), F.when(failed > 0, "partial").otherwise("success").alias("scan_status"), "attempted_records_count", "succeeded_records_count",
        failed.alias("failed_records_count"), F.col("matched").alias("matched_records_count"),
    )


def require_some(stats: DataFrame) -> DataFrame:
    """The statistics, refused when there were records and none could be read."""
    row = stats.first()
    if row.attempted_records_count and not row.succeeded_records_count:
        raise Refused("PDF_EXTRACTION_FAILED", f"none of {row.attempted_records_count} records could be read")
    return stats
