"""A named function over a table of arguments: each row of a list drives its detail page and its list of files, all of them in one job, and what fails is a row with a reason.

Pages are fetched by the executors, a few at a time from a host, or joined from a table of stored pages. Each page is taken apart within its row: no page is grouped with another, so nothing is shuffled but rows on their way to the tasks that fetch.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls
from ..operators import markup
from ..sources import web
from .tools import DETAIL, PAGES

#: Rows and a column of URLs give rows with url (after redirects), html and error.
Fetch = Callable[[DataFrame, Column], DataFrame]
ANSWER = ("url", "status", "html", "error", "content")


def from_site(site: str, timeout: int = 8) -> Fetch:
    """Pages of a site, fetched when they are read."""
    host = urlsplit(site).hostname or ""
    return lambda rows, url: web.fetch_each(rows, url, host=host, timeout=str(timeout))


def from_table(pages: DataFrame) -> Fetch:
    """Stored pages (url, html), found by a join on their URL; one that is not there is an error.

    Both sides are dealt to a number of tasks that is kept: what follows costs far more a row than its bytes say, by which adaptive execution would put tasks together.
    """
    spark = pages.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def fetch(rows: DataFrame, url: Column) -> DataFrame:
        stored = pages.select(F.col("url").alias("_asked"), "html", F.lit(True).alias("_there")).repartition(tasks, "_asked")
        asked = F.coalesce(url, F.concat(F.lit("none:"), F.xxhash64(*rows.columns).cast("string")))  # rows without a URL are not one key
        found = rows.withColumn("_asked", asked).repartition(tasks, "_asked").join(stored, "_asked", "left")
        own = F.when(~F.startswith("_asked", F.lit("none:")), F.col("_asked"))
        return found.withColumn("url", own).withColumn("error", F.when(F.col("_there").isNull(), "SOURCE_UNAVAILABLE: no such page")).drop("_asked", "_there")

    return fetch


def detail_fields(html: Column) -> Column:
    """Struct of a detail page's fields by label, and of its review, within the page's row; of a label's values the last counts."""
    rows = F.transform(F.flatten(F.transform(markup.all_of(html, markup.TABLE, 1), lambda t: markup.all_of(t, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1))), lambda r: markup.cells_of(r, X.text_of_escaped_markup, markup.CELL))

    def fields(rows: Column) -> Column:
        pairs = F.flatten(F.transform(rows, lambda cells: F.transform(F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0))), lambda c, i: F.struct(X.label_of(c).alias("label"), F.get(cells, i + 1).alias("value")))))
        last = lambda found, label: X.or_empty(F.try_element_at(F.filter(found, lambda p: p["label"] == label), F.lit(-1))["value"])
        named = X.let(F.filter(pairs, lambda p: p["label"].isin(*DETAIL)), lambda found: F.struct(*[last(found, label).alias(name) for label, name in DETAIL.items()]))
        joined = F.transform(rows, lambda cells: F.trim(F.array_join(cells, " ")))

        def review(lines: Column) -> Column:
            value = lambda how: X.or_empty(X.let(F.try_element_at(F.filter(lines, lambda x: F.contains(x, F.lit(how[0]))), F.lit(-1)), lambda line: markup.review_field(line, *how)))
            return F.struct(*[value(how).alias(name) for name, how in markup.REVIEW_FIELDS.items()])

        return F.struct(named.alias("fields"), X.let(joined, review).alias("review"))

    return X.let(rows, fields)


def listed_files(html: Column, base: str) -> Column:
    """Array of (no, description, name, size, download_url) that a list of files shows; null where it neither shows any nor says that there are none."""
    empty = F.lit(False)
    for marker in markup.NO_ATTACHMENTS:
        empty = empty | F.contains(html, F.lit(marker))

    def file(row: Column) -> Column:
        link = markup.first_of(F.array_join(markup.all_of(row, markup.DATA_CELL, 1), " "), r"(?i)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>", 1)
        made = lambda c: F.struct(*[F.get(c, F.lit(k)).alias(n) for k, n in enumerate(("no", "description", "name", "size"))], X.let(link, lambda to: F.when(to != "", urls.absolute(to, base))).alias("download_url"), F.size(c).alias("cells"))
        return X.let(markup.cells_of(row, X.text_of_cell), made)

    rows = F.filter(F.transform(markup.all_of(html, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1), file), lambda f: (f["cells"] >= 4) & (f["no"] != "序號"))
    bare = F.transform(rows, lambda f: F.struct(*[f[n].alias(n) for n in ("no", "description", "name", "size", "download_url")]))
    return X.let(bare, lambda found: F.when(empty, F.slice(found, 1, 0)).when(F.size(found) > 0, found))


def proposals_with_files(rows: DataFrame, fetch: Fetch, site: str) -> DataFrame:
    """rows (proposal_sn, detail_url, and others that are kept) with fields, review, status, files and reason.

    reason is null where all went well; else it says what the first failure was, and what could be read before it is there. A detail_url must be the site's own page; the page must be of that proposal; files' links must lead to the site.
    """
    root, host = site.rstrip("/") + "/", urlsplit(site).hostname or ""
    kept = [c for c in rows.columns if c not in ANSWER and c not in ("fields", "review", "status", "files", "reason")]
    link = urls.absolute(F.coalesce(F.nullif("detail_url", F.lit("")), F.concat(F.lit("Detail.aspx?s="), "proposal_sn")), root + PAGES["proposal"])
    official = lambda u, page: urls.on_host(u, host) & F.coalesce(urls.part(u, "PATH") == "/" + PAGES[page], F.lit(False))
    wanted = rows.select(*kept, link.alias("_link"))
    detail = fetch(wanted, F.when(official(F.col("_link"), "proposal"), F.col("_link"))).select(*kept, "_link", "url", "html", "error", markup.page_number(F.col("html")).alias("_number"))
    number = F.col("_number")
    reason = F.when(~official(F.col("_link"), "proposal"), F.concat(F.lit("INVALID_ARGUMENT: "), F.coalesce("_link", F.lit("no URL")))).when(F.col("error").isNotNull(), F.col("error")).when(~official(F.col("url"), "proposal"), F.concat(F.lit("PARSER_CONTRACT_CHANGED: "), "url"))
    reason = reason.when(number != F.col("proposal_sn"), F.concat(F.lit("SOURCE_ID_MISMATCH: the page is of "), number))
    # what is used more than once is a column first, so that it is worked out once a row
    read = detail.withColumn("reason", reason).select(*kept, "reason", F.when(F.col("reason").isNull(), detail_fields(F.col("html"))).alias("d"))
    asked = F.concat(F.lit(f"{root}{PAGES['attachments']}?f=1&s="), "proposal_sn", F.lit("&t=False"))
    listed = fetch(read, F.when(F.col("reason").isNull(), asked)).select(*kept, "reason", "d", "url", "error", F.when(F.col("reason").isNull() & F.col("error").isNull(), listed_files(F.col("html"), root)).alias("files"))
    own = official(F.col("url"), "attachments") & F.coalesce(urls.part(F.col("url"), "QUERY", "s") == F.col("proposal_sn"), F.lit(False))
    foreign = F.exists("files", lambda f: f["download_url"].isNotNull() & ~urls.on_host(f["download_url"], host))
    why = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("error").isNotNull(), F.col("error")).when(~own, F.concat(F.lit("SOURCE_ID_MISMATCH: the files' list is "), "url"))
    why = why.when(F.col("files").isNull(), "PARSER_CONTRACT_CHANGED: no files and no word of it").when(foreign, "PARSER_CONTRACT_CHANGED: a file of another host")
    r = [F.col(f"d.review.{f}") for f in ("third_reading_session", "third_reading_date", "second_reading_resolution", "second_reading_date", "committee_opinion", "first_reading")]
    status = F.when(F.col("d").isNotNull(), markup.review_status(*r))
    listed, why = listed.withColumn("_why", why), F.col("_why")
    return listed.select(*kept, "d.fields", "d.review", status.alias("status"), F.when(why.isNull(), F.col("files")).alias("files"), why.alias("reason"))
