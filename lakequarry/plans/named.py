"""Queries by the named functions of tools.py, each with its SQL; with those of queries.py they are the whole catalogue.

What the functions read is made of tables that grow with the scale, by executors: verified snapshots of laws (documents) and news (events), published in parts; a budget table (customers) as CSV; stored records (documents, a page a line) in a
page store; and a site whose pages are rendered from suppliers and line items when they are asked for. A store goes once its answer is held.
"""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.text import escape_markup, filled
from ..operators import gram_index, keyed, markup
from ..session import shared_dir, spread, table
from ..sources import delimited, page_store, pdf, results, snapshots
from ..sources.key_values import KeyValues
from . import chain, tools
from .queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

SITE = "https://site.example"
TABS = {"proposals": "gvIndex01", "temporary": "gvIndex02"}  # fixed values: the ids of the two tabs' tables
ABOUT = {"fetched_at": "2026-01-01T00:00:00Z", "validated_at": "2026-01-02T00:00:00Z", "coverage": {"scope": "all", "complete": True}, "parser_version": "1", "validator_version": "1"}


def _new_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/named-{uuid.uuid4().hex}"


def _answer(sources: tools.Sources, name: str, given: dict, *roots: str) -> tools.Envelope:
    """The function's answer, which is held; its stores are deleted."""
    try:
        return tools.call(sources, name, given)
    finally:
        sources.snapshots.clear()
        for root in roots:
            results.delete(sources.spark, root)


def _laws(spark: SparkSession, d: str, root: str) -> tools.Sources:
    """Documents with some text as laws; their lines that are not blank as articles."""
    lines = F.filter(F.split("text", "\n", -1), filled)
    articles = F.transform(lines, lambda line, i: F.struct((i + 1).cast("string").alias("article_no"), line.alias("content")))
    key = F.col("doc_id").cast("string")
    docs = table(spark, d, "documents").where(filled(F.col("text"))).select("doc_id", "source", "lang", "text")  # so that some line is an article; told before texts are taken apart
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(
        F.col("doc_id").alias("_pos"), F.concat(F.lit("L"), key).alias("law_id"), F.concat(F.lit("Law "), key, F.lit(" of "), "source").alias("law_name"), F.col("lang").alias("category"), F.lit("2026-01-01").alias("published_at"),
        F.concat(F.lit("https://law.example/a?id=L"), key).alias("official_url"), F.lit("").alias("history"), articles.alias("articles"),
    )
    snapshots.publish(rows, root, "laws", "s1", ["_pos"], ABOUT, rows_a_part=997, ordered=True)
    return tools.Sources(spark, root, law_host="law.example")


def _news(spark: SparkSession, d: str, root: str) -> tools.Sources:
    key, kind, user = F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string")
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("_pos"), F.concat(F.lit("N"), key).alias("news_id"), F.concat(kind, F.lit(" of user "), user, F.lit(".")).alias("title"), kind.alias("agency"), F.lit("c").alias("category"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.concat(F.lit("with "), "props").alias("content_summary"), F.concat(F.lit("https://news.example/n?s="), key).alias("source_link"),
    )
    snapshots.publish(rows, root, "news", "s1", ["_pos"], ABOUT, rows_a_part=9973)
    return tools.Sources(spark, root, news_host="news.example", news_path="/n")


_SP = r"[^\t\n\v\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_LAWS = f"(SELECT doc_id, 'L' || doc_id AS law_id, 'Law ' || doc_id || ' of ' || source AS law_name, lang AS category, 'https://law.example/a?id=L' || doc_id AS official_url, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SP}')) AS lines FROM documents)"
_NEWS = "(SELECT event_id, 'N' || event_id AS news_id, event_type || ' of user ' || user_id || '.' AS title, event_type AS agency, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS published_at, 'with ' || props AS content_summary FROM events)"


@query(f"""SELECT law_id, law_name, category, official_url, array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: contains(lines[i], 'able')), lambda i: i || ': ' || substring(lines[i], 1, 80) || '...'), '|') AS matched
FROM {_LAWS} WHERE len(lines) > 0 AND contains(category, 'en') AND (contains(law_name, 'able') OR len(list_filter(lines, lambda l: contains(l, 'able'))) > 0) ORDER BY doc_id LIMIT 100""")
def tool_search_laws(spark: SparkSession, d: str) -> DataFrame:
    root = _new_root(spark)
    found = _answer(_laws(spark, d, root), "search_laws", {"keyword": "able", "category": "en", "limit": 100}, root)
    return found.data.select("law_id", "law_name", "category", "official_url", F.array_join("matched_articles", "|").alias("matched"))


@query(f"SELECT law_id, law_name, category, CAST(len(lines) AS INTEGER) AS articles_count FROM {_LAWS} WHERE len(lines) > 0 AND contains(law_name, '7 of src') ORDER BY doc_id LIMIT 1")
def tool_law_detail(spark: SparkSession, d: str) -> DataFrame:
    root = _new_root(spark)
    return _answer(_laws(spark, d, root), "law_detail", {"law_name": "7 of src"}, root).data.select("law_id", "law_name", "category", "articles_count")


@query(f"SELECT doc_id AS source_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, law_id FROM {_LAWS} WHERE len(lines) > 0")
def snapshot_parts(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot in parts, read back in its source's order: the small last parts of each task's files stand before large ones."""
    root = _new_root(spark)
    sources = _laws(spark, d, root)
    found = snapshots.load_laws(spark, root, sources.law_host).records
    return found.select(F.substr("law_id", F.lit(2)).cast("long").alias("source_id"), F.col("_pos").alias("position"), "law_id")


@query(f"SELECT news_id, title, agency, published_at FROM {_NEWS} WHERE contains(agency, 'c') ORDER BY published_at DESC, event_id LIMIT 10")
def tool_latest_news(spark: SparkSession, d: str) -> DataFrame:
    root = _new_root(spark)
    return _answer(_news(spark, d, root), "latest_news", {"agency": "c"}, root).data.select("news_id", "title", "agency", "published_at")


@query(f"SELECT news_id, title, content_summary FROM {_NEWS} WHERE contains(title, 'user 7.') OR contains(content_summary, 'user 7.') ORDER BY published_at DESC, event_id LIMIT 100")
def tool_search_news(spark: SparkSession, d: str) -> DataFrame:
    root = _new_root(spark)
    return _answer(_news(spark, d, root), "search_news", {"keyword": "user 7.", "limit": 100}, root).data.select("news_id", "title", "content_summary")


@query("""SELECT count(*) AS agency_count, round(sum(c_acctbal), 2) AS agency_sum, round(sum(c_acctbal), 2) AS official_total, arg_max(c_name, row(c_acctbal, c_custkey)) AS highest_name, max(c_acctbal) AS highest_amount,
 arg_min(c_name, row(c_acctbal, c_custkey)) AS lowest_name, min(c_acctbal) AS lowest_amount, 115 AS year FROM customer""")
def tool_budget_summary(spark: SparkSession, d: str) -> DataFrame:
    """The first table is missing, so the second one answers: many files, amounts with separators of thousands, and the total among the rows."""
    root = _new_root(spark)
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("科目名稱"), F.format_number("c_acctbal", 2).alias("本年度預算數"), "c_acctbal")
    total = rows.agg(F.lit(0).cast("long").alias("c_custkey"), F.lit("合計").alias("科目名稱"), F.format_number(F.sum("c_acctbal"), 2).alias("本年度預算數"))
    both = rows.drop("c_acctbal").unionByName(total).repartitionByRange("c_custkey").sortWithinPartitions("c_custkey")
    both.drop("c_custkey").write.option("header", True).option("escape", '"').option("maxRecordsPerFile", 997).csv(f"{root}/b")
    found = _answer(tools.Sources(spark, budgets={115: [f"{root}/none.csv", f"{root}/b"]}), "budget_summary", {}, root).data
    return found.withColumns({c: F.round(c, 2) for c in ("agency_sum", "official_total")})


def _suppliers(spark: SparkSession, d: str, nation: str) -> DataFrame:
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    named = table(spark, d, "nation").join(regions, "n_regionkey").select(F.col("n_nationkey").alias("s_nationkey"), "region")
    return table(spark, d, "supplier").where(F.col("s_nationkey") == int(nation)).join(named, "s_nationkey").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), "region")


def _site(spark: SparkSession, d: str, **others) -> tools.Sources:
    """Sources whose pages show every filter that they were asked with. Lists show the suppliers of the nation that is asked for."""
    def rendered(rows: DataFrame, row: Column, before: str = "", after: str = "") -> Column:
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", row.alias("row")))), lambda r: r["row"]), "").alias("rows"), F.count("*").alias("n")).select(
            F.concat(F.lit(f"<table>{before}"), "rows", F.lit("</table>共 "), F.col("n").cast("string"), F.lit(f" 筆{after}")).alias("html")
        )

    def fetch(page: str, params: dict) -> DataFrame:
        form = "".join(f'<input name="x${tools.CONTROLS[k]}" value="{v}"/>' for k, v in params.items() if k in tools.CONTROLS)
        key = F.col("k").cast("string")
        if page == "proposals":
            row = F.concat(F.lit('<tr><td><input type="hidden" name="x$hidProposalSN" value="'), key, F.lit('"/></td><td>'), "name", F.lit('</td><td>a &amp; b</td><td>x, y，</td><td><a href="Detail.aspx?s='), key, F.lit('&amp;k=1">subject of '), "name", F.lit("</a></td><td>"), "region", F.lit("</td></tr>"))
            shown = rendered(_suppliers(spark, d, params.get("category") or params["councilor"]), row, after=" 1 / 1 頁")
        elif page == "records":
            row = F.concat(F.lit("<tr><td>"), key, F.lit("</td><td>115/01/02</td><td>Meeting of "), "name", F.lit('</td><td><a href="MeetingRecord/'), key, F.lit('/a.pdf">x</a></td></tr>'))
            shown = rendered(_suppliers(spark, d, params.get("keyword") or "7"), row)
        elif page == "attachments":
            files = table(spark, d, "lineitem").where(F.col("l_suppkey") == int(params["s"])).select(F.struct("l_orderkey", "l_linenumber").alias("k"), "l_orderkey", "l_linenumber")
            name = F.concat_ws("-", "l_orderkey", "l_linenumber")
            row = F.concat(F.lit("<tr><td>"), name, F.lit("</td><td>b &amp; c</td><td><a href='f/"), name, F.lit(".pdf'>file "), name, F.lit("</a></td><td>"), F.col("l_linenumber").cast("string"), F.lit(" KB</td></tr>"))
            shown = rendered(files, row, "<tr><td>序號</td><td>a</td><td>b</td><td>c</td></tr>")
        else:
            one = table(spark, d, "supplier").where(F.col("s_suppkey") == int(params["s"])).select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation"))
            shown = one.select(F.concat(F.lit("<title>Page of "), "name", F.lit('</title><input name="x$hidProposalSN" value="'), "k", F.lit('"/><table><tr><td>案由：</td><td>subject of '), "name", F.lit("</td><td>類別</td><td>"), "nation", F.lit("</td></tr></table><table><tr><td>二讀決議：passed</td><td>決議日期：115/09/08</td></tr></table>")).alias("html"))
        return shown.select(F.lit(0).alias("page_id"), F.lit(f"{SITE}/{tools.PAGES[page]}?{urlencode(params)}").alias("url"), F.concat(F.lit(form), "html").alias("html"))

    return tools.Sources(spark, site=SITE, fetch=fetch, **others)


_S = "(SELECT s_suppkey AS k, s_name AS name, r_name AS region, s_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_PROPOSALS = f"SELECT CAST(k AS VARCHAR) AS proposal_sn, 'Detail.aspx?s=' || k || '&k=1' AS detail_url, name AS number, 'a & b' AS category, 'x, y' AS proposer, 'subject of ' || name AS subject, region AS status, CAST(count(*) OVER () AS INTEGER) AS total_count, true AS is_complete FROM {_S} WHERE nation = "


def _shown(found: tools.Envelope) -> DataFrame:
    meta = [F.lit(found.meta[k]).alias(k) for k in ("total_count", "is_complete")]
    return found.data.select("proposal_sn", "detail_url", "number", "category", "proposer", "subject", "status", *meta)


@query(_PROPOSALS + "8")
def tool_search_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _shown(tools.call(_site(spark, d), "search_proposals", {"keyword": "road", "period": "7", "category": "8"}))


@query(_PROPOSALS + "9")
def tool_councilor_proposals(spark: SparkSession, d: str) -> DataFrame:
    return _shown(tools.call(_site(spark, d), "councilor_proposals", {"councilor": "9"}))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS proposal_sn, 'Page of ' || s_name AS meeting, 'subject of ' || s_name AS subject, CAST(s_nationkey AS VARCHAR) AS category, 'passed' AS resolution, '115/09/08' AS resolution_date, '' AS method FROM supplier WHERE s_suppkey = 7")
def tool_get_proposal(spark: SparkSession, d: str) -> DataFrame:
    found = tools.call(_site(spark, d), "get_proposal", {"proposal_sn": "7", "detail_url": "Detail.aspx?s=7&k=1"}).data
    return found.select("proposal_sn", "meeting", "subject", "category", F.col("review.second_reading_resolution").alias("resolution"), F.col("review.second_reading_date").alias("resolution_date"), "method")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS proposal_sn, CAST(s_nationkey AS VARCHAR) AS category, 'decided' AS council_review_status, 'not_stated' AS status FROM supplier WHERE s_suppkey = 7")
def tool_proposal_result(spark: SparkSession, d: str) -> DataFrame:
    return tools.call(_site(spark, d), "proposal_result", {"proposal_sn": "7"}).data.select("proposal_sn", "category", "council_review_status", "status")


@query(f"SELECT n AS no, 'b & c' AS description, 'file ' || n AS name, l_linenumber || ' KB' AS size, '{SITE}/f/' || n || '.pdf' AS download_url FROM (SELECT l_orderkey || '-' || l_linenumber AS n, l_linenumber FROM lineitem WHERE l_suppkey = 7)")
def tool_get_attachments(spark: SparkSession, d: str) -> DataFrame:
    return tools.call(_site(spark, d), "get_attachments", {"proposal_sn": "7"}).data.select("no", "description", "name", "size", "download_url")


_RECORDS = f"SELECT CAST(k AS VARCHAR) AS record_id, 'Meeting of ' || name AS meeting, '115/01/02' AS date, '{SITE}/MeetingRecord/' || k || '/a.pdf' AS pdf_url FROM {_S} WHERE nation = "


@query(_RECORDS + "11")
def tool_search_meeting_records(spark: SparkSession, d: str) -> DataFrame:
    return tools.call(_site(spark, d), "search_meeting_records", {"keyword": "11"}).data.select("record_id", "meeting", "date", "pdf_url")


@query(f"SELECT record_id AS meeting_id, 4 AS term, 2 AS session_period, meeting AS meeting_name, date AS meeting_date FROM ({_RECORDS}7) ORDER BY CAST(record_id AS BIGINT) LIMIT 10")
def tool_council_meetings(spark: SparkSession, d: str) -> DataFrame:
    return tools.call(_site(spark, d), "council_meetings", {"session_period": 2}).data.select("meeting_id", "term", "session_period", "meeting_name", "meeting_date")


def _store(spark: SparkSession, d: str, root: str) -> tools.Sources:
    """The site with every document with a text as a stored record of its lines."""
    pages = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct((i + 1).alias("page"), t.alias("text")))
    docs = table(spark, d, "documents").where("text IS NOT NULL AND doc_id >= 0").select(F.col("doc_id").cast("string").alias("record_id"), pages.alias("pages"))
    page_store.write(docs.select("record_id", F.concat(F.lit(f"{SITE}/MeetingRecord/"), "record_id", F.lit("/a.pdf")).alias("pdf_url"), F.size("pages").alias("total_pages"), "pages"), f"{root}/pages")
    return _site(spark, d, page_store=f"{root}/pages")


_LINES = "(SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)"
_HITS = "len(list_filter(lines, lambda l: contains(l, 'en')))"
_COUNT = "list_sum(list_transform(lines, lambda l: (length(l) - length(replace(l, 'en', ''))) // 2))"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST(len(lines) AS INTEGER) AS total_pages, lines[2] AS page_content, CAST({_HITS} AS BIGINT) AS matched_pages_count, CAST({_COUNT} AS BIGINT) AS match_count FROM {_LINES} WHERE doc_id = 2")
def tool_get_meeting_record(spark: SparkSession, d: str) -> DataFrame:
    root = _new_root(spark)
    found = tools.call(_store(spark, d, root), "get_meeting_record", {"record_id": "2", "keyword": "en", "page": 2}).data
    held, _ = tools.held(found.select("record_id", "total_pages", "page_content", "matched_pages_count", "match_count"))  # one row
    results.delete(spark, root)
    return held


@query(f"""WITH c AS (SELECT * FROM ({_RECORDS}7) ORDER BY CAST(record_id AS BIGINT) LIMIT 15), r AS (SELECT record_id, meeting, lines FROM c LEFT JOIN {_LINES} ON CAST(doc_id AS VARCHAR) = record_id)
SELECT record_id, meeting, CAST({_HITS} AS BIGINT) AS matched_pages_count, CAST({_COUNT} AS BIGINT) AS match_count, CAST((SELECT count(*) FROM r WHERE lines IS NULL) AS INTEGER) AS failed, CASE WHEN (SELECT count(*) FROM r WHERE lines IS NULL) > 0 THEN 'partial' ELSE 'success' END AS status FROM r WHERE {_HITS} > 0""")
def tool_search_record_contents(spark: SparkSession, d: str) -> DataFrame:
    """In the first 15 listed records; those that are not stored fail and the scan goes on."""
    root = _new_root(spark)
    found = _answer(_store(spark, d, root), "search_record_contents", {"keyword": "en", "limit_records": 15}, root)
    return found.data.select("record_id", "meeting", "matched_pages_count", "match_count", F.lit(found.meta["failed_records_count"]).cast("int").alias("failed"), F.lit(found.status).alias("status"))


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    """url and html of each order's detail page and of its list of files; one order in 97 has the page of another."""
    key = F.col("o_orderkey").cast("string")
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_custkey"))
    number = F.when(F.col("o_orderkey") % 97 == 0, F.lit("1")).otherwise(key)
    decided = F.when(F.col("o_orderstatus") == "F", F.lit("<table><tr><td>二讀決議：passed</td><td>決議日期：115/09/08</td></tr></table>")).otherwise("")
    detail = F.concat(F.lit('<input name="x$hidProposalSN" value="'), number, F.lit('"/><table><tr><td>案由：</td><td>subject '), key, F.lit(" &amp; more</td><td>類別</td><td>"), F.col("o_custkey").cast("string"), F.lit("</td></tr></table>"), decided)
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    row = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>b &amp; c</td><td><a href='f/"), name, F.lit(".pdf'>file "), name, F.lit("</a></td><td>1 KB</td></tr>"))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("r"))  # an order's few lines
    shown = F.coalesce(F.concat(F.lit("<table><tr><td>序號</td><td>a</td><td>b</td><td>c</td></tr>"), F.array_join(F.transform("r", lambda r: r["row"]), ""), F.lit("</table>")), F.lit("尚無任何資料"))
    files = orders.select("o_orderkey").join(rows, "o_orderkey", "left").select(F.concat(F.lit(f"{SITE}/{tools.PAGES['attachments']}?f=1&s="), key, F.lit("&t=False")).alias("url"), shown.alias("html"))
    return orders.select(F.concat(F.lit(f"{SITE}/{tools.PAGES['proposal']}?s="), key).alias("url"), detail.alias("html")).unionByName(files)


@query(f"""SELECT o_orderkey AS sn, CASE WHEN o_orderkey % 89 = 0 THEN 'INVALID_ARGUMENT' WHEN o_orderkey % 97 = 0 AND o_orderkey <> 1 THEN 'SOURCE_ID_MISMATCH' END AS reason_code, CASE WHEN ok THEN 'subject ' || o_orderkey || ' & more' END AS subject, CASE WHEN ok THEN CAST(o_custkey AS VARCHAR) END AS category,
 CASE WHEN ok THEN CASE WHEN o_orderstatus = 'F' THEN 'decided' ELSE 'not_stated' END END AS status, CASE WHEN ok THEN coalesce(n, 0) END AS total_files, CASE WHEN ok AND n > 0 THEN '{SITE}/f/' || o_orderkey || '-' || first || '.pdf' END AS first_file
FROM (SELECT *, o_orderkey % 89 <> 0 AND (o_orderkey % 97 <> 0 OR o_orderkey = 1) AS ok FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def proposal_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a row of a list, with its detail page and its list of files; the link of one in 89 leads elsewhere."""
    key = F.col("o_orderkey").cast("string")
    link = F.when(F.col("o_orderkey") % 89 == 0, F.concat(F.lit("https://other.example/System/Proposal/Detail.aspx?s="), key)).otherwise(F.concat(F.lit("Detail.aspx?s="), key))
    rows = table(spark, d, "orders").select("o_orderkey", key.alias("proposal_sn"), link.alias("detail_url"))
    found = chain.proposals_with_files(rows, chain.from_table(_order_pages(spark, d)), SITE)
    code = F.nullif(F.regexp_extract("reason", "^([A-Z_]+):", 1), F.lit(""))
    return found.select(F.col("o_orderkey").alias("sn"), code.alias("reason_code"), "fields.subject", "fields.category", "status", F.when(F.col("reason").isNull(), F.size("files")).cast("long").alias("total_files"), F.get("files", F.lit(0))["download_url"].alias("first_file"))


@query("""WITH t AS (SELECT s_nationkey AS page_id, CASE WHEN s_suppkey % 2 = 0 THEN 'proposals' ELSE 'temporary' END AS tab, count(*) AS n FROM supplier GROUP BY 1, 2)
SELECT page_id, tab, coalesce(n, 0) AS returned_count, CAST(coalesce(n, 0) + CASE tab WHEN 'temporary' THEN 1 ELSE 0 END AS INTEGER) AS total_count, tab = 'proposals' AS is_complete
FROM (SELECT DISTINCT s_nationkey AS page_id FROM supplier) CROSS JOIN (VALUES ('proposals'), ('temporary')) v(tab) LEFT JOIN t USING (page_id, tab)""")
def tab_completeness(spark: SparkSession, d: str) -> DataFrame:
    """A page for each nation with two tabs of suppliers, each with a total of its own; that of the second says one more than is there."""
    name = lambda t: F.when(F.col("s_suppkey") % 2 == (0 if t == "proposals" else 1), F.concat(F.lit("<tr><td>"), F.col("s_suppkey").cast("string"), F.lit('</td><td>c</td><td>x</td><td><a href="d?a=1&amp;b='), F.col("s_suppkey").cast("string"), F.lit('">y</a></td></tr>')))
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(*[F.collect_list(name(t)).alias(t) for t in TABS])
    part = lambda t, more: F.concat(F.lit(f'<table class="g" id="{TABS[t]}"><tr><th>編號</th><th>類別</th><th>提案議員</th><th>案由</th></tr>'), F.when(F.size(t) > 0, F.array_join(t, "")).otherwise("<tr><td colspan='4'>尚無任何資料</td></tr>"), F.lit("</table>共 "), (F.size(t) + more).cast("string"), F.lit(" 筆"))
    pages = rows.select("page_id", F.concat(part("proposals", 0), part("temporary", 1)).alias("html"))
    return markup.tab_completeness(pages, "page_id", "html", TABS).select("page_id", "tab", "returned_count", "total_count", "is_complete")


@query("SELECT doc_id, i AS page, CAST(len(lines) AS INTEGER) AS total_pages, sha256(lines[i]) AS text_sha256 FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), unnest(CAST(range(1, len(lines) + 1) AS INTEGER[])) u(i)")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a PDF file with a page for each line, made by Spark's functions, and its pages as they are read."""
    cmap = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    head = "%PDF-1.7\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 3 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 4 0 R >> endobj "
    head += f"4 0 obj << /Length {len(cmap)} >>\nstream\n{cmap}\nendstream endobj 2 0 obj << /Type /Pages /Resources << /Font << /F1 3 0 R >> >> /Kids ["
    shown = lambda line: F.concat(F.lit("BT /F1 9 Tf <"), F.hex(F.encode(line, "UTF-16BE")), F.lit("> Tj ET"))
    number = lambda i, k: (i * 2 + 10 + k).cast("string")
    page = lambda c, i: F.concat(number(i, 0), F.lit(" 0 obj << /Type /Page /Contents "), number(i, 1), F.lit(" 0 R >> endobj "), number(i, 1), F.lit(" 0 obj << /Length "), F.length(c).cast("string"), F.lit(" >>\nstream\n"), c, F.lit("\nendstream endobj\n"))
    lines = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.transform(F.split("text", "\n", -1), shown).alias("c"))
    kids = F.array_join(F.transform("c", lambda c, i: F.concat(number(i, 0), F.lit(" 0 R"))), " ")
    content = F.concat(F.lit(head), kids, F.lit("] >> endobj\n"), F.array_join(F.transform("c", page), ""), F.lit("trailer << /Root 1 0 R >>")).cast("binary")
    files = lines.select(F.col("doc_id").cast("string").alias("file"), content.alias("content"), F.lit(None).cast("string").alias("reason"))
    return pdf.pages_of_files(files).select(F.col("file").cast("long").alias("doc_id"), "page", "total_pages", F.sha2("text", 256).alias("text_sha256"))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS old, arg_max(event_type, event_id) FILTER (event_id % 2 = 1) AS new, user_id % 5 AS k FROM events GROUP BY user_id)
SELECT key, coalesce(new, old) AS value, CASE WHEN new IS NULL THEN 1000 + k ELSE 1060 END AS expiration FROM e WHERE (new IS NOT NULL OR 1000 + k > 1002) AND k <> 4""")
def key_value_store(spark: SparkSession, d: str) -> DataFrame:
    """A key-value table on disk: written, changed by an upsert with a time to live, some keys deleted, and purged."""
    events = table(spark, d, "events")
    rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), (1000 + F.col("user_id") % 5).cast("long").alias("expiration"), F.lit(None).cast("string").alias("metadata"), F.col("event_id").alias("_pos"))
    store = KeyValues(spark, _new_root(spark), buckets=8)
    for k, ttl in ((0, None), (1, 60)):
        store.upsert(keyed.keep_last(rows.where(F.col("_pos") % 2 == k), ["key"]).drop("_pos"), F.lit(1000), ttl, ("catalogue", k))
    store.delete(events.where("user_id % 5 = 4").select(F.col("user_id").cast("string").alias("key")).distinct())
    store.purge(F.lit(1002))
    return store.table().select("key", "value", "expiration")


@query("""SELECT doc_id, sha256(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;')) AS escaped_sha256 FROM documents WHERE text IS NOT NULL""")
def escaped_markup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(escape_markup(F.col("text")), 256).alias("escaped_sha256"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS position, c_name AS name, round(c_acctbal, 2) AS amount FROM customer")
def json_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Customers as JSON lines over several files, under other names of the two columns by turns; the first key that is such a name counts, in the files' order."""
    root = _new_root(spark)
    name, amount = F.concat(F.lit('"'), "c_name", F.lit('"')), F.format_number("c_acctbal", 2)
    first = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"科目名稱":'), name, F.lit(',"科目":"other","本年度預算數":"'))).otherwise(F.concat(F.lit('{"Seq":1,"機關名稱":'), name, F.lit(',"預算數":"')))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(first, amount, F.lit('","本年度預算":"0"}')).alias("value"))
    rows.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey").select("value").write.option("maxRecordsPerFile", 499).text(root)
    return delimited.read_json_lines(spark, root).select(F.col("_pos").alias("position"), "name", F.round("amount", 2).alias("amount"))


KEYWORDS = ("password=", "AKIA", "tion of the ", "é", "no such text")


@query(" UNION ALL ".join(f"SELECT '{k}' AS keyword, doc_id FROM documents WHERE contains(text, '{k}')" for k in KEYWORDS))
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents by keywords through the postings of their character grams."""
    root = _new_root(spark)
    gram_index.build(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", root)
    found = [gram_index.search(spark, root, "text", k).select(F.lit(k).alias("keyword"), "doc_id") for k in KEYWORDS]
    return reduce(DataFrame.unionByName, found)


# The functions that no source can answer truthfully, with arguments that are in order.
REFUSED = {"search_interpellations": {"keyword": "a"}, "get_schedule": {}, "get_councilor": {"name": "a"}, "search_temporary_proposals": {}, "search_committees": {}, "search_speeches": {"speaker": "a"}, "proposal_relations": {"proposal_sn": "1"}}


@query(f"""SELECT unnest([{", ".join(f"'{n}'" for n in REFUSED)}]) AS asked, 'FEATURE_UNAVAILABLE' AS reason_code
UNION ALL VALUES ('search_speeches without arguments', 'INVALID_ARGUMENT'), ('no such function', 'UNKNOWN_TOOL'), ('revoked laws', 'SNAPSHOT_REVOKED'), ('no snapshot', 'SNAPSHOT_UNVERIFIED'), ('changed laws', 'SNAPSHOT_UNVERIFIED'), ('a law without articles', 'SNAPSHOT_UNVERIFIED'),
 ('another proposal', 'SOURCE_ID_MISMATCH'), ('a filter that the page does not show', 'FILTER_NOT_CONFIRMED'), ('an unstored record', 'RECORD_UNREADABLE'), ('a page that is not there', 'INVALID_ARGUMENT')""")
def tool_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What each question that cannot be answered is refused with, over snapshots and stored records of all documents."""
    root, other_root, store_root = _new_root(spark), _new_root(spark), _new_root(spark)
    laws, site = _laws(spark, d, root), _site(spark, d)
    whole = snapshots.load(spark, root, "laws", snapshots.LAW)
    good, bare = whole.manifest, whole.records.withColumn("articles", F.when(F.col("_pos") > 0, F.col("articles")).otherwise(F.array()))
    snapshots.publish(bare, other_root, "laws", "s2", [], ABOUT)  # refused in any order
    denied = tools.Sources(spark, root, law_host="law.example", revoked=(good["normalized_sha256"],))
    other = tools.Sources(spark, site=SITE, fetch=lambda page, params: site.fetch(page, {"s": "1", "category": "7"}))  # noqa: ARG005 - answers without the filters
    asked = [
        *((n, site, n, given) for n, given in REFUSED.items()), ("search_speeches without arguments", site, "search_speeches", {}), ("no such function", site, "other", {}), ("revoked laws", denied, "search_laws", {"keyword": "a"}),
        ("no snapshot", tools.Sources(spark, _new_root(spark)), "search_laws", {"keyword": "a"}), ("a law without articles", tools.Sources(spark, other_root, law_host="law.example"), "search_laws", {"keyword": "a"}),
        ("another proposal", other, "get_proposal", {"proposal_sn": "2"}), ("a filter that the page does not show", other, "search_proposals", {"keyword": "road"}),
    ]
    codes = [(name, _refusal(sources, tool, given)) for name, sources, tool, given in asked]
    results.put_text(spark, f"{root}/{good['parts'][0]['key']}", "{}\n")
    codes.append(("changed laws", _refusal(laws, "search_laws", {"keyword": "a"})))
    for done in (root, other_root):  # before the records are stored, so that no disk holds both
        results.delete(spark, done)
    store = _store(spark, d, store_root)
    codes.append(("an unstored record", _refusal(store, "get_meeting_record", {"record_id": "99999999999", "pdf_url": f"{SITE}/MeetingRecord/99999999999/a.pdf"})))
    codes.append(("a page that is not there", _refusal(store, "get_meeting_record", {"record_id": "2", "page": 1000000})))
    results.delete(spark, store_root)
    return spark.createDataFrame(codes, "asked string, reason_code string")


def _refusal(sources: tools.Sources, tool: str, given: dict) -> str | None:
    try:
        tools.call(sources, tool, given)
    except Refused as e:
        return e.reason_code
    return None
