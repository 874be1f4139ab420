"""The named query functions: each checks its arguments, runs operators and answers with an Envelope; what cannot be answered truthfully is refused.

Data are DataFrames. Results of a limit (100 rows at most) are held, so that an answer and its count agree; all else stays lazy and is read by Spark.
Where web pages come from is a parameter: `fetch(page, params)` gives rows (page_id, url, html) of one of PAGES. web_fetch() makes one from the web_pages source;
a table of stored pages does as well.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from inspect import signature
from urllib.parse import parse_qsl, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import arguments as A
from ..functions import urls
from ..functions.codes import period_code
from ..operators import markup, paged, search, totals
from ..operators.completeness import completeness, require_applied
from ..sources import delimited, page_store, pdf, results, snapshots, web
from ..sources.cache import Timed, Versioned, hold

# Folders of the pages below a site, the form's controls by filter, and the code of the one term that is served.
PAGES = {"proposals": "System/Proposal/Default.aspx", "proposal": "System/Proposal/Detail.aspx", "attachments": "Common/GetAttachmentList.ashx", "records": "System/MeetingRecord/Default.aspx"}
CONTROLS = {"period": "ddlPeriod", "session": "ddlSession", "meeting": "ddlMeeting", "councilor": "ddlCouncilor", "category": "ddlCategory", "keyword": "txtKeyword"}
TERMS = {4: "07"}
# What the two search forms send besides the filters, by page; the hidden inputs of their pages that go with it; and seconds allowed for each answer.
BODY = "ctl00$ContentPlaceHolder1$"
TOKENS = ("__VIEWSTATE", "__VIEWSTATEGENERATOR", "__EVENTVALIDATION")
EVENTS = {"proposals": "LinkButton1", "records": "btnSearch"}
NESTED = {"period", "session", "meeting"}
BLANK = {"proposals": ("hidCurrentTab", "ddlCouncilor", "ddlPetitionCouncilor", "ddlCategory", "rblState", "ddlState", "txtKeyword"), "records": ("txtKeyword",)}
PRESET = {"proposals": {"ddlProposalKind": "0"}, "records": {}}
SECONDS = {"proposals": 12, "records": 10}


@dataclass(frozen=True)
class Sources:
    """What the functions read: root of verified snapshots and stored records, hosts that records may link to, budget tables by year, and the site of the web pages."""

    spark: SparkSession
    root: str = ""
    law_host: str = ""
    news_host: str = ""
    news_path: str = "/"
    site: str = ""
    budgets: Mapping[int, list[str]] = field(default_factory=dict)
    revoked: tuple[str, ...] = ()
    fetch: Callable[[str, dict], DataFrame] | None = None
    files: Callable[[DataFrame, str], DataFrame] | None = None
    page_store: str = ""
    snapshots: Versioned = field(default_factory=snapshots.new_cache)
    raw_budgets: Timed = field(default_factory=lambda: Timed(86400, lambda held: held[0].unpersist()))
    summaries: Timed = field(default_factory=lambda: Timed(3600))

    def pages(self, page: str, params: dict) -> DataFrame:
        if self.fetch is None:
            raise Refused("SOURCE_UNAVAILABLE", f"no source of the page {page} is set")
        return self.fetch(page, params)

    def url(self, page: str) -> str:
        return f"{self.site.rstrip('/')}/{PAGES[page]}"

    def root_url(self) -> str:
        """What links on pages are seen from."""
        return self.site.rstrip("/") + "/"


@dataclass(frozen=True)
class Envelope:
    """An answer with its origin. status: success, or partial where a part is missing or the data come from a fallback source."""

    data: DataFrame
    provenance: dict
    meta: dict
    status: str = ""
    provider: str = "lakequarry"
    updated_at: str = field(default_factory=lambda: _now())

    def __post_init__(self):
        if not self.status:
            object.__setattr__(self, "status", "partial" if self.provenance.get("source_type") == "fallback" else "success")

    def as_json(self) -> str:
        """The whole answer as one JSON text. For answers of a limit; write large data with results.write_json()."""
        rows = [json.loads(r.json) for r in results.json_rows(self.data).collect()]
        head = {"status": self.status, "provider": self.provider, "updated_at": self.updated_at, "provenance": self.provenance, "meta": self.meta}
        return json.dumps(head | {"data": rows}, ensure_ascii=False)


TOOLS: dict[str, Callable] = {}
TITLES: dict[str, str] = {}


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def tool(title: str):
    def put(f):
        TOOLS[f.__name__], TITLES[f.__name__] = f, title
        return f

    return put


def catalogue(spark: SparkSession) -> DataFrame:
    """name, title and arguments of every function."""
    return spark.createDataFrame([(n, TITLES[n], [p for p in signature(f).parameters if p != "sources"]) for n, f in TOOLS.items()], "name string, title string, arguments array<string>")


def call(sources: Sources, name: str, given: Mapping | None = None) -> Envelope:
    """The function of that name with the arguments given; refused when there is no such function or argument."""
    if name not in TOOLS:
        raise Refused("UNKNOWN_TOOL", name)
    try:
        bound = signature(TOOLS[name]).bind(sources, **(given or {}))
    except TypeError as e:
        raise Refused("INVALID_ARGUMENT", str(e)) from e
    return TOOLS[name](*bound.args, **bound.kwargs)


def form_options(page: str) -> dict[str, str]:
    """Options of the web_pages source for a search by the page's form: a POST with the page's own tokens and cookies, every field under its control's name."""
    named = {k: BODY + ("uscPeriodSessionMeeting$" if k in NESTED else "") + v for k, v in CONTROLS.items()}
    blank = {BODY + k: "" for k in BLANK[page]} | ({named[k]: "" for k in NESTED} if page == "proposals" else {})
    fixed = {"__EVENTTARGET": BODY + EVENTS[page], "__EVENTARGUMENT": "", "__LASTFOCUS": "", "__VIEWSTATEENCRYPTED": ""} | blank | {BODY + k: v for k, v in PRESET[page].items()}
    return {"method": "POST", "tokens": json.dumps(TOKENS), "names": json.dumps(named), "fixed": json.dumps(fixed), "timeout": str(SECONDS[page])}


def web_fetch(spark: SparkSession, site: str, timeout: int = 8) -> Callable[[str, dict], DataFrame]:
    """Pages of a site by the web_pages source: searches by a POST of the page's form, all else by GET; a page that fails is refused when it is read."""
    web.register(spark)
    host = site.split("/")[2].split(":")[0]

    def fetch(page: str, params: dict) -> DataFrame:
        url = f"{site.rstrip('/')}/{PAGES[page]}"
        options = {"url": url, "params": json.dumps([params]), "host": host, "timeout": str(timeout), "token_timeout": str(timeout)}
        options["path"] = urlsplit(url).path
        if page in EVENTS and params:  # without filters it is the form itself
            options |= form_options(page)
        found = spark.read.format("web_pages").options(**options).load()
        failed = F.raise_error(F.concat(F.lit("SOURCE_UNAVAILABLE: "), F.col("error")))
        return found.select(F.col("request").alias("page_id"), "url", F.when(F.col("error").isNull(), F.col("html")).otherwise(failed.cast("string")).alias("html"))

    return fetch


def web_files(site: str, timeout: int = 15, **options: str) -> Callable[[DataFrame, str], DataFrame]:
    """Files of a site by their URLs in a column: rows with url (after redirects), content and error, a few requests to a host at a time."""
    host = urlsplit(site).hostname or ""
    return lambda rows, column: web.fetch_each(rows, F.col(column), binary="true", host=host, timeout=str(timeout), **options)


def held(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of a limited result, read once, and their number."""
    rows = df.collect()
    return df.sparkSession.createDataFrame(rows, df.schema), len(rows)


def snapshot_provenance(manifest: dict) -> dict:
    return {
        "source_id": manifest["dataset_id"], "source_url": manifest.get("source_url"), "source_type": "verified_snapshot", "snapshot_id": manifest["snapshot_id"],
        "retrieved_at": manifest["fetched_at"], "validated_at": manifest["validated_at"], "content_hash": manifest["normalized_sha256"], "coverage": manifest["coverage"],
    }


def web_provenance(url: str) -> dict:
    """Of a page whose bytes are not hashed."""
    return {"source_id": "web", "source_url": url, "source_type": "official_web", "retrieved_at": _now(), "content_hash": "not-computed"}


def _unavailable(what: str) -> Envelope:
    raise Refused("FEATURE_UNAVAILABLE", f"no verified source has {what}")


@tool("Budget totals of a year")
def budget_summary(sources: Sources, year: int = 115) -> Envelope:
    """agency_count, agency_sum, official_total, and the highest and lowest agency with its amount."""
    if isinstance(year, bool) or not isinstance(year, int) or not 1 <= year <= 999:
        raise Refused("INVALID_ARGUMENT", "year must be a whole number from 1 to 999")
    if year not in sources.budgets:
        raise Refused("SOURCE_UNAVAILABLE", f"there is no budget of {year}")
    paths = tuple(sources.budgets[year])

    def raw() -> tuple[DataFrame, str]:
        rows, path = delimited.read_first(sources.spark, list(paths))
        return hold(rows), path

    def summary() -> Envelope:
        rows, path = sources.raw_budgets.get((year, paths), raw)
        found, _ = held(totals.checked_summary(rows).withColumn("year", F.lit(year)))  # one row
        return Envelope(found, {"source_id": str(year), "source_url": path, "source_type": "file", "retrieved_at": _now(), "content_hash": "not-computed"}, {"year": year})

    return sources.summaries.get((year, paths), summary)


@tool("Laws by keyword")
def search_laws(sources: Sources, keyword: str, category: str | None = None, limit: int | None = 10) -> Envelope:
    """Laws whose name or some article holds the keyword, with excerpts of those articles."""
    keyword, category, n = A.text(keyword, "keyword", 200, required=True), A.text(category, "category", 100), A.limit(limit)
    laws = snapshots.load_laws(sources.spark, sources.root, sources.law_host, sources.revoked, sources.snapshots)
    found = search.search_nested(laws.records, keyword, "law_name", "articles", "content", "article_no", {"category": category}, n)
    data, total = held(found.select("law_id", "law_name", "category", "published_at", "official_url", F.col("matched").alias("matched_articles")))
    return Envelope(data, snapshot_provenance(laws.manifest), {"query_keyword": keyword, "query_category": category or "all", "total_matched": total})


@tool("One law with its articles")
def law_detail(sources: Sources, law_id: str | None = None, law_name: str | None = None) -> Envelope:
    """The first law of that id, or whose name holds the text; refused when there is none."""
    law_id, law_name = A.text(law_id, "law_id", 100), A.text(law_name, "law_name", 200)
    if not law_id and not law_name:
        raise Refused("INVALID_ARGUMENT", "law_id or law_name is missing")
    laws = snapshots.load_laws(sources.spark, sources.root, sources.law_host, sources.revoked, sources.snapshots)
    data, n = held(search.first_match(laws.records, "law_id", law_id, "law_name", law_name).drop("_pos").withColumn("articles_count", F.size("articles")))
    if not n:
        raise Refused("NOT_FOUND", f"no law is {law_id or law_name}")
    return Envelope(data, snapshot_provenance(laws.manifest), {"query_id": law_id, "query_name": law_name})


def _positive(value, name: str) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not str(value).strip().isdigit() or int(value) < 1:
        raise Refused("INVALID_ARGUMENT", f"{name} must be a positive whole number")
    return int(value)


@tool("Meetings of the council")
def council_meetings(sources: Sources, term: int = 4, session_period: int | None = None, limit: int | None = 10) -> Envelope:
    """T4: meeting records of a term under a meeting's names."""
    term, number, n = _positive(term, "term"), _positive(session_period, "session_period"), A.limit(limit)
    if term not in TERMS:
        raise Refused("INVALID_ARGUMENT", f"term {term} is not served")
    session = f"{TERMS[term]}{number:02d}" if number else ""
    found = search_meeting_records(sources, period=TERMS[term], session=session)
    rows = search.first(found.data, n).select(
        F.col("record_id").alias("meeting_id"), F.lit(term).alias("term"), F.lit(number).cast("int").alias("session_period"), F.col("meeting").alias("meeting_name"), F.col("date").alias("meeting_date"), "record_type", "pdf_url"
    )
    data, total = held(rows)
    return Envelope(data, found.provenance, {"term": term, "period": TERMS[term], "session": session or "all", "total": total, "official_total": found.meta["total"]})


@tool("Interpellations by keyword")
def search_interpellations(sources: Sources, keyword: str, legislator_name: str | None = None, limit: int | None = 10) -> Envelope:  # noqa: ARG001
    """T5: always refused, as no source ties a keyword to a speaker."""
    A.text(keyword, "keyword", 200, required=True)
    A.text(legislator_name, "legislator_name", 100)
    A.limit(limit, most=50)
    return _unavailable("speeches by speaker")


@tool("Latest news")
def latest_news(sources: Sources, agency: str | None = None, category: str | None = None, limit: int | None = 10) -> Envelope:
    """The newest news whose agency and category hold the texts."""
    agency, category, n = A.text(agency, "agency", 100), A.text(category, "category", 100), A.limit(limit)
    news = snapshots.load_news(sources.spark, sources.root, sources.news_host, sources.news_path, sources.revoked, sources.snapshots)
    data, total = held(search.latest(news.records, "published_ts", {"agency": agency, "category": category}, n).drop("_pos", "published_ts"))
    return Envelope(data, snapshot_provenance(news.manifest), {"agency_filter": agency or "all", "category_filter": category or "all", "total": total})


@tool("News by keyword")
def search_news(sources: Sources, keyword: str, limit: int | None = 10) -> Envelope:
    """The newest news whose title or summary holds the keyword."""
    keyword, n = A.text(keyword, "keyword", 200, required=True), A.limit(limit)
    news = snapshots.load_news(sources.spark, sources.root, sources.news_host, sources.news_path, sources.revoked, sources.snapshots)
    found = search.search_flat(news.records, keyword, ["title", "content_summary"], (F.desc_nulls_last("published_ts"),), n)
    data, total = held(found.drop("_pos", "published_ts"))
    return Envelope(data, snapshot_provenance(news.manifest), {"query_keyword": keyword, "total_matched": total})


def _period(sources: Sources, period: str | None) -> str:
    return A.code(sources.spark.range(1).select(period_code(F.lit(A.text(period, "period")))).first()[0], "period")


def _asked(pages: DataFrame, requested: dict[str, str]) -> dict[str, str]:
    """The filters, once the answer's own form shows each of them. One small row is read."""
    shown = pages.select(*[markup.control_value(F.col("html"), CONTROLS[k]).alias(k) for k in requested]).first()
    return require_applied(requested, shown.asDict() if shown else {})


@tool("Proposals by filters")
def search_proposals(
    sources: Sources, keyword: str | None = None, period: str | None = None, session: str | None = None, meeting: str | None = None, meeting_number: int | None = None, category: str | None = None, councilor: str | None = None
) -> Envelope:
    """The proposals that the source's answer shows, once it confirms every filter; meta has what is known of completeness."""
    asked = {
        "period": _period(sources, period), "session": A.code(session, "session"), "meeting": A.code(meeting, "meeting"), "councilor": A.text(councilor, "councilor", 100),
        "category": A.text(category, "category", 50), "keyword": A.text(keyword, "keyword", 200),
    }
    if not asked["meeting"] and meeting_number is not None:
        form = sources.pages("proposals", {}).select(markup.meeting_code(markup.options(F.col("html"), CONTROLS["meeting"]), asked["session"], meeting_number).alias("m")).first()
        if form is None or not form.m:
            raise Refused("NOT_FOUND", f"session {asked['session']} has no meeting {meeting_number}")
        asked["meeting"] = form.m
    pages = sources.pages("proposals", {k: v for k, v in asked.items() if v})
    applied = _asked(pages, asked)
    data, n = held(markup.proposals(pages, "page_id").orderBy("page_id", "_pos").drop("page_id"))  # of one page
    counts = completeness(pages.select(F.lit(n).alias("returned_count"), markup.pager(F.col("html")).alias("p")).select("returned_count", "p.tab_counts", "p.page", "p.pages")).first()
    meta = {"returned_count": n, "total_count": counts.total_count, "is_complete": counts.is_complete, "current_page": counts.page, "page_count": counts.pages, "notice": counts.notice, "tab_counts": counts.tab_counts, "applied_filters": applied}
    return Envelope(data, web_provenance(sources.url("proposals")), meta)


# The labels of a detail page and the column of each.
DETAIL = {"會議": "meeting_label", "提案類型": "proposal_type", "類別": "category", "編號": "number", "提案單位": "proposing_unit", "承辦單位": "handling_unit", "相關單位": "related_units", "連署人": "co_signers", "案由": "subject", "說明": "explanation", "辦法": "method", "備註": "remarks", "狀態": "official_status"}


def _is_page(sources: Sources, url: str, page: str) -> bool:
    """True for an https URL of the site's page."""
    own, wanted = urlsplit(url), urlsplit(sources.url(page))
    return own.scheme == "https" and own.hostname == wanted.hostname and own.path == wanted.path


def _detail_url(sources: Sources, url: str) -> str:
    """The URL of a proposal's page, a relative one from its folder on; refused unless it is that page of the site."""
    if not url.startswith("http"):
        url = f"{sources.url('proposal').rpartition('/')[0]}/{url.lstrip('/')}"
    if not _is_page(sources, url, "proposal"):
        raise Refused("INVALID_ARGUMENT", "detail_url is no proposal's page of the site")
    return url


@tool("One proposal")
def get_proposal(sources: Sources, proposal_sn: str, detail_url: str | None = None) -> Envelope:
    """A proposal's page, by labels and review fields; refused when the page is another proposal's. detail_url, as a list shows it, is the page that is read."""
    sn = A.code(proposal_sn, "proposal_sn", required=True)
    url = _detail_url(sources, A.text(detail_url, "detail_url", 500) or f"Detail.aspx?s={sn}")
    pages = sources.pages("proposal", dict(parse_qsl(urlsplit(url).query, keep_blank_values=True)))
    own = pages.select(markup.page_number(F.col("html")).alias("n"), "url").first()
    if own is not None and own.url and not _is_page(sources, own.url, "proposal"):
        raise Refused("PARSER_CONTRACT_CHANGED", f"the answer is another page, {own.url}")
    if own is None or own.n != sn:
        raise Refused("SOURCE_ID_MISMATCH", f"asked for {sn}, the page is of {own.n if own and own.n else 'unknown'}")
    rows = markup.table_rows(pages, "page_id", "html")
    labels = markup.label_values(rows, "page_id").groupBy("page_id").pivot("label", list(DETAIL)).agg(F.first("value"))
    named = labels.select("page_id", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(v) for k, v in DETAIL.items()])
    review = markup.reviews(rows, "page_id").select("page_id", F.struct(*markup.REVIEW_FIELDS).alias("review"))
    title = F.coalesce(F.nullif(markup.meeting_title(F.col("html")), F.lit("")), F.col("meeting_label"), F.lit("")).alias("meeting")
    joined = pages.select("page_id", "html").join(named, "page_id", "left").join(review, "page_id", "left")
    data, _ = held(joined.select(F.lit(sn).alias("proposal_sn"), F.lit(url).alias("detail_url"), title, *[v for v in DETAIL.values() if v != "meeting_label"], "review"))
    return Envelope(data, web_provenance(url), {"proposal_sn": sn})


@tool("Attachments of a proposal")
def get_attachments(sources: Sources, proposal_sn: str) -> Envelope:
    """The files that a proposal's list shows; none where it says so."""
    sn = A.code(proposal_sn, "proposal_sn", required=True)
    pages = sources.pages("attachments", {"f": "1", "s": sn, "t": "False"})
    own = pages.select("url").first()
    if own is None or not _is_page(sources, own.url or "", "attachments") or dict(parse_qsl(urlsplit(own.url).query)).get("s") != sn:
        raise Refused("SOURCE_ID_MISMATCH", f"asked for the files of {sn}, the answer is {own.url if own else 'empty'}")
    data, n = held(markup.attachments(pages, "page_id", "html", sources.root_url()).orderBy("page_id", "_pos").drop("page_id"))
    return Envelope(data, web_provenance(own.url), {"proposal_sn": sn, "total_files": n})


@tool("Meeting records by filters")
def search_meeting_records(sources: Sources, keyword: str | None = None, period: str | None = "07", session: str | None = None, meeting: str | None = None) -> Envelope:
    """Rows that link to a record, once the answer confirms every filter."""
    asked = {"period": A.code(period or "07", "period"), "session": A.code(session, "session"), "meeting": A.code(meeting, "meeting"), "keyword": A.text(keyword, "keyword", 200)}
    pages = sources.pages("records", {k: v for k, v in asked.items() if v})
    applied = _asked(pages, asked)
    data, n = held(markup.meeting_records(pages, "page_id", "html", sources.root_url()).orderBy("page_id", "_pos").drop("page_id"))  # of one page
    total = pages.select(markup.pager(F.col("html"))["total"]).first()[0]
    return Envelope(data, web_provenance(sources.url("records")), {"returned_count": n, "total": total, "is_complete": None if total is None else n >= total, "applied_filters": applied})


@tool("Schedule")
def get_schedule(sources: Sources, period: str | None = None, session: str | None = None) -> Envelope:  # noqa: ARG001
    """Always refused."""
    return _unavailable("schedules")


@tool("One councilor")
def get_councilor(sources: Sources, name: str) -> Envelope:  # noqa: ARG001
    """Refused once the name is checked."""
    A.text(name, "name", 50, required=True)
    return _unavailable("councilors")


@tool("Proposals of a councilor")
def councilor_proposals(sources: Sources, councilor: str, period: str = "07", session: str = "0704", meeting: str | None = None) -> Envelope:
    """search_proposals of one councilor; meta names period and session."""
    found = search_proposals(sources, councilor=A.text(councilor, "councilor", 100, required=True), period=period, session=session, meeting=meeting)
    return Envelope(found.data, found.provenance, found.meta | {"period": period, "session": session})


@tool("Result of a proposal")
def proposal_result(sources: Sources, proposal_sn: str, detail_url: str | None = None) -> Envelope:
    """A proposal's status as its review fields tell it: decided, in_review or not_stated; executive_status is never known."""
    found = get_proposal(sources, proposal_sn, detail_url)
    r = [F.col(f"review.{f}") for f in ("third_reading_session", "third_reading_date", "second_reading_resolution", "second_reading_date", "committee_opinion", "first_reading")]
    official = F.nullif(F.col("official_status"), F.lit(""))
    data = found.data.select(
        "proposal_sn", "number", "category", "subject", "review", official.alias("official_status"), markup.review_status(*r).alias("council_review_status"), F.lit(None).cast("string").alias("executive_status"),
        F.coalesce(official, F.lit("not_stated")).alias("status"), "detail_url",
    )
    return Envelope(data, found.provenance, found.meta)


@tool("Temporary proposals")
def search_temporary_proposals(sources: Sources, keyword: str | None = None, period: str | None = None, session: str | None = None) -> Envelope:  # noqa: ARG001
    """Always refused."""
    return _unavailable("temporary proposals")


@tool("Committees")
def search_committees(sources: Sources, committee_name: str | None = None) -> Envelope:  # noqa: ARG001
    """Always refused."""
    return _unavailable("committees")


@tool("Speeches")
def search_speeches(sources: Sources, keyword: str | None = None, speaker: str | None = None) -> Envelope:  # noqa: ARG001
    """Refused once one of the two is there."""
    if not A.text(keyword, "keyword", 200) and not A.text(speaker, "speaker", 100):
        raise Refused("INVALID_ARGUMENT", "keyword or speaker is missing")
    return _unavailable("speeches by speaker")


@tool("Relations of a proposal")
def proposal_relations(sources: Sources, proposal_sn: str) -> Envelope:  # noqa: ARG001
    """Refused once the number is checked."""
    A.code(proposal_sn, "proposal_sn", required=True)
    return _unavailable("relations of proposals")


def _record_url(sources: Sources, record_id: str, pdf_url: str | None) -> str:
    """The record's file: the URL given, or the listed one of that id; refused unless it is the site's and the record's own."""
    if not pdf_url:
        listed = search.first_match(search_meeting_records(sources).data, "record_id", record_id, "record_id", None).select("pdf_url").first()
        if listed is None:
            raise Refused("NOT_FOUND", f"no listed record is {record_id}")
        pdf_url = listed.pdf_url
    host, url = urlsplit(sources.site).hostname or "", F.lit(pdf_url)
    own = sources.spark.range(1).select(urls.on_host(url, host).alias("official"), urls.record_id(url, host).alias("id")).first()
    if not own.official:
        raise Refused("INVALID_ARGUMENT", "pdf_url is no URL of the site")
    if own.id != record_id:
        raise Refused("SOURCE_ID_MISMATCH", f"pdf_url is not of record {record_id}")
    return pdf_url


def _stored_records(sources: Sources, ids: list[str]) -> DataFrame:
    """The stored ones of a few records: of the page store where one is set, else of the store of objects."""
    if sources.page_store:
        return page_store.read(sources.spark, sources.page_store, ids)
    return snapshots.load_records(sources.spark, sources.root, ids)


def _records_of_files(sources: Sources, wanted: DataFrame) -> DataFrame:
    """record_id, pdf_url, total_pages, pages (null where there is a reason) and reason of records (record_id, pdf_url) whose files are read now: by executors, a few at a time, and not stored."""
    host = urlsplit(sources.site).hostname or ""
    came = sources.files(wanted.select("record_id", "pdf_url"), "pdf_url")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(urls.record_id(F.col("url"), host) != F.col("record_id"), F.concat(F.lit("SOURCE_ID_MISMATCH: the file came from "), "url"))
    read = pdf.pages_of_files(came.select(F.col("record_id").alias("file"), F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason")))
    pages = F.when(F.first("reason").isNull(), F.array_sort(F.collect_list(F.struct("page", "text"))))  # of one file
    return wanted.select("record_id", "pdf_url").join(read.groupBy(F.col("file").alias("record_id")).agg(F.first("total_pages").alias("total_pages"), pages.alias("pages"), F.first("reason").alias("reason")), "record_id")


@tool("Text of a meeting record")
def get_meeting_record(sources: Sources, record_id: str, pdf_url: str | None = None, keyword: str | None = None, page: int | None = None) -> Envelope:
    """One record: its matches by page, and the text of a page. A record that is not stored as text is read from its file, by pdf_url or the list's link; nothing is stored. Without a source of files it is refused with the URL of its file."""
    record_id, pdf_url, keyword = A.code(record_id, "record_id", required=True), A.text(pdf_url, "pdf_url", 500), A.text(keyword, "keyword", 200)
    record = _stored_records(sources, [record_id]) if sources.page_store else snapshots.load_record(sources.spark, sources.root, record_id)
    stored = record is not None and not record.isEmpty()
    if not stored:
        link = _record_url(sources, record_id, pdf_url)
        if sources.files is None:
            raise Refused("RECORD_UNREADABLE", f"record {record_id} is not stored as text; its file is {link}")
        record = hold(_records_of_files(sources, sources.spark.range(1).select(F.lit(record_id).alias("record_id"), F.lit(link).alias("pdf_url"))))
        reason = record.select("reason").first()[0]
        if reason:
            raise Refused("SOURCE_ID_MISMATCH" if reason.startswith("SOURCE_ID_MISMATCH") else "PDF_EXTRACTION_FAILED", f"record {record_id}: {reason}")
    page = A.page(page, record.select("total_pages").first()[0])
    content = F.get(F.col("pages"), F.lit(page - 1))["text"] if page else F.lit(None).cast("string")
    head = record.select("record_id", "pdf_url", "total_pages", content.alias("page_content"))
    if not keyword:
        return Envelope(head, web_provenance(record.select("pdf_url").first()[0]), {"keyword": None, "from_cache": stored})
    found = paged.by_record(paged.matches(paged.pages_of(record), keyword))
    data = head.join(found, "record_id", "left").withColumn("matched_pages_count", F.coalesce("matched_pages_count", F.lit(0)))
    return Envelope(data, web_provenance(record.select("pdf_url").first()[0]), {"keyword": keyword, "from_cache": stored})


@tool("Keyword in meeting records")
def search_record_contents(sources: Sources, keyword: str, limit_records: int | None = 8, period: str | None = "07", session: str | None = None) -> Envelope:
    """The matches in the first limit_records records; partial when some cannot be read, refused when none can. meta has the statistics and failures."""
    keyword, n = A.text(keyword, "keyword", 200, required=True), A.limit(limit_records, 8, 15)
    listed = search_meeting_records(sources, period=period, session=session)
    index, _ = held(search.first(listed.data, n).select("_pos", "record_id", "meeting", "date", "pdf_url"))
    stored = _stored_records(sources, [r.record_id for r in index.select("record_id").collect()])  # 15 ids at most
    pages, reasons = paged.pages_of(stored), {}
    if sources.files is not None:
        read = hold(_records_of_files(sources, index.join(stored.select("record_id"), "record_id", "left_anti")))
        reasons = {r.record_id: r.reason for r in read.where("reason IS NOT NULL").select("record_id", "reason").collect()}  # 15 at most
        pages = pages.unionByName(paged.pages_of(read.where("reason IS NULL")))
    pages = hold(pages)  # read once for matches, failures and statistics
    found, failures, stats = paged.scan(index, pages, keyword, n)
    row = paged.require_some(stats).first()
    found, _ = held(found)  # a row for each of the records
    failed = [f.asDict() | ({"reason": reasons[f.record_id]} if f.record_id in reasons else {}) for f in failures.collect()]
    meta = row.asDict() | {"failures": failed, "reason_code": "PARTIAL_SCAN" if row.failed_records_count else None}
    pages.unpersist()
    return Envelope(found, listed.provenance, meta, "partial" if row.failed_records_count else "success")
