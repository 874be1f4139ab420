"""The named functions over a store of snapshots, stored records and given pages."""

import dataclasses
import hashlib
import json
from urllib.parse import urlencode

import pytest
from pyspark.sql import functions as F

from lakequarry.errors import Refused
from lakequarry.plans import tools as T
from lakequarry.sources.cache import Timed

from .test_pdf import made, stream, tree

SITE = "https://site.example"
FORM = '<select name="x$ddlPeriod"><option value="06">6</option><option selected="selected" value="07">7</option></select><select name="x$ddlMeeting"><option value="">-</option><option value="07040800">第 8 次</option></select><input name="x$txtKeyword" value="道路"/>'
LIST = FORM + '<table><tr><td><input type="hidden" name="a$hidProposalSN" value="145"/>1</td><td>A1</td><td>民政</td><td>甲，</td><td>修路</td><td>通過</td></tr></table>共 4 筆 1 / 2 頁'
DETAIL = '<input name="hidProposalSN" value="145"/><table><tr><td>案由</td><td>修路</td><td>類別</td><td>民政</td></tr></table><table><tr><td>二讀決議：照案通過</td><td>決議日期：115/09/08</td></tr></table>'
RECORDS = FORM.replace("道路", "") + "".join(f'<table><tr><td>{k}</td><td>115/01/0{k}</td><td>第{k}次</td><td><a href="/MeetingRecord/{k}/a.pdf">x</a></td></tr></table>' for k in (1, 2))
HTML = {"proposals": LIST, "proposal": DETAIL, "attachments": "總大小 0 bytes", "records": RECORDS}


def plain_pdf(texts):
    pages = {10 + 2 * n: b"<< /Type /Page /Contents %d 0 R >>" % (11 + 2 * n) for n in range(len(texts))}
    return made(tree(len(texts)) | pages | {11 + 2 * n: stream(b"BT /F1 9 Tf (%s) Tj ET" % t) for n, t in enumerate(texts)})


def put(root, key, value):
    (root / key).parent.mkdir(parents=True, exist_ok=True)
    (root / key).write_text(value, encoding="utf-8")


def publish(root, dataset, records):
    data, folder = json.dumps(records, ensure_ascii=False), f"verified/{dataset}/s1"
    manifest = json.dumps({
        "schema_version": "2.0", "dataset_id": dataset, "snapshot_id": "s1", "normalized_key": f"{folder}/normalized.json", "normalized_sha256": hashlib.sha256(data.encode()).hexdigest(), "fetched_at": "2026-01-01T00:00:00Z",
        "validated_at": "2026-01-02T00:00:00Z", "validation_status": "passed", "revoked": False, "record_count": len(records), "coverage": {"scope": "all", "complete": True}, "parser_version": "1", "validator_version": "1",
    })
    put(root, f"{folder}/normalized.json", data)
    put(root, f"{folder}/manifest.json", manifest)
    put(root, f"releases/{dataset}/active.json", json.dumps({"manifest_key": f"{folder}/manifest.json", "manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest()}))


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    law = lambda k, name, *texts: {"law_id": f"L{k}", "law_name": name, "category": "交通", "published_at": "2026-01-01", "official_url": f"https://law.example/a?id=L{k}", "history": "", "articles": [{"article_no": str(n), "content": t} for n, t in enumerate(texts, 1)]}
    publish(root, "laws", [law(1, "停車辦法", "騎樓不得停車", "其他"), law(2, "騎樓辦法", "通行")])
    item = lambda k, day, title: {"news_id": f"N{k}", "title": title, "agency": "局", "category": "c", "published_at": f"2026-01-0{day}T00:00:00Z", "content_summary": "s", "source_link": f"https://news.example/n?s={k}"}
    publish(root, "news", [item(1, 2, "舊"), item(2, 3, "新")])
    pages = [{"page": 1, "text": "無"}, {"page": 2, "text": "道路與道路"}]
    put(root, "meeting_records/1.json", json.dumps({"record_id": "1", "pdf_url": f"{SITE}/1.pdf", "total_pages": 2, "pages": pages, "cached_at": "x"}))
    put(root, "b.csv", '科目名稱,本年度預算數\n合計,"3,000"\n甲,"1,000"\n乙,"2,500"\n')
    fetch = lambda page, params: spark.createDataFrame([(0, f"{SITE}/{T.PAGES[page]}?{urlencode(params)}", HTML[page])], "page_id int, url string, html string")
    return T.Sources(spark, str(root), "law.example", "news.example", "/n", SITE, {115: [str(root / "none.csv"), str(root / "b.csv")]}, fetch=fetch)


def refused(code, sources, tool, **given):
    with pytest.raises(Refused) as e:
        T.call(sources, tool, given)
    assert e.value.reason_code == code


def test_snapshot_functions(sources):
    found = T.call(sources, "search_laws", {"keyword": "騎樓", "category": "交通"})
    assert [(r.law_id, r.matched_articles) for r in found.data.collect()] == [("L1", ["1: 騎樓不得停車..."]), ("L2", [])]
    assert (found.status, found.meta["total_matched"], found.provenance["snapshot_id"]) == ("success", 2, "s1")
    assert T.call(sources, "search_laws", {"keyword": "騎樓", "limit": 1}).data.count() == 1
    assert T.call(sources, "law_detail", {"law_name": "騎樓"}).data.first().articles_count == 1
    assert [r.news_id for r in T.call(sources, "latest_news").data.collect()] == ["N2", "N1"]
    assert [r.news_id for r in T.call(sources, "search_news", {"keyword": "舊"}).data.collect()] == ["N1"]
    refused("NOT_FOUND", sources, "law_detail", law_id="L9")
    refused("INVALID_ARGUMENT", sources, "search_laws", keyword=" ")
    refused("INVALID_ARGUMENT", sources, "search_laws", keyword="a", limit=0)
    refused("SNAPSHOT_UNVERIFIED", T.Sources(sources.spark, sources.root + "/none"), "search_laws", keyword="a")


def test_budget(sources):
    r = T.call(sources, "budget_summary").data.first()
    assert (r.agency_count, r.agency_sum, r.official_total, r.highest_name, r.lowest_name) == (2, 3500.0, 3000.0, "乙", "甲")
    refused("SOURCE_UNAVAILABLE", sources, "budget_summary", year=99)
    refused("INVALID_ARGUMENT", sources, "budget_summary", year=0)


def test_proposals(sources):
    found = T.call(sources, "search_proposals", {"keyword": "道路", "period": "7"})
    r = found.data.first()
    assert (r.proposal_sn, r.number, r.category, r.proposer, r.subject, r.status) == ("145", "A1", "民政", "甲", "修路", "通過")
    assert (found.meta["returned_count"], found.meta["total_count"], found.meta["is_complete"], found.meta["page_count"]) == (1, 4, False, 2)
    assert found.meta["applied_filters"] == {"period": "07", "keyword": "道路"}
    refused("FILTER_NOT_CONFIRMED", sources, "search_proposals", keyword="別的")
    refused("FILTER_NOT_CONFIRMED", sources, "councilor_proposals", councilor="甲")
    refused("INVALID_ARGUMENT", sources, "search_proposals", session="74")
    one = T.call(sources, "get_proposal", {"proposal_sn": "145"}).data.first()
    assert (one.subject, one.category, one.review.second_reading_resolution, one.review.second_reading_date) == ("修路", "民政", "照案通過", "115/09/08")
    r = T.call(sources, "proposal_result", {"proposal_sn": "145"}).data.first()
    assert (r.council_review_status, r.official_status, r.status) == ("decided", None, "not_stated")
    refused("SOURCE_ID_MISMATCH", sources, "get_proposal", proposal_sn="146")
    assert T.call(sources, "get_attachments", {"proposal_sn": "145"}).data.count() == 0


def test_records(sources):
    rows = T.call(sources, "council_meetings").data.collect()
    assert [(r.meeting_id, r.meeting_name, r.meeting_date) for r in rows] == [("1", "第1次", "115/01/01"), ("2", "第2次", "115/01/02")]
    r = T.call(sources, "get_meeting_record", {"record_id": "1", "keyword": "道路", "page": 2}).data.first()
    assert (r.total_pages, r.page_content, r.matched_pages_count, r.matches[0].page, r.matches[0].match_count) == (2, "道路與道路", 1, 2, 2)
    refused("INVALID_ARGUMENT", sources, "get_meeting_record", record_id="1", page=3)
    refused("RECORD_UNREADABLE", sources, "get_meeting_record", record_id="2")
    refused("RECORD_UNREADABLE", sources, "get_meeting_record", record_id="9", pdf_url=f"{SITE}/MeetingRecord/9/a.pdf")
    refused("NOT_FOUND", sources, "get_meeting_record", record_id="9")
    refused("SOURCE_ID_MISMATCH", sources, "get_meeting_record", record_id="9", pdf_url=f"{SITE}/MeetingRecord/8/a.pdf")
    refused("INVALID_ARGUMENT", sources, "get_meeting_record", record_id="9", pdf_url="https://other.example/MeetingRecord/9/a.pdf")
    found = T.call(sources, "search_record_contents", {"keyword": "道路"})
    assert found.status == "partial" and [(r.record_id, r.match_count) for r in found.data.collect()] == [("1", 2)]
    assert (found.meta["attempted_records_count"], found.meta["failed_records_count"], found.meta["reason_code"]) == (2, 1, "PARTIAL_SCAN")


def test_catalogue_and_refusals(sources):
    assert T.catalogue(sources.spark).count() == 21
    for name, given in {"search_interpellations": {"keyword": "a"}, "get_schedule": {}, "get_councilor": {"name": "a"}, "search_temporary_proposals": {}, "search_committees": {}, "search_speeches": {"speaker": "a"}, "proposal_relations": {"proposal_sn": "1"}}.items():
        refused("FEATURE_UNAVAILABLE", sources, name, **given)
    refused("INVALID_ARGUMENT", sources, "search_speeches")
    refused("UNKNOWN_TOOL", sources, "other")
    refused("INVALID_ARGUMENT", sources, "search_laws", other=1)


def test_attachments_that_are_there(sources):
    row = lambda host: f'<tr><td>1</td><td>說明</td><td><a href="{host}/f/1.pdf">a.pdf</a></td><td>12 KB</td></tr>'
    url = lambda page, params: f"{SITE}/{T.PAGES[page]}?{urlencode(params)}"
    shown = lambda html, url=url: T.Sources(sources.spark, site=SITE, fetch=lambda page, params: sources.spark.createDataFrame([(0, url(page, params), f"<table>{html}</table>")], "page_id int, url string, html string"))
    found = T.call(shown(row("")), "get_attachments", {"proposal_sn": "1"})
    assert [(r.no, r.name, r.size, r.download_url) for r in found.data.collect()] == [("1", "a.pdf", "12 KB", f"{SITE}/f/1.pdf")] and found.meta["total_files"] == 1
    refused("PARSER_CONTRACT_CHANGED", shown(row("https://other.example")), "get_attachments", proposal_sn="1")
    refused("PARSER_CONTRACT_CHANGED", shown(""), "get_attachments", proposal_sn="1")
    relative = T.call(shown(row("").replace("/f/1.pdf", "f/1.pdf")), "get_attachments", {"proposal_sn": "1"})
    assert relative.data.first().download_url == f"{SITE}/f/1.pdf"  # links are seen from the site's root
    for other in (f"{SITE}/{T.PAGES['attachments']}?f=1&s=2", f"{SITE}/{T.PAGES['attachments']}", f"https://other.example/{T.PAGES['attachments']}?s=1", f"{SITE}/Login.aspx?s=1"):
        refused("SOURCE_ID_MISMATCH", shown(row(""), lambda page, params, other=other: other), "get_attachments", proposal_sn="1")


def test_detail_url_is_what_is_read(sources):
    asked = []

    def fetch(page, params):
        asked.append((page, params))
        return sources.fetch(page, params)

    own = dataclasses.replace(sources, fetch=fetch)
    for given in ("Detail.aspx?s=145&k=1", "/Detail.aspx?s=145&k=1", f"{SITE}/System/Proposal/Detail.aspx?s=145&k=1"):
        found = T.call(own, "get_proposal", {"proposal_sn": "145", "detail_url": given})
        assert found.data.first().detail_url == found.provenance["source_url"] == f"{SITE}/System/Proposal/Detail.aspx?s=145&k=1"
    assert asked == [("proposal", {"s": "145", "k": "1"})] * 3
    for bad in ("https://other.example/System/Proposal/Detail.aspx?s=145", "http://site.example/System/Proposal/Detail.aspx?s=145", f"{SITE}/System/Other/Detail.aspx?s=145", f"{SITE}/x"):
        refused("INVALID_ARGUMENT", own, "get_proposal", proposal_sn="145", detail_url=bad)
    moved = dataclasses.replace(sources, fetch=lambda page, params: sources.fetch(page, params).withColumn("url", F.lit(f"{SITE}/Login.aspx")))
    refused("PARSER_CONTRACT_CHANGED", moved, "get_proposal", proposal_sn="145")


def test_records_from_their_files(sources):
    file = plain_pdf(["no match".encode("cp1252"), b"roads and roads"])
    def files(rows, column):
        url, bad = F.col(column), F.col("record_id") == "3"
        return rows.withColumn("url", F.when(F.col("record_id") == "4", F.lit(f"{SITE}/MeetingRecord/5/a.pdf")).otherwise(url)).withColumn("error", F.when(bad, "no answer")).withColumn("content", F.when(~bad, F.lit(file)))

    own = dataclasses.replace(sources, files=files)
    r = T.call(own, "get_meeting_record", {"record_id": "2", "keyword": "roads", "page": 2})
    assert (r.data.first().total_pages, r.data.first().page_content, r.data.first().match_count, r.meta["from_cache"]) == (2, "roads and roads", 2, False)
    refused("INVALID_ARGUMENT", own, "get_meeting_record", record_id="2", page=3)
    refused("PDF_EXTRACTION_FAILED", own, "get_meeting_record", record_id="3", pdf_url=f"{SITE}/MeetingRecord/3/a.pdf")
    refused("SOURCE_ID_MISMATCH", own, "get_meeting_record", record_id="4", pdf_url=f"{SITE}/MeetingRecord/4/a.pdf")
    found = T.call(own, "search_record_contents", {"keyword": "roads"})
    assert (found.status, found.meta["succeeded_records_count"], [(x.record_id, x.match_count) for x in found.data.collect()]) == ("success", 2, [("2", 2)])
    broken = dataclasses.replace(own, files=lambda rows, column: files(rows, column).withColumn("content", F.lit(b"x")))
    found = T.call(broken, "search_record_contents", {"keyword": "道路"})
    assert (found.status, found.meta["failures"]) == ("partial", [{"record_id": "2", "reason": "no PDF header"}])


def test_meeting_by_its_number(sources):
    with pytest.raises(Refused) as e:  # the form's answer does not confirm the meeting that the number stands for
        T.call(sources, "search_proposals", {"session": "", "meeting_number": 8})
    assert "07040800" in str(e.value)
    refused("NOT_FOUND", sources, "search_proposals", session="0704", meeting_number=9)


def test_answers_as_json_and_a_fallback(sources):
    found = T.call(sources, "latest_news", {"limit": 1})
    shown = json.loads(found.as_json())
    assert (shown["status"], shown["data"][0]["news_id"], shown["provenance"]["snapshot_id"]) == ("success", "N2", "s1")
    assert T.Envelope(found.data, {"source_type": "fallback"}, {}).status == "partial"


def test_caches(spark, tmp_path):
    law = lambda k: {"law_id": k, "law_name": "騎樓", "category": "c", "published_at": "x", "official_url": f"https://law.example/a?id={k}", "history": "", "articles": [{"article_no": "1", "content": "t"}]}
    publish(tmp_path, "laws", [law("A")])
    own = T.Sources(spark, str(tmp_path), "law.example")
    ids = lambda: [r.law_id for r in T.call(own, "search_laws", {"keyword": "騎樓"}).data.collect()]
    assert ids() == ["A"]
    (tmp_path / "verified/laws/s1/normalized.json").write_text("[]")  # verified data are not read again while the pointer stays
    assert ids() == ["A"]
    publish(tmp_path, "laws", [law("B"), law("C")])  # another manifest ends them
    assert ids() == ["B", "C"]
    denied = T.Sources(spark, str(tmp_path), "law.example", revoked=(json.loads((tmp_path / "verified/laws/s1/manifest.json").read_text())["normalized_sha256"],), snapshots=own.snapshots)
    refused("SNAPSHOT_REVOKED", denied, "search_laws", keyword="騎樓")  # a deny-list is never hidden by the cache
    put(tmp_path, "b.csv", "科目名稱,預算數\n合計,3\n甲,3\n")
    clock, ended = [0.0], []
    own = T.Sources(spark, budgets={115: [str(tmp_path / "b.csv")]}, summaries=Timed(10, ended.append, lambda: clock[0]), raw_budgets=Timed(20, ended.append, lambda: clock[0]))
    first = T.call(own, "budget_summary")
    assert T.call(own, "budget_summary") is first and not ended
    clock[0] = 10.0
    assert T.call(own, "budget_summary").data.first().agency_sum == 3.0 and ended == [first]


def test_refused_laws_are_not_kept(spark, tmp_path):
    kept = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    law = {"law_id": "A", "law_name": "n", "category": "c", "published_at": "x", "official_url": "https://law.example/a?id=A", "history": ""}
    own = T.Sources(spark, str(tmp_path), "law.example")
    before = kept()
    for articles in ([], [{"article_no": "1", "content": " \u3000\n"}], [{"article_no": "1", "content": None}]):
        publish(tmp_path, "laws", [law | {"articles": articles}])
        refused("SNAPSHOT_UNVERIFIED", own, "search_laws", keyword="n")
    assert kept() == before
    publish(tmp_path, "laws", [law | {"articles": [{"article_no": "1", "content": " a "}]}])
    assert T.call(own, "search_laws", {"keyword": "n"}).data.count() == 1 and kept() > before
