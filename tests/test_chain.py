"""List rows to details to files in one job, over a local server and over stored pages; and pages of two tabs."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from lakequarry.operators import markup
from lakequarry.plans import chain

SITE = "https://site.example"


def detail(sn):
    return f'<input name="hidProposalSN" value="{sn}"/><table><tr><td>案由</td><td>修路 &amp; {sn}</td><td>類別：</td><td>民政</td></tr><tr><td>類別</td><td>交通</td></tr></table><table><tr><td>二讀決議：照案通過</td><td>決議日期：115/09/08</td></tr></table>'


def files(*links):
    return "<table><tr><td>序號</td><td>a</td><td>b</td><td>c</td></tr>" + "".join(f'<tr><td>{n}</td><td>d</td><td><a href="{x}">f{n}</a></td><td>1 KB</td></tr>' for n, x in enumerate(links, 1)) + "</table>"


PAGES = {("d", "1"): detail(1), ("f", "1"): files("f/1.pdf", "/g/2.pdf"), ("d", "2"): detail(2), ("f", "2"): "尚無任何資料", ("d", "3"): detail(9), ("f", "3"): files("a.pdf"), ("d", "4"): detail(4), ("f", "4"): "<html></html>", ("d", "5"): detail(5), ("f", "5"): files("https://other.example/x.pdf"), ("d", "6"): detail(6)}
REASONS = {"1": None, "2": None, "3": "SOURCE_ID_MISMATCH", "4": "PARSER_CONTRACT_CHANGED", "5": "PARSER_CONTRACT_CHANGED", "6": "SOURCE_UNAVAILABLE", "7": "SOURCE_UNAVAILABLE", "8": "INVALID_ARGUMENT"}


def rows(spark):
    made = [(str(k), f"Detail.aspx?s={k}", f"kept {k}") for k in range(1, 8)] + [("8", "https://other.example/System/Proposal/Detail.aspx?s=8", "kept 8")]
    return spark.createDataFrame(made, "proposal_sn string, detail_url string, url2 string")


def test_stored_pages(spark):
    stored = [(f"{SITE}/System/Proposal/Detail.aspx?s={k}" if p == "d" else f"{SITE}/Common/GetAttachmentList.ashx?f=1&s={k}&t=False", html) for (p, k), html in PAGES.items()]
    found = {r.proposal_sn: r for r in chain.proposals_with_files(rows(spark), chain.from_table(spark.createDataFrame(stored, "url string, html string")), SITE).collect()}
    assert {k: r.reason and r.reason.split(":")[0] for k, r in found.items()} == REASONS
    one = found["1"]
    assert (one.fields.subject, one.fields.category, one.fields.method, one.review.second_reading_resolution, one.review.second_reading_date, one.status, one.url2) == ("修路 & 1", "交通", "", "照案通過", "115/09/08", "decided", "kept 1")
    assert [(f.no, f.name, f.download_url) for f in one.files] == [("1", "f1", f"{SITE}/f/1.pdf"), ("2", "f2", f"{SITE}/g/2.pdf")] and found["2"].files == []
    assert found["4"].fields.subject == "修路 & 4" and found["3"].fields is None  # what was read before the failure


def test_a_hundred_rows_from_a_server_in_one_job(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802 - the library's name
            asked = urlsplit(self.path)
            k = parse_qs(asked.query)["s"][0]
            body = (detail(k) if "Detail" in asked.path else files(f"f/{k}.pdf")).encode()
            self.send_response(500 if k == "13" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_port

    def fetch(df, url):  # the site's own pages, from the local server
        local = F.regexp_replace(url, f"^{SITE}", f"http://127.0.0.1:{port}")
        return chain.web.fetch_each(df, local).withColumn("url", F.regexp_replace("url", f"^http://127.0.0.1:{port}", SITE))

    listed = spark.range(100).select(F.col("id").cast("string").alias("proposal_sn"), F.concat(F.lit("Detail.aspx?s="), "id").alias("detail_url"))
    found = {r.proposal_sn: r for r in chain.proposals_with_files(listed, fetch, SITE).collect()}
    server.shutdown()
    assert len(found) == 100 and [k for k, r in found.items() if r.reason] == ["13"] and "500" in found["13"].reason
    assert all(r.fields.subject == f"修路 & {k}" and r.files[0].download_url == f"{SITE}/f/{k}.pdf" for k, r in found.items() if k != "13")


@pytest.mark.parametrize("second", [True, False])
def test_two_tabs(spark, second):
    row = lambda k: f'<tr><td>{k}</td><td>c</td><td>x</td><td><a href="d?a=1&amp;b={k}">y</a></td><td>s</td></tr>'
    head = "<tr><th>編號</th><th>類別</th><th>提案議員</th><th>案由</th></tr>"
    one = f'<table border="0" id="gvIndex01">{head}{row(1)}{row(2)}<tr><td>short</td></tr></table>共 1,234 筆'
    two = f'<table id="gvIndex02">{head}<tr><td colspan=4>尚無任何資料</td></tr></table>共 0 筆' if second else ""
    pages = spark.createDataFrame([(7, one + two)], "page_id int, html string")
    tabs = {"proposals": "gvIndex01", "temporary": "gvIndex02"}
    found = markup.tab_rows(pages, "page_id", "html", tabs).collect()
    assert [(r.tab, r.number, r.subject, r.status, r.remark, r.link) for r in found] == [("proposals", "1", "y", "s", "", "d?a=1&b=1"), ("proposals", "2", "y", "s", "", "d?a=1&b=2")]
    got = {r.tab: (r.there, r.returned_count, r.total_count, r.is_complete) for r in markup.tab_completeness(pages, "page_id", "html", tabs).collect()}
    assert got == {"proposals": (True, 2, 1234, False), "temporary": (True, 0, 0, True) if second else (False, 0, None, None)}
