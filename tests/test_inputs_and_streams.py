"""JSON tables, snapshots in parts, web pages, and windows and state over streams."""

import hashlib
import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs

import pytest
from pyspark.sql import functions as F

from lakequarry.errors import Refused
from lakequarry.operators import keyed
from lakequarry.plans.tools import web_fetch
from lakequarry.sources import delimited, results, snapshots, web
from lakequarry.streaming import windows


def test_json_budgets(spark, tmp_path):
    records = [{"科目名稱": "甲", "本年度預算數": "1,000"}, {"科目名稱": "乙", "本年度預算數": 2.5}, {"科目名稱": "", "本年度預算數": "3"}, {"科目名稱": "丙", "本年度預算數": "x"}]
    want = [("甲", 1000.0), ("乙", 2.5)]
    for shape in (records, {"data": records}, {"a": {"b": [{"Records": records}]}}):
        found = delimited.read_json(spark, json.dumps(shape))
        assert [(r.name, r.amount) for r in found.orderBy("_pos").collect()] == want
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.json").write_text("\n".join(map(json.dumps, records)), encoding="utf-8")
    assert [(r.name, r.amount) for r in delimited.read_json_lines(spark, str(tmp_path / "l")).orderBy("_pos").collect()] == want
    for bad in ("{", json.dumps([{"a": 1}]), json.dumps({"a": {"b": {"c": {"d": {"e": {"f": records}}}}}})):
        with pytest.raises(Refused) as e:
            delimited.read_json(spark, bad)
        assert e.value.reason_code == "SOURCE_SCHEMA_CHANGED"


def test_snapshot_in_parts(spark, tmp_path):
    def store(root, tamper=None):
        parts = []
        for k, ids in enumerate((["a", "b"], ["c"])):
            text = "".join(json.dumps({"id": i}) + "\n" for i in ids)
            key = f"verified/d/s1/part-{k}.json"
            (root / key).parent.mkdir(parents=True, exist_ok=True)
            (root / key).write_text(text.replace("c", "x") if tamper else text)
            parts.append({"key": key, "sha256": hashlib.sha256(text.encode()).hexdigest(), "record_count": len(ids)})
        m = json.dumps({
            "schema_version": "2.0", "dataset_id": "d", "snapshot_id": "s1", "normalized_key": "verified/d/s1/normalized.json", "normalized_sha256": hashlib.sha256("\n".join(p["sha256"] for p in parts).encode()).hexdigest(), "record_count": 3,
            "fetched_at": "2026-01-01T00:00:00Z", "validated_at": "2026-01-02T00:00:00Z", "validation_status": "passed", "coverage": {"scope": "all", "complete": True}, "parser_version": "1", "validator_version": "1", "parts": parts,
        })
        (root / "releases/d").mkdir(parents=True)
        (root / "verified/d/s1/manifest.json").write_text(m)
        (root / "releases/d/active.json").write_text(json.dumps({"manifest_key": "verified/d/s1/manifest.json", "manifest_sha256": hashlib.sha256(m.encode()).hexdigest()}))
        return str(root)

    found = snapshots.load(spark, store(tmp_path / "good"), "d", "id string")
    assert sorted(r.id for r in found.records.collect()) == ["a", "b", "c"]
    with pytest.raises(Refused) as e:
        snapshots.load(spark, store(tmp_path / "bad", tamper=True), "d", "id string")
    assert e.value.reason_code == "SNAPSHOT_UNVERIFIED"


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802 - the library's name
        self.send_response(404 if "missing" in self.path else 200)
        self.send_header("Set-Cookie", "visit=7; Path=/")
        self.end_headers()
        hidden = '<input type="hidden" id="__VIEWSTATE" value="a&amp;b"/>' if self.path.endswith("Default.aspx") else ""
        self.wfile.write(f"<p>{self.path}</p>{hidden}".encode())

    def do_POST(self):  # noqa: N802 - the library's name
        sent = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode(), keep_blank_values=True)
        if "elsewhere" in str(sent):
            self.send_response(302)
            self.send_header("Location", "/other")
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({k: v[0] for k, v in sent.items()} | {"cookie": self.headers["Cookie"]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_web_pages(spark, site):
    web.register(spark)
    read = lambda path="/a", **options: spark.read.format("web_pages").option("url", site + path).option("params", json.dumps([{"s": "1"}, {"s": "2"}])).options(**options).load()
    rows = read().where(F.col("period") == "07").orderBy("request").collect()
    assert [(r.status, r.html, r.period) for r in rows] == [(200, "<p>/a?s=1&period=07</p>", "07"), (200, "<p>/a?s=2&period=07</p>", "07")]
    assert [(r.status, r.html) for r in read("/missing").collect()] == [(404, None)] * 2
    assert all("SOURCE_TOO_LARGE" in r.error for r in read(max_bytes="3").collect())
    assert all("SOURCE_ID_MISMATCH" in r.error for r in read(host="other.example").collect())
    assert web_fetch(spark, site)("proposal", {"s": "7"}).first().html == "<p>/System/Proposal/Detail.aspx?s=7</p>"


def test_searches_are_posts_with_tokens(spark, site):
    fetch, body = web_fetch(spark, site), "ctl00$ContentPlaceHolder1$"
    sent = json.loads(fetch("proposals", {"period": "07", "keyword": "道路"}).first().html)
    assert (sent["__VIEWSTATE"], sent["__EVENTVALIDATION"], sent["__EVENTTARGET"], sent["cookie"]) == ("a&b", "", body + "LinkButton1", "visit=7")
    assert (sent[body + "uscPeriodSessionMeeting$ddlPeriod"], sent[body + "uscPeriodSessionMeeting$ddlSession"], sent[body + "txtKeyword"], sent[body + "ddlProposalKind"]) == ("07", "", "道路", "0")
    sent = json.loads(fetch("records", {"period": "07"}).first().html)
    assert (sent[body + "uscPeriodSessionMeeting$ddlPeriod"], sent[body + "txtKeyword"]) == ("07", "") and body + "uscPeriodSessionMeeting$ddlSession" not in sent
    assert "__VIEWSTATE" in fetch("proposals", {}).first().html  # the form itself
    with pytest.raises(Exception, match="PARSER_CONTRACT_CHANGED"):
        fetch("records", {"keyword": "elsewhere"}).first()


def test_json_results(spark, tmp_path):
    results.write_json(spark.createDataFrame([(1, None), (2, 'a"b')], "k int, v string").coalesce(1), str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"k": 1, "v": None}, {"k": 2, "v": 'a"b'}]


def test_rate_windows_over_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 70), ("a", 1000)], "who string, at long").withColumn("at", F.timestamp_seconds("at"))
    table = windows.rate_windows(events, "at", ["who"], 60, 3)
    want = sorted((r.who, r.n, r.allowed, r.rejected) for r in table.collect())
    assert want == [("a", 1, 1, 0), ("a", 5, 3, 2), ("b", 1, 1, 0)]
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.rate_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "at", ["who"], 60, 3)
    run = stream.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    # the last window is not closed yet
    assert sorted((r.who, r.n, r.allowed, r.rejected) for r in spark.table("rates").collect()) == [("a", 5, 3, 2), ("b", 1, 1, 0)]


def test_expiring_values_over_a_stream(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("l", "x", 1)], "key string, value string, at long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.expiring_values(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3600)
    run = stream.writeStream.format("memory").queryName("held").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    deadline = time.monotonic() + 60
    while spark.table("held").isEmpty() and time.monotonic() < deadline:  # processing time goes on: such a query never ends by itself
        time.sleep(1)
    run.stop()
    assert sorted((r.key, r.value, r.updates) for r in spark.table("held").collect()) == [("k", "new", 2), ("l", "x", 1)]
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_keyed_tables(spark):
    held = spark.createDataFrame([("a", "1", None), ("b", "2", 10)], "key string, value string, expiration long")
    put = keyed.put(held, spark.createDataFrame([("a", "3")], "key string, value string"), F.lit(100), 5)
    assert sorted((r.key, r.value, r.expiration) for r in put.collect()) == [("a", "3", 105), ("b", "2", 10)]
    assert [r.key for r in keyed.purge(put, F.lit(50)).collect()] == ["a"]
    page, complete, cursor = keyed.read_page(put, "key", 1)
    assert ([r.key for r in page.collect()], complete, cursor) == (["a"], False, "a")
