"""Row-by-row limits on streams, key-value tables as sinks, page stores, and requests a host gets at a time."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakequarry.errors import Refused
from lakequarry.operators import paged
from lakequarry.sources import page_store, web
from lakequarry.sources.key_values import KeyValues
from lakequarry.streaming import windows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_stream_lets_through_what_the_table_does(spark, tmp_path, rocksdb):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), 1_700_000_000 + rng.random() * 400, n, rng.choice([None, "x ü"])) for n in range(300)]
    rows += [("a", 1_700_000_030.5, 1000 + n, "tie") for n in range(9)]
    rows.sort(key=lambda r: r[1] + rng.random() * 90)  # up to 90 s late
    schema = "user string, at double, event_id long, note string"
    for k in range(6):
        part = rows[k * 60 : (k + 1) * 60] + ([("z", 1_700_009_999.0, 9999, "the end")] if k == 5 else [])
        spark.createDataFrame(part, schema).select("user", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), "event_id", "note").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")
        time.sleep(0.05)
    every = spark.read.parquet(*[f"{tmp_path}/in/{k}.parquet" for k in range(6)])
    stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    found = windows.limited(stream, "ts", ["user"], 60, 5, "event_id", "120 seconds")
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(170)
    assert not query.isActive and query.exception() is None
    verdicts = {r.event_id: (r.allowed, r.user, r.ts, r.note) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    table = {r.event_id: r for r in every.where("event_id <> 9999").collect()}
    want = {r.event_id for r in windows.within_limit(every, "ts", ["user"], 60, 5, "event_id").select("event_id").collect()} - {9999}
    assert {e for e, v in verdicts.items() if v[0]} - {9999} == want
    assert set(verdicts) - {9999} == set(table) and 0 < len(want) < len(table)
    assert all(verdicts[e][1:] == (r.user, r.ts, r.note) for e, r in table.items())


def kv(spark, rows):
    return spark.createDataFrame(rows, "key string, value string, expiration long, metadata string")


def shown(store):
    return {r.key: (r.value, r.expiration) for r in store.table().collect()}


def test_key_values(spark, tmp_path):
    store = KeyValues(spark, str(tmp_path / "kv"), buckets=4)
    assert shown(store) == {} and store.get("a", F.lit(0)).count() == 0
    assert store.upsert(kv(spark, [(f"k{i}", "old", None, None) for i in range(20)]), F.lit(100)) == 1
    assert store.upsert(kv(spark, [("k1", "new", None, "m"), ("k1", "new", None, "m"), ("n", "v", None, None)]), F.lit(100), ttl_seconds=50) == 2
    assert shown(store) == {f"k{i}": ("old", None) for i in range(20) if i != 1} | {"k1": ("new", 150), "n": ("v", 150)}
    assert [r.value for r in store.get("k1", F.lit(149)).collect()] == ["new"] and store.get("k1", F.lit(150)).isEmpty()
    before = store.state()["folders"]
    assert store.purge(F.lit(150)) == 3 and "k1" not in shown(store)
    changed = {b for b, f in store.state()["folders"].items() if before.get(b) != f}
    assert len(changed) <= 2  # the other buckets are the same files
    assert store.purge(F.lit(150)) == 3  # nothing to do, no version
    store.delete(kv(spark, [(f"k{i}", None, None, None) for i in range(20)]))
    assert shown(store) == {}
    assert {r.key for r in store.table(store.state(1)).collect()} == {f"k{i}" for i in range(20)}  # older versions stay readable


def test_failed_and_repeated_writes_change_nothing(spark, tmp_path):
    store = KeyValues(spark, str(tmp_path / "kv"), buckets=3)
    store.upsert(kv(spark, [("a", "1", None, None)]), F.lit(0), batch=("w", 0))
    bad = kv(spark, [("a", "2", None, None), ("b", "x", None, None)]).withColumn("value", F.when(F.col("key") == "b", F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(PySparkException):
        store.upsert(bad, F.lit(0), batch=("w", 1))
    assert shown(store) == {"a": ("1", None)}
    put = store.sink("w", F.lit(0))
    put(kv(spark, [("a", "3", None, None)]), 1)
    put(kv(spark, [("a", "again", None, None)]), 1)
    put(kv(spark, [("a", "earlier", None, None)]), 0)
    assert shown(store) == {"a": ("3", None)} and store.state()["version"] == 2
    stale = store.state()
    store.upsert(kv(spark, [("a", "4", None, None)]), F.lit(0))
    with pytest.raises(Refused, match="WRITE_CONFLICT"):  # a writer that began from an older version
        store._commit(stale, kv(spark, [("a", "5", None, None)]), [0, 1, 2], None)
    assert shown(store) == {"a": ("4", None)}


def test_stream_into_key_values(spark, tmp_path):
    kv(spark, [("a", "1", None, None), ("b", "2", None, None)]).coalesce(1).write.parquet(f"{tmp_path}/in")
    store = KeyValues(spark, str(tmp_path / "kv"), buckets=2)
    stream = spark.readStream.schema("key string, value string, expiration long, metadata string").parquet(f"{tmp_path}/in")
    query = stream.writeStream.foreachBatch(store.sink("s", F.lit(5), 10)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert shown(store) == {"a": ("1", 15), "b": ("2", 15)}


def test_page_store_reads_the_buckets_of_the_ids_alone(spark, tmp_path):
    pages = F.transform(F.sequence(F.lit(1), (F.col("id") % 3 + 1).cast("int")), lambda p: F.struct(p.alias("page"), F.concat_ws(" ", F.lit("road"), F.col("id"), p).alias("text")))
    records = spark.range(500).select("id", F.col("id").cast("string").alias("record_id"), F.lit("u").alias("pdf_url"), (F.col("id") % 3 + 1).cast("int").alias("total_pages"), pages.alias("pages"))
    page_store.write(records, f"{tmp_path}/p", buckets=50)
    found = page_store.read(spark, f"{tmp_path}/p", ["7", "8", "none"], buckets=50)
    assert {(r.record_id, r.total_pages, r.pages[0].text) for r in found.collect()} == {("7", 2, "road 7 1"), ("8", 3, "road 8 1")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:200] and "record_id" in plan.split("PushedFilters: [")[1][:300]
    with pytest.raises(Refused):
        page_store.write(records.withColumn("total_pages", F.lit(9)), f"{tmp_path}/bad")
    index = records.select(F.col("id").alias("_pos"), "record_id")
    hits, failures, stats = paged.scan(index, lambda ids: paged.pages_of(records.join(ids, "record_id", "left_semi")), "road 3", 5)
    assert [r.record_id for r in hits.collect()] == ["3"] and failures.count() == 0 and stats.first().attempted_records_count == 5
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # pages are taken apart above the semi-join, of chosen records only


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        now, most, lock = 0, 0, threading.Lock()

        def do_GET(self):  # noqa: N802 - the library's name
            cls = Handler
            with cls.lock:
                cls.now += 1
                cls.most = max(cls.most, cls.now)
            time.sleep(0.15)
            with cls.lock:
                cls.now -= 1
            missing = "gone" in self.path
            body = b"" if missing else f"page {self.path}".encode()
            self.send_response(404 if missing else 200)
            self.send_header("Content-Length", "99999999" if "large" in self.path else str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", Handler
    made.shutdown()


def test_a_host_gets_three_requests_at_a_time(spark, server):
    url, seen = server
    web.register(spark)
    found = spark.read.format("web_pages").options(url=f"{url}/a", params=json.dumps([{"n": k} for k in range(15)])).load().orderBy("request").collect()
    assert [r.html for r in found] == [f"page /a?n={k}" for k in range(15)] and 1 < seen.most <= 3
    seen.most = 0
    rows = spark.range(15).select("id", F.concat(F.lit(f"{url}/b?n="), F.when(F.col("id") == 4, "gone").when(F.col("id") == 5, "large").otherwise(F.col("id").cast("string"))).alias("link"), F.lit("mine").alias("status")).repartition(8)
    got = {r.id: r for r in web.fetch_each(rows, F.when(F.col("id") != 6, F.col("link")), binary="true").collect()}
    assert seen.most <= 3 and len(got) == 15
    assert bytes(got[3].content) == b"page /b?n=3" and got[3].status == 200 and got[3].error is None
    assert got[4].status == 404 and got[4].content is None and "SOURCE_TOO_LARGE" in got[5].error and "INVALID_ARGUMENT" in got[6].error
