import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from lakequarry.llm import sharding as S

from .fixtures import documents, table


def test_law_rows_and_mixture(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark, 700))
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    rows = S.op6_sharding(spark, d).collect()
    want = sorted((r.doc_id is None, r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs)
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    shards = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
        shards[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1 and len(shards) == 24


def test_matches_brute_force_interleaving(spark):
    docs = documents(spark, 700)
    rows = S.shard_documents(docs).collect()
    total = Counter(r.source for r in rows)
    for source, n in total.items():
        per = Counter(r.shard for r in rows if r.source == source)
        assert all(abs(per[k] - n / 24) <= 2 for k in range(24)), source
    import hashlib

    md5 = lambda b: hashlib.md5(b).hexdigest()
    own = defaultdict(list)
    for r in docs.collect():
        seeded = md5(f"{S.SEED}:{'~' if r.doc_id is None else r.doc_id}:{md5((r.text or '').encode())}".encode())
        own["" if r.source is None else "=" + r.source].append((seeded, r.doc_id))
    u = lambda s: int(md5((S.SEED + s).encode())[:8], 16) / 2**32
    order = sorted(((k + u(s)) / len(v), s, seeded, doc_id) for s, v in own.items() for k, (seeded, doc_id) in enumerate(sorted(v, key=lambda x: x[0])))
    n = len(order)
    want = Counter((x[3], i * 24 // n, i - -(-(i * 24 // n) * n // 24)) for i, x in enumerate(order))
    assert Counter((r.doc_id, r.shard, r.slot) for r in rows) == want


def test_empty_table_and_no_python(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark).limit(0))
    out = S.op6_sharding(spark, d)
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()


def test_many_small_sources_are_spread_and_columns_may_clash(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("s"), "id").alias("source"), F.lit(1).alias("cell"), F.lit("x").alias("shard"), F.lit(2).alias("seeded"))
    out = S.interleave(df, "source", F.md5(F.col("id").cast("string").cast("binary")), 8)
    assert sorted(out.columns) == sorted(df.columns + ["slot"]) and out.where("cell = 1 AND seeded = 2").count() == 4000
    staged = out.select("id", "shard").collect()
    assert max(Counter(r.shard for r in staged).values()) == 500
    u = spark.range(4000).select((F.conv(F.substring(F.md5(F.concat(F.lit(S.SEED), F.lit("=s"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32 * 100).cast("int").alias("c"))
    assert u.groupBy("c").count().agg(F.max("count")).first()[0] < 100  # 40 of 4,000 in a cell on average


def test_matches_its_sql(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark, 300))
    out = S.op6_sharding(spark, d)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    asked = con.execute(S.ORACLES["op6_sharding"])
    assert [c[0] for c in asked.description] == out.columns
    assert Counter(asked.fetchall()) == Counter(tuple(r) for r in out.collect())
