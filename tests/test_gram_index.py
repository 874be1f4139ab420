"""Searches by grams against scans."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from lakequarry.operators import gram_index


def test_same_rows_as_a_scan(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé道路😀 ") for _ in range(rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 30, 200]))) for _ in range(800)]
    texts[5:8] = [None, "", "ab\ncd" * 3000]
    rows = spark.createDataFrame([(i if i != 9 else None, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, gram string")
    gram_index.build(rows, "doc_id", "text", str(tmp_path / "g"), shards=5, block_rows=7)
    keywords = ["b\nc", "zzz", "道路😀", "a", "", "ab", "no such"]
    for _ in range(45):
        t = rng.choice([t for t in texts if t])
        at, n = rng.randrange(len(t)), rng.randrange(1, 12)
        keywords.append(t[at : at + n])
    read = 0
    for k in keywords:
        found = gram_index.search(spark, str(tmp_path / "g"), "text", k, shards=5, most_listed=rng.choice([2, 1000]))
        assert found.columns == ["doc_id", "text", "gram"]
        want = sorted((i != 9, i if i != 9 else 0) for i, t in enumerate(texts) if t is not None and k in t)
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found.select("doc_id").collect()) == want, k
        read += len(k) > 6
    assert read > 10


def test_a_rare_keyword_reads_few_blocks(spark, tmp_path):
    rows = spark.range(5000).select("id", F.concat(F.lit("common words everywhere "), F.when(F.col("id") == 4321, "needle").otherwise("hay"), F.col("id").cast("string")).alias("text"))
    path = str(tmp_path / "g")
    gram_index.build(rows, "id", "text", path, shards=3)
    assert gram_index.blocks_of(spark, path, "needle", shards=3).count() == 1
    assert gram_index.blocks_of(spark, path, "common words", shards=3).count() > 70
    assert gram_index.blocks_of(spark, path, "xyzzy", shards=3).count() == 0 and gram_index.blocks_of(spark, path, "ne", shards=3) is None
    plan = gram_index.search(spark, path, "text", "needle", shards=3)._jdf.queryExecution().executedPlan().toString()
    assert "In(_block" in plan.split("PushedFilters")[1] or "EqualTo(_block" in plan.split("PushedFilters")[1]
    files = gram_index.blocks_of(spark, path, "needle", shards=3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in files and "shard" in files.split("PartitionFilters: [")[1][:100]


def test_postings_are_lists_of_blocks_a_task(spark, tmp_path, monkeypatch):
    rows = spark.range(3200).select("id", F.concat(F.lit("common words "), F.col("id").cast("string")).alias("text"))
    gram_index.build(rows.coalesce(1), "id", "text", str(tmp_path / "g"), shards=3)
    parts = spark.read.parquet(str(tmp_path / "g/rows")).select(F.spark_partition_id().alias("p")).distinct().count()
    found = spark.read.parquet(str(tmp_path / "g/postings"))
    blocks = found.select("gram", F.explode("blocks").alias("b"))
    assert found.groupBy("gram").count().agg(F.max("count")).first()[0] <= parts < 50 <= blocks.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert blocks.count() == blocks.distinct().count() == found.agg(F.sum("n")).first()[0]
    # against grams cut one by one: texts in slices, lists of a few postings, blocks that go on in another batch, bytes that are no characters
    monkeypatch.setattr(gram_index, "MOST_CHARS", 5)
    monkeypatch.setattr(gram_index, "MOST_HELD", 9)
    rng = random.Random(1)
    texts = [None, "", *("".join(rng.choice("abé道😀") for _ in range(rng.randrange(40))) for _ in range(60))]
    data = [None if t is None else t.encode() for t in texts] + [b"a\xffbc\xf0\x9f"]
    batches = [pa.RecordBatch.from_arrays([pa.array([k // 7 for k in range(at, min(at + 10, len(data)))]), pa.array(data[at : at + 10], pa.binary())], ["_block", "text"]) for at in range(0, len(data), 10)]
    for n in (1, 3, 5):
        listed = [(g, b) for batch in gram_index._postings(n, 4)(iter(batches)) for g, bs in zip(batch["gram"].to_pylist(), batch["blocks"].to_pylist(), strict=True) for b in bs]
        shown = [None if t is None else t.decode("utf-8", "replace") for t in data]
        want = {(t[i : i + n], k // 7) for k, t in enumerate(shown) if t for i in range(len(t) - n + 1)}
        assert set(listed) == {(int(gram_index.grams_of([g], n)[0]), b) for g, b in want} and len(set(listed)) == len(want)


def test_a_block_that_batches_cut_is_listed_once(monkeypatch):
    texts = [f"common words {k % 5}" for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k // 7 for k in range(at, at + 10)]), pa.array([t.encode() for t in texts[at : at + 10]], pa.binary())], ["_block", "text"]) for at in range(0, 60, 10)]
    want = sorted({(int(gram_index.grams_of([t[i : i + 3]], 3)[0]), k // 7) for k, t in enumerate(texts) for i in range(len(t) - 2)})
    for held in (1 << 22, 30):  # gathered in one list, and in several that end with a block
        monkeypatch.setattr(gram_index, "MOST_HELD", held)
        rows = [r for batch in gram_index._postings(3, 4)(iter(batches)) for r in batch.to_pylist()]
        assert sorted((r["gram"], b) for r in rows for b in r["blocks"]) == want and sum(r["n"] for r in rows) == len(want)
