import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequarry.llm import kneser_ney as K
from lakequarry.llm.byte_bpe import ByteBpe
from lakequarry.llm.common import within

from .fixtures import documents, table


def brute(texts, trained):
    """Mean negative log-probability of each text by the textbook's formulas."""
    bpe = ByteBpe()
    pairs_of = lambda t: list(zip([K.START, *(i := np.frombuffer(bpe.plain_ids(t or ""), "<u4").tolist())][:-1], i, strict=True))
    n = Counter(p for t in trained for p in pairs_of(t))
    d = K.discounts(*[sum(c == k for c in n.values()) for k in (1, 2, 3, 4)])
    kinds = Counter(w for _, w in n)
    e = K.discounts(*[sum(c == k for c in kinds.values()) for k in (1, 2, 3, 4)])
    total, follow = Counter(), {}
    for (v, _), c in n.items():
        total[v] += c
        follow.setdefault(v, []).append(min(c, 3))

    def q(w):
        freed = sum(e[min(c, 3)] for c in kinds.values()) / len(n) if n else 1
        return ((kinds[w] - e[min(kinds[w], 3)]) / len(n) if n else 0) + freed / K.VOCABULARY

    def p(v, w):
        if v not in total:
            return q(w)
        return max(n[v, w] - d[min(n[v, w], 3)], 0) / total[v] + sum(d[c] for c in follow[v]) / total[v] * q(w)

    return [-sum(math.log(p(v, w)) for v, w in pairs) / len(pairs) if (pairs := pairs_of(t)) else None for t in texts]


@pytest.mark.parametrize(("tasks", "most_shards"), [(1, 256), (5, 256), (7, 2)])
def test_scores_match_brute_force(spark, tasks, most_shards):
    rows = documents(spark).collect()
    trained = [r.text for r in rows if r.doc_id is not None and r.doc_id % 2 == 0]
    docs = documents(spark).repartition(3)
    found = {(r.doc_id, r.row_key): r for r in K.score(docs, docs.where("doc_id % 2 = 0"), tasks, most_shards=most_shards).collect()}
    keys = documents(spark).select("doc_id", "text", K.row_key(documents(spark)).alias("k")).collect()
    for r, want in zip(keys, brute([r.text for r in keys], trained), strict=True):
        got = found[r.doc_id, r.k].log_ppl
        assert got is want if want is None else math.isclose(got, want, rel_tol=1e-4), r.doc_id


def test_tasks_grow_with_the_input_and_shards_with_the_model():
    assert K.dealt(0, 0, 8) == (8, 1) and K.dealt(30 << 30, 10**6, 32) == (256, 4)
    assert K.dealt(100 << 40, 2 * 10**8, 1000) == (400, 8192)


def test_row_keys_tell_nulls_and_neighbours_apart(spark):
    rows = [(5, "x", None), (5, None, "x"), (5, "x", ""), (5, "", "x"), (None, "x", "x"), (5, "1:x", "~"), (5, "~", "1:x")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert df.select(K.row_key(df)).distinct().count() == len(rows)


def test_probabilities_sum_to_one(spark):
    docs = documents(spark)
    counts = K.pair_counts(docs)
    lower = K.lower_orders(counts)
    assert math.isclose(np.exp(lower.log_q).sum(), 1)
    rows = counts.toPandas()
    v = int(rows["key"].iloc[0]) >> 16
    own = rows[rows["key"] // 65536 == v]
    p = np.exp(lower.log_free[v] + lower.log_q)
    keys = own["key"].to_numpy(np.int64)
    p[keys & 0xFFFF] *= np.exp(lower.gains(keys, own["n"].to_numpy(np.int64)))
    assert math.isclose(p.sum(), 1)


def test_postings_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 32, 50))
    sizes = rng.integers(1, 9, len(keys))
    docs = np.concatenate([np.sort(rng.choice(65536, s, replace=False)) for s in sizes])
    n = rng.integers(1, 70000, len(docs))
    assert all((a == b).all() for a, b in zip(K.unpack_postings(K.pack_postings(keys, sizes, docs, n)), (keys, sizes, docs, n), strict=True))


def test_classifier_rejects_junk_only(spark, tmp_path):
    good = [(i, "the river runs past the old harbour and the stone wall " * (1 + i % 5), "en" if i % 3 else "xx", 1) for i in range(200)]
    junk = [(1000 + i, "zq#9 @@k vv0 " * 20 + str(i), "en" if i % 2 else None, 0) for i in range(10)]
    rows = [*good, *junk, (2000, None, "en", None), (2001, "", None, None), (None, good[0][1], "en", None), good[0]]
    df = spark.createDataFrame([(a, b, c, 1.0, 2.0) for a, b, c, _ in rows], "doc_id long, text string, lang string, threshold double, kept double")
    labels = spark.createDataFrame([(a, q, 0) for a, _, _, q in rows if q is not None], "doc_id long, quality int, toxic int")
    out = K.classify(df, labels).collect()
    assert len(out) == len(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id < 1000) for r in out)
    kept = K.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == 202
    d = table(spark, tmp_path, "documents", df.limit(0))
    table(spark, tmp_path, "labels", labels)
    assert K.op3_kneser_ney(spark, d).count() == 0
    assert K.keep_good(df, labels.limit(0)).where("doc_id >= 1000").count() == 10


def test_accuracy_on_labelled_documents_that_the_model_has_not_seen(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    judged = K.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("NOT (quality = 1 AND pmod(xxhash64(doc_id, 'half'), 2) = 0)")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    share = lambda q: n.get((q, False), 0) / (n.get((q, False), 0) + n.get((q, True), 0))
    assert share(0) >= 0.75 and share(1) <= 0.02, n


def test_every_trusted_document_counts(spark):
    """Over the million that a hash once chose from."""
    labels = spark.range(1_500_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert K.trusted_ids(labels.unionByName(labels.limit(10)).unionByName(labels.select("doc_id", F.lit(0).alias("quality")))).count() == 1_500_000


def test_verdicts_do_not_depend_on_how_trusted_documents_are_joined(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    near, far = ({tuple(r) for r in K.classify(docs, labels, **o).collect()} for o in ({}, {"most_ids": 0}))
    assert near == far
    rows = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id") - 1000).alias("k"))
    ids = spark.range(300).select((F.col("id") * 3 - 400).alias("k"))
    got = sorted(r.k for r in within(rows, ids, "k", 0, bits=1).collect())
    assert got == sorted(k for r in rows.collect() if (k := r.k) is not None and -400 <= k < 500 and (k + 400) % 3 == 0)
