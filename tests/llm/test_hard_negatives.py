"""Hard negatives against a plain search over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakequarry.llm import hard_negatives as H

from .fixtures import table

SCHEMA = "vec_id long, embedding array<float>, label int, score double, id long"


def made(n=260, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.choice([-0.5, 0.25, 0.5, 1.0, rng.uniform(-1, 1)]) for _ in range(rng.choice([5, 5, 5, 3, 0] if i % 17 == 0 else [5]))]
        rows.append((i, x, 1 if rng.random() < 0.4 else rng.randrange(10), 0.5, 1))
    same = [0.5, 0.5, 0.25, 0.0, -0.25]
    rows += [(i, same, i % 3, None, None) for i in range(1000, 1030)]  # ties
    rows += [(300, same, 1, 0.0, 0)] * 3 + [(7, same, 9, 0.0, 0)]  # a repeated anchor, and another row of a known id
    rows += [(2000, None, 1, 0.0, 0), (2100, [1.0, None], 1, 0.0, 0), (2200, [float("nan")], 1, 0.0, 0), (2300, [float("inf")], 1, 0.0, 0), (2400, [1.0], None, 0.0, 0), (None, [1.0], 1, 0.0, 0), (2500, [1e30, -1e30], 2, 0.0, 0)]
    return rows


def brute(rows, positives=5, negatives=10):
    most = H.MOST
    v = []
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = [max(-most, min(most, math.floor(256 * float(np.float32(c))))) for c in x]
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for n, (a, label, q) in enumerate(v):
        if a % 100:
            continue
        dot = lambda p, q=q: sum(x * y for x, y in zip(q, p, strict=False))
        scored = [(-dot(p), i, k) for m, (i, k, p) in enumerate(v) if m != n]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted((t, i) for t, i, k in scored if k != label and 30 * -s <= 100 * -t <= 90 * -s)[:negatives]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"a_size": 3, "size": 7, "width": 2, "shards": 3}, {"a_size": 1, "size": 50, "width": 1, "shards": 1}])
def test_mined_rows_equal_plain_search(spark, sizes):
    rows = made()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", label, "embedding")
    got = H.mine(ready, F.col("id") % 100 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_query_reads_the_table(spark, tmp_path):
    rows = made(400, 2)
    d = table(spark, tmp_path, "embeddings", spark.createDataFrame(rows, SCHEMA))
    assert sorted(tuple(r) for r in H.op11_hard_negatives(spark, d).collect()) == brute(rows)
    nothing = table(spark, tmp_path / "none", "embeddings", spark.createDataFrame([], SCHEMA))
    assert H.op11_hard_negatives(spark, nothing).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for most in (100, 1 << 22, 1 << 30):
        a, b = (rng.integers(-most, most, (5, 9), dtype=np.int64) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert H.product(a, b).tolist() == want


def test_too_many_dimensions_are_refused(spark):
    rows = spark.createDataFrame([(1, [1.0] * 2049, 1)], "id long, v array<double>, label int")
    with pytest.raises(ValueError, match="2049"):
        H.mine(H.usable(rows, "id", "label", "v"), F.lit(True))


def test_no_block_is_broadcast_and_cells_are_reduced(spark, monkeypatch):
    plans, staged, stage = [], {}, H.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        staged[label] = stage(df, label)
        return staged[label]

    monkeypatch.setattr(H, "stage", seen)
    rows = made(600, 3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    ready = H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", label, "embedding")
    got = H.mine(ready, F.col("id") % 100 == 0, a_size=3, size=7, width=2, shards=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert not any("Broadcast" in p for p in plans) and sum("SortMergeJoin" in p for p in plans) == 2
    assert staged["negative-candidates"].groupBy("a_block", "row", "slot").count().agg(F.max("count")).first()[0] <= 10 * 3  # a cell's, not a tile's


def test_more_groups_of_anchors_and_vectors_of_no_dimension(spark, monkeypatch):
    monkeypatch.setattr(H, "A_GROUP", 2)
    rows = [(i, x, k, None, None) for i, x, k, *_ in made(150, 4)]
    got = H.mine(H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding"), F.lit(True), a_size=9, size=11, width=3)
    kept = H.mine(H.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "label", "embedding"), F.lit(True), a_size=500, size=500)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in kept.collect()) != []
    empty = spark.createDataFrame([(i, [], i % 2) for i in range(20)], "id long, v array<double>, label int")
    found = H.mine(H.usable(empty, "id", "label", "v"), F.col("id") == 0).collect()
    assert sorted((r.positive_id, r.rank, r.negative_id) for r in found) == [(p, k + 1, 2 * k + 1) for p in (2, 4, 6, 8, 10) for k in range(10)]
