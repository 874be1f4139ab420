import random
from functools import lru_cache

import numpy as np

import corpus_pipeline as P
from lakequarry.llm import kneser_ney as K
from lakequarry.llm import quality_rules as Q
from lakequarry.llm import simhash as S

from .fixtures import documents, table


def texts(n=90):
    """Groups of copies with a few changed words, and single texts."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    out = []
    while len(out) < n:
        base = [word() for _ in range(rng.choice([60, 200, 500]))]
        for _ in range(rng.choice([1, 1, 3, 8])):
            w = list(base)
            for _ in range(len(base) // 200):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


@lru_cache(maxsize=None)
def shingles(text):
    w = text.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def kept_by_brute_force(rows):
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {find(i) for i in range(len(rows))}


def test_near_duplicates_match_brute_force_also_in_crowded_buckets(spark):
    rows = texts()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for most in (1024, 4):
        assert {r.doc_id for r in S.drop_near_duplicates(docs, most_in_bucket=most).collect()} == kept_by_brute_force(rows), most


def test_distances_of_any_radius():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, (130, 4), dtype=np.uint64)
    values[1::2] = values[::2]
    for i in range(1, 130, 2):
        for b in rng.choice(256, rng.integers(0, 60), replace=False):
            values[i, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    planes = S.planes_of(values)
    distance = lambda x, y: sum(bin(int(a ^ b)).count("1") for a, b in zip(x, y, strict=True))
    for radius in (0, 1, 7, 48):
        for block in range(3):
            found = S.near(values, planes, np.full(130, block), np.full(130, 0xFFFFFFFFFFFFFFFF, np.uint64), radius)
            assert all(bool(found[q] >> np.uint64(i) & np.uint64(1)) == (distance(values[q], values[64 * block + i]) <= radius) for q in range(130) for i in range(64) if 64 * block + i < 130)


def test_stages_keep_columns_and_their_decisions_hold(spark, tmp_path):
    docs = documents(spark)
    d = table(spark, tmp_path, "documents", docs)
    table(spark, tmp_path, "labels", spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int"))
    read = spark.read.parquet(f"{d}/documents.parquet")
    now = read
    for _, stage in P.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == read.columns
    good = P.quality_classifier(spark, read, d)
    judged = K.classify(read.select("doc_id", "lang", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    assert good.count() == judged.where("kept").count() and good.where("text IS NULL").count() == 0
    after = P.rules(spark, good, d)
    assert after.count() == Q.apply_rules(good.select("doc_id", "text")).where("kept").count() < good.count()
    kept = P.near_duplicates(spark, after, d)
    assert kept.count() == after.select("text").distinct().count() - after.where("doc_id IN (103, 104)").count() // 2
    pieces = P.run(spark, d).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in kept.collect()} and all(p.length * 4 == len(p.ids) for p in pieces)


def test_empty_table(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark).limit(0))
    table(spark, tmp_path, "labels", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert P.run(spark, d).count() == 0


def graded(n_groups=60):
    """Pairs of 40 to 400 words whose similarities lie between 0.5 and 0.95."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    out = []
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([40, 150, 400]))]
        wanted = 0.5 + 0.45 * g / n_groups
        w = list(base)
        while jaccard(" ".join(base), " ".join(w)) > wanted:
            w[rng.randrange(len(w))] = word()
        out += [" ".join(base), " ".join(w)]
    return out


def test_only_pairs_of_the_similarity_are_removed(spark):
    rows = graded()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    same = [jaccard(rows[i], rows[i + 1]) for i in range(0, len(rows), 2)]
    gone = set(range(len(rows))) - {r.doc_id for r in S.drop_near_duplicates(docs).collect()}
    false = [j for k, j in enumerate(same) if j < 0.8 and {2 * k, 2 * k + 1} & gone]
    missed = [j for k, j in enumerate(same) if j >= 0.8 and 2 * k + 1 not in gone]
    assert not false and not missed, (false, missed)


def test_texts_of_one_fingerprint_but_different_words_stay(spark):
    rows = ["a " * 400 + " ".join(f"{w}{k}" for k in range(60)) for w in ("x", "y")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert S.drop_near_duplicates(docs).count() == 2


def test_crowded_fingerprints_near_to_one_member_only_are_linked(spark, monkeypatch):
    """Two groups of 400 around centres far apart, and chains that lead from one member of each to ever farther fingerprints."""
    rng = np.random.default_rng(5)
    radius = S.radius_for(0.8)[0]

    def changed(v, bits):
        out = v.copy()
        for b in bits:
            out[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
        return out

    values = []
    for group in range(2):
        centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
        free = rng.permutation(256)
        values += [changed(centre, rng.choice(free, 20, replace=False)) for _ in range(400)]
        for _ in range(10):
            v, order = values[-1 - rng.integers(300)], rng.permutation(free)
            for step in range(3):
                v = changed(v, order[step * radius : (step + 1) * radius])
                values.append(v)
    values = np.array(values)
    near = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2) <= radius
    want = np.arange(len(values))
    while (after := np.where(near, want, len(values)).min(axis=1)).tolist() != want.tolist():
        want = after
    distinct = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(values)], "node long, fp binary")
    monkeypatch.setattr(S, "buckets", lambda df, *_: df.selectExpr("7L bucket", "node", "fp"))
    found = {r.node: r.root for r in S.components(S.similar_links(distinct, most_in_bucket=100)).collect()}
    assert [found.get(k, k) for k in range(len(values))] == want.tolist() and len(set(want.tolist())) < 60


def test_a_text_group_above_the_pivots_matches_brute_force(spark):
    """150 copies of one text with a few words changed, copies of single copies, and a second group at about 0.7 of the first."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))

    def changed(text, n):
        w = text.split()
        for k in rng.sample(range(len(w)), n):
            w[k] = word()
        return " ".join(w)

    base = " ".join(word() for _ in range(250))
    rows = [changed(base, rng.randrange(1, 4)) for _ in range(150)]
    rows += [changed(rows[rng.randrange(150)], rng.choice([4, 5, 6, 7])) for _ in range(30)]
    rows += [changed(changed(base, 10), rng.randrange(2)) for _ in range(20)]
    words = [r.split() for r in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    near = np.array([[len(x & y) / len(x | y) >= 0.8 for y in sets] for x in sets])
    want = np.arange(len(rows))
    while (after := np.where(near, want, len(rows)).min(axis=1)).tolist() != want.tolist():
        want = after
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.drop_near_duplicates(docs, most_in_bucket=16).collect()} == set(want.tolist())
