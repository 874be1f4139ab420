import math
import zlib
from collections import Counter

import numpy as np

from lakequarry.llm import toxicity as T

from .fixtures import documents, table


def labelled(spark):
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = ["river", "stone", "light", "paper", f"word{i % 7}"] * 8
        if toxic:
            words[3:3] = [("grumble", "snarkface", "gr0mmel")[i % 3]] * 2
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "river sn4rkf\u0430ce stone light"), (1003, "SNARKFACE, paper and light"), (None, "snarkface river")]
    labels += [(1000, 1, None), (None, 1, 1), (1002, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_query_learns_and_scores(spark, tmp_path):
    docs, labels = labelled(spark)
    d = table(spark, tmp_path, "documents", docs)
    table(spark, tmp_path, "labels", labels)
    rows = T.op9_toxicity(spark, d).collect()
    assert len(rows) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert all(by[i].predicted == (i % 4 == 0) for i in range(400))
    assert by[1002].predicted and by[1003].predicted and by[None].predicted and not by[1000].predicted and by[1000].score == by[1001].score


def test_folding_exceptions_and_matches():
    assert T.fold("Ｉdi0T, СLОWN!\n1d10t") == " idiot clown idiot " and T.fold(None) == "  "
    model = T.Model({" clown ": 2.0, " grum": 3.0, " grumble ": 4.0}, (0.0,) * 4, ("clown fish",))
    a = model.automaton()
    assert T.match(a, "clown grumbling grumble clowns") == (9.0, 3, 4)
    assert T.match(a, "a clown fish") == (0.0, 0, 3) and T.match(a, "clown, fish clown") == (2.0, 1, 3)
    assert T.match(a, "") == (0.0, 0, 0)


def test_matches_brute_force():
    rng = np.random.default_rng(4)
    model = T.Model({" ab": 1.0, " abc ": 2.5, " ca ": 1.5, " bb": 0.5}, (0.0,) * 4, exceptions=("ca ab",))
    a = model.automaton()
    for _ in range(300):
        words = ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(rng.integers(1, 9))]
        weights = [max([w for p, w in model.weights.items() if f" {x} ".startswith(p)], default=0) for x in words]
        for i in range(len(words) - 1):
            if words[i] == "ca" and words[i + 1] == "ab":
                weights[i] = weights[i + 1] = 0
        assert T.match(a, " ".join(words)) == (sum(weights), sum(w > 0 for w in weights), len(words))


def test_without_labels_and_empty(spark, tmp_path):
    docs, labels = labelled(spark)
    d = table(spark, tmp_path, "documents", docs)
    table(spark, tmp_path, "labels", labels.limit(0))
    assert {r.score for r in T.op9_toxicity(spark, d).collect()} == {0.0}
    table(spark, tmp_path, "documents", documents(spark).limit(0))
    assert T.op9_toxicity(spark, d).count() == 0


def fit_by_hand(rows, min_ratio=8.0, lexicon=400, exception_ratio=2.0):
    """Lexicon and exceptions of rows (text, toxic), from counts in plain Python."""
    n, d, total = {True: Counter(), False: Counter()}, Counter(), Counter()
    for text, toxic in rows:
        words = T.fold(text).split()
        total[toxic] += len(words)
        for w in words:
            n[toxic].update(T.features(w))
        if toxic:
            d.update({f for w in words for f in T.features(w)})
    n_toxic = sum(t for _, t in rows)
    gains = []
    for f, k in d.items():
        ratio = ((n[True][f] + 0.5) / total[True]) / ((n[False][f] + 0.5) / total[False])
        if k >= max(5, n_toxic // 50) and ratio >= min_ratio:
            gains.append((-round(n[True][f] * math.log(ratio), 6), -len(f), f, math.log(ratio)))
    weights = {}
    for _, _, f, w in sorted(gains):
        if len(weights) < lexicon and not any(f.startswith(x) or x.startswith(f) for x in weights):
            weights[f] = w
    t, o = Counter(), Counter()
    for text, toxic in rows:
        words = T.fold(text).split()
        hit = [any(f" {w} ".startswith(p) for p in weights) for w in words]
        (t if toxic else o).update({f"{words[i]} {words[i + 1]}" for i in range(len(words) - 1) if hit[i] or hit[i + 1]})
    n_other = len(rows) - n_toxic
    return weights, {p for p, k in o.items() if k >= max(3, n_other // 500) and k / n_other >= (t[p] + 0.5) * exception_ratio / n_toxic}


def test_fit_matches_counts_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        words = [f"w{chr(97 + int(x))}rd" for x in rng.integers(0, 26, 30)]
        if i % 5 == 0:
            words[4:4] = ["grumble", "snarkface"] * 3
        elif i % 2 == 0:
            words[4:4] = ["grumble", "fish"]
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    used = [(x, t == 1) for i, x, t in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    weights, exceptions = fit_by_hand(used)
    assert model.weights.keys() == weights.keys() and all(math.isclose(model.weights[f], w) for f, w in weights.items())
    assert set(model.exceptions) == exceptions


def test_learned_exceptions_excuse_matches(spark):
    rows = [(i, "stone river grumble fish light paper " + ("grumble grumble snarkface" if i % 5 == 0 else "paper") + f" word{i % 9}", int(i % 5 == 0)) for i in range(500)]
    rows += [(i, "a plain text without any of it, of a few more words than that", 0) for i in range(500, 6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), min_ratio=2.0)
    found = {r.doc_id: r for r in T.score_toxicity(df.select("doc_id", "text"), model).collect()}
    assert all(found[i].predicted == t for i, _, t in rows)


def test_accuracy_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    judged = T.op9_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in judged.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) >= 0.9 and n.get((0, 1), 0) / n[0, 0] <= 0.02, n


def test_exceptions_are_learned_from_the_given_tables(spark):
    d = "/root/testdata/sf0.1"
    model = T.fit(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
    assert model.exceptions and len(model.weights) >= 20
