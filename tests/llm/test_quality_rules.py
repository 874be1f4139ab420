import re
from collections import Counter

import duckdb

from lakequarry.llm import quality_rules as Q

from .fixtures import documents, table

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_matches_brute_force(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark))
    got = sorted((r.doc_id is None, r.doc_id, *(r[n] for n in NAMES)) for r in Q.op1_quality_rules(spark, d).collect())
    want = sorted((r.doc_id is None, r.doc_id, *brute(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    assert got == want


def test_matches_sql(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, Q.op1_quality_rules(spark, d).collect()), key=key)
    assert got == sorted(duckdb.sql(Q.SQL).fetchall(), key=key)


def test_order_changes_no_verdict(spark):
    docs = documents(spark)
    base, rules = Q.base_stats(docs), (*Q.BASE_RULES, *Q.RULES)
    kept = [[r[0] for r in base.select(Q.cascade(own, Q.Counted()).isNull()).collect()] for own in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    ordered = Q.order_rules(docs)
    assert {x["rule"].name for x in ordered} == {r.name for r in rules}
    rate = [(x["rejection"] + 1e-6) / x["cost_s"] for x in ordered]
    assert rate == sorted(rate, reverse=True)


def test_filter_agrees_with_the_counted_statistics(spark):
    docs = documents(spark, 300)
    key = lambda rows: sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in rows)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r for r in Q.apply_rules(docs).where("kept").collect()]
    assert key(kept.collect()) == key(want) and 0 < len(want) < docs.count()


def test_no_python_and_empty_table(spark, tmp_path):
    d = table(spark, tmp_path, "documents", documents(spark).limit(0))
    out = Q.op1_quality_rules(spark, d)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
