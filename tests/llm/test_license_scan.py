import random
import re

import duckdb

from lakequarry.llm import license_scan as L

from .fixtures import documents, table


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(text, templates, share=0.8):
    own = shingles(text)
    found = [(n, len(own & shingles(t)), len(shingles(t))) for n, t in sorted(templates.items())]
    return [x for x in found if x[1] >= share * x[2]]


def planted(n=120):
    rng = random.Random(8)
    prose = lambda k: " ".join(rng.choice(["stone", "river", "of", "the", "License", "été", "under"]) for _ in range(k))
    out = []
    for i in range(n):
        name, text = rng.choice(sorted(L.TEMPLATES.items()))
        w = text.split()
        if i % 3 == 1 and len(w) > 30:
            w[rng.randrange(len(w))] = "changed"
        if i % 3 == 2 and len(w) > 40:
            w[5:9] = []
        out.append((i, prose(rng.randrange(0, 60)) + (",\n" if i % 2 else " ") + (" " if i % 4 else "\n").join(w).upper() + "\n" + prose(rng.randrange(0, 60))))
    out += [(n, " ".join([*L.TEMPLATES.values(), *L.TEMPLATES.values()])), (n + 1, None), (n + 2, ""), (n + 3, "under the MIT License"), (n + 4, "x " * 50_000 + "released under the mit license")]
    return out


def test_matches_brute_force(spark):
    rows = planted()
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in rows], "doc_id long, text string, licenses string, h int")
    got = {r.doc_id: [tuple(m) for m in r.licenses] for r in L.scan_licenses(df).collect()}
    assert got == {i: brute(t, L.TEMPLATES) for i, t in rows}
    assert sum(map(len, got.values())) > 110


def test_other_templates_and_share(spark):
    own = {"a": "one two three four five six seven eight nine ten", "b": "one two three four five", "c": " ".join(f"w{i}" for i in range(300))}
    texts = [" ".join(own.values()), own["a"][:-4], " ".join(f"w{i}" for i in range(60, 300)), " ".join(f"w{i}" for i in range(20, 300)) + " one two three four five"]
    for share in (0.5, 0.8, 1.0):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: [tuple(m) for m in r.licenses] for r in L.scan_licenses(df, own, share).collect()}
        assert got == {i: brute(t, own, share) for i, t in enumerate(texts)}
    assert all(r.licenses == [] for r in L.scan_licenses(df, {}).collect())


def test_bounds():
    assert all(L.miss_bound(len(shingles(t))) < 0.001 for t in L.TEMPLATES.values())
    assert len({c >> 60 for c in L.constants()}) == L.BANDS


def test_query_matches_sql(spark, tmp_path):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in planted(30)], "doc_id long, text string")
    d = table(spark, tmp_path, "documents", documents(spark).unionByName(extra, allowMissingColumns=True))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = L.op4_license_scan(spark, d)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(con.execute(L.SQL).fetchall(), key=key)
    assert not [x for x in ("Python", "Pandas", "Arrow", "Exchange", "Join") if x in got._jdf.queryExecution().executedPlan().toString()]
    assert L.op4_license_scan(spark, table(spark, tmp_path, "documents", documents(spark).limit(0))).count() == 0
