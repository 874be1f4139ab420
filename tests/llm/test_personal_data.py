"""Personal data against a plain search with Python's regular expressions, and against the SQL."""

import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import functions as F

from lakequarry.llm import personal_data as P

from .fixtures import documents, table


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def keeps(kind, text, a, b):
    m = text[a:b]
    n = len(re.sub("[^0-9]", "", m))
    apart = not re.search("[A-Za-z0-9+(.-]", text[a - 1 : a] if a else "") and not re.search("[A-Za-z0-9-]", text[b : b + 1])
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 12 <= n <= 19 and luhn(re.sub("[ -]", "", m))
    if kind == "phone":
        return 9 <= n <= 15
    if kind == "iban":
        code = m.replace(" ", "")
        return apart and 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    if kind == "ssn":
        return apart and not re.search("^(?:000|666|9)|-00-|-0000$", m)
    if kind == "tel":
        return apart and not re.search("[0-9)][ ]", text[a - 2 : a] if a > 1 else "")
    return True


def score(kind, text, a):
    near = text[max(0, a - 40) : a].lower()
    hit = lambda words: bool(re.search(rf"(?:^|[^a-z])(?:{words})(?:[^a-z]|$)", near))
    return P.PRIOR[kind] + 30 * hit(P.FOR[kind]) - 30 * hit(P.AGAINST[kind])


def brute(text):
    text, out = text or "", []
    for rank, (kind, pattern) in enumerate(P.PLAIN.items()):
        for m in re.finditer(pattern, text):
            if keeps(kind, text, *m.span()) and (rank < 4 or score(kind, text, m.start()) >= 60):
                out.append((m.start(), rank, m.end(), kind, score(kind, text, m.start())))
    return sorted(out)


def joined(spans):
    return ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)


ODD = [
    "a@b.c_d@e.f x@y..z @q.w a@b a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 99999999999.1.1.1", "4562298812442145, 4562 2988-1244 2145 4562298812442146 1 2 3", "+1 (935) 555-6637 +49 30 1234567 +12 +1----5 +123456789012345678",
    "iban GB82 WEST 1234 5698 7654 32 and DE89370400440532013000; GB82WEST12345698765431 XGB82WEST12345698765432", "my ssn: 123-45-6789 or 123-45-6789 far away from any such word that speaks for it", "social security 666-12-1234 000-12-1234 123-00-1234 078-05-1120",
    "call (212) 555-0123 or 212.555.0123 today; order 212 555 0123; 212-555-0123", "😀😀 mail 🙂x@y.zz é+1 555 555 5555é 數+886 2 2720 8889", "phone +1 555 555 5555 212-555-0123", "IBAN: FR14 2004 1010 0505 0001 3M02 606 CARD 4111-1111-1111-1111",
]


def rows(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("a@.1+2- 3(4)5 6-7.8") for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += [" ".join(f"u{i}@h{i % 7}.org 10.0.{i % 300}.{i % 256}" for i in range(900)), "a" * 3_000 + " 1" * 40_000 + "@x", ".".join("1" for _ in range(4_000)), "b@" + ".".join("c" for _ in range(60_000))]
    made = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, personal string")
    return documents(spark).withColumn("personal", F.lit("kept")).unionByName(made, allowMissingColumns=True)


def test_spans_equal_plain_search(spark, tmp_path):
    d = table(spark, tmp_path, "documents", rows(spark))
    for r in P.find_personal_data(spark.read.parquet(f"{d}/documents.parquet")).collect():
        assert [tuple(s) for s in r.personal] == brute(r.text), (r.text or "")[:200]
    for r in P.op12_personal_data(spark, d).collect():
        assert set(r.asDict()) >= {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}
    texts = {(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = sorted((i is not None, i or 0, joined(brute(t)), hashlib.sha256(joined([s for s in brute(t) if s[1] < 4]).encode()).hexdigest()) for i, t in texts)
    got = sorted({(r.doc_id is not None, r.doc_id or 0, r.spans, r.base_sha256) for r in P.op12_personal_data(spark, d).collect()})
    assert got == sorted(set(want))


def test_each_checksum_and_word_counts(spark):
    kinds = {k: {s[3] for t in ODD for s in brute(t) if s[3] == k} for k in P.PLAIN}
    assert all(kinds.values())  # the fixture holds every kind
    no_word = [s for s in brute(ODD[5]) if s[3] == "ssn"]
    assert len(no_word) == 1 or all(s[4] >= 60 for s in no_word)


def test_redact(spark):
    df = spark.createDataFrame([("write to x@y.org or +1 555 555 5555!",), ("",), (None,)], "text string")
    got = [r[0] for r in P.find_personal_data(df).select(P.redact(F.coalesce("text", F.lit("")), F.col("personal"))).collect()]
    assert got == ["write to [email] or [phone]!", "", ""]


def test_sql(spark, tmp_path):
    d = table(spark, tmp_path, "documents", rows(spark).where("length(text) < 60000 OR text IS NULL"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    asked = con.execute(P.SQL)
    names = [c[0] for c in asked.description]
    want = sorted(map(repr, asked.fetchall()))
    assert sorted(repr(tuple(r)) for r in P.op12_personal_data(spark, d).select(names).collect()) == want


def test_empty_and_long_runs_are_quick(spark):
    empty = documents(spark).limit(0)
    assert P.find_personal_data(empty).count() == 0
    began = time.time()
    long = spark.createDataFrame([("a" * 2_000_000 + "@" + "1" * 200_000,)], "text string")
    assert P.find_personal_data(long).select(F.size("personal")).first()[0] == 0
    assert time.time() - began < 30
