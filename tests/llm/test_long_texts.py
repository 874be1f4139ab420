"""Texts of 300,000 characters and more, whole, through the operators whose fixtures hold shorter ones."""

import math
import random

import numpy as np

from lakequarry.llm import kneser_ney as K
from lakequarry.llm import license_scan as L
from lakequarry.llm import packing as P
from lakequarry.llm import quality_rules as Q
from lakequarry.llm import toxicity as T
from lakequarry.llm.byte_bpe import ByteBpe

from . import test_kneser_ney as kneser_ney_tests
from . import test_quality_rules as rules_tests
from .fixtures import table


def long_text(seed=1, n=60_000):
    rng = random.Random(seed)
    words = ["harbour", "stone", "été", "größe", "light", "paper", "x", "A-1"] + ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5_000)]
    return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")


def test_quality_rules(spark, tmp_path):
    text = long_text()
    assert len(text) > 300_000
    d = table(spark, tmp_path, "documents", docs(spark, text, text + " one two three four five" * 2, "short"))
    for r in Q.op1_quality_rules(spark, d).collect():
        own = {0: text, 1: text + " one two three four five" * 2, 2: "short"}[r.doc_id]
        assert tuple(r[n] for n in rules_tests.NAMES) == rules_tests.brute(own)


def test_packing(spark):
    text = long_text(2)
    pieces = sorted(P.pack(docs(spark, text, "short")).where("doc_id = 0").collect(), key=lambda r: r.start)
    ids = np.frombuffer(b"".join(bytes(p.ids) for p in pieces), "<u4").tolist()
    assert ids == [*np.frombuffer(ByteBpe().ids_of(text), "<u4").tolist(), P.END] and len(pieces) > 40


def test_classifier(spark):
    text, trained = long_text(3), [long_text(4, 3_000), "harbour stone light"]
    found = K.score(docs(spark, text, "paper stone"), docs(spark, *trained)).collect()
    want = kneser_ney_tests.brute([text, "paper stone"], trained)
    assert all(math.isclose(r.log_ppl, want[r.doc_id], rel_tol=1e-4) for r in found) and len(found) == 2


def test_licenses(spark):
    name, template = next(iter(L.TEMPLATES.items()))
    text = long_text(5)
    found = L.scan_licenses(docs(spark, text, text[:150_000] + " " + template + " " + text[150_000:])).collect()
    assert {r.doc_id: [m.license for m in r.licenses] for r in found} == {0: [], 1: [name]}


def test_toxicity():
    model = T.Model({" snark": 2.0}, (0.0, 1.0, 0.0, 0.0))
    text = "river stone " * 40_000
    assert T.match(model.automaton(), text + "snarkface " + text) == (2.0, 1, 160_001)
