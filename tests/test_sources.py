import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lakequarry.errors import Refused
from lakequarry.functions import numbers, text
from lakequarry.operators import totals
from lakequarry.sources import delimited, snapshots


def store(root, change=lambda m: m, records=()):
    data = json.dumps(list(records))
    m = change({
        "schema_version": "2.0", "dataset_id": "d", "snapshot_id": "s1", "normalized_key": "verified/d/s1/normalized.json", "normalized_sha256": hashlib.sha256(data.encode()).hexdigest(), "fetched_at": "2026-01-01T00:00:00Z",
        "validated_at": "2026-01-02T00:00:00Z", "validation_status": "passed", "revoked": False, "record_count": len(records), "coverage": {"scope": "all", "complete": True}, "parser_version": "1", "validator_version": "1",
    })
    shown = json.dumps(m)
    pointer = {"manifest_key": "verified/d/s1/manifest.json", "manifest_sha256": hashlib.sha256(shown.encode()).hexdigest()}
    for key, value in (("releases/d/active.json", json.dumps(pointer)), ("verified/d/s1/manifest.json", shown), ("verified/d/s1/normalized.json", data)):
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text(value)
    return str(root)


def test_snapshots(spark, tmp_path):
    found = snapshots.load(spark, store(tmp_path / "a", records=[{"id": "x"}, {"id": "y"}]), "d", "id string")
    assert [(r._pos, r.id) for r in found.records.orderBy("_pos").collect()] == [(0, "x"), (1, "y")]
    for n, (change, code) in enumerate([({"validation_status": "pending"}, "SNAPSHOT_UNVERIFIED"), ({"revoked": True}, "SNAPSHOT_REVOKED"), ({"record_count": 7}, "SNAPSHOT_UNVERIFIED")]):
        with pytest.raises(Refused) as e:
            snapshots.load(spark, store(tmp_path / f"b{n}", lambda m, c=change: m | c), "d", "id string")
        assert e.value.reason_code == code
    with pytest.raises(Refused):
        snapshots.load(spark, str(tmp_path / "none"), "d", "id string")


def test_budget_csv(spark, tmp_path):
    rows = [("合計", "197,823,502"), ("甲", "938,407"), ("乙", "61,864,076"), ("丙", "938,407")]
    (tmp_path / "b.csv").write_text("﻿Seq,科目名稱,本年度預算數\n" + "\n".join(f'{i},{n},"{a}"' for i, (n, a) in enumerate(rows)), encoding="utf-8")
    r = totals.checked_summary(delimited.read_budget(spark, str(tmp_path / "b.csv"))).first()
    assert (r.agency_count, r.agency_sum, r.official_total, r.highest_name, r.lowest_name) == (3, 63740890.0, 197823502.0, "乙", "甲")


def test_large_snapshot_arrays_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delimited, "MOST_JSON", 10)
    with pytest.raises(Refused) as e:
        snapshots.load(spark, store(tmp_path / "a", records=[{"id": "x"}, {"id": "y"}]), "d", "id string")
    assert e.value.reason_code == "SOURCE_TOO_LARGE" and "parts" in str(e.value)


def test_entities_and_amounts(spark):
    df = spark.createDataFrame([("&#x4e2d;&#65;&amp;lt; b",)], "t string")
    assert df.select(text.decode_entities(F.col("t"))).first()[0] == "中A< b"
    df = spark.createDataFrame([("1,234.5",), ("1d",), ("NaN",), ("0x10",), (None,)], "t string")
    assert [r[0] for r in df.select(numbers.parse_amount(F.col("t"))).collect()] == [1234.5, None, None, 16.0, None]


def test_white_space_at_the_ends_in_time_that_grows_with_the_text(spark):
    space = "\t\n\x0b\f\r \u00a0\u1680\u2000\u200a\u2028\u202f\u205f\u3000\ufeff"
    rng = random.Random(3)
    texts = ["", " ", "\n\n", "x \u0085", *("".join(rng.choice("ab,，道😀" + space[:4] + rng.choice(space)) for _ in range(rng.randrange(9))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    found = df.select(text.strip(F.col("t")).alias("s"), text.filled(F.col("t")).alias("f"), text.without_trailing_separators(F.col("t")).alias("w")).collect()
    for t, r in zip([*texts, None], found, strict=True):
        if t is None or "\u0085" in t:
            continue
        assert (r.s, r.f, r.w) == (t.strip(space), bool(t.strip(space)), t.rstrip(space + ",，")), repr(t)
    assert (found[-1].s, found[-1].f) == (None, None)
    began = time.monotonic()
    long = spark.range(8).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 300_000), F.lit("b")).alias("t"))  # each run read again from each of its places: 4.5e10 steps a text
    assert long.where(text.filled(F.col("t")) & (F.length(text.strip(F.col("t"))) == 300_002) & (F.length(text.without_trailing_separators(F.col("t"))) == 300_002)).count() == 8
    assert time.monotonic() - began < 20
