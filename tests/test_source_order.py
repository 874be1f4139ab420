"""Rows of several files keep their source's order, whatever Spark makes of the files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakequarry.errors import Refused
from lakequarry.sources import delimited, order, snapshots

ABOUT = {"fetched_at": "2026-01-01T00:00:00Z", "validated_at": "2026-01-02T00:00:00Z", "coverage": {"scope": "all", "complete": True}, "parser_version": "1", "validator_version": "1"}


def store(root, parts, swap=None):
    """A snapshot whose parts are lists of ids by key, in that order."""
    listed = []
    for key, ids in parts.items():
        text = "".join(json.dumps({"id": i}) + "\n" for i in ids)
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text(text)
        listed.append({"key": key, "sha256": hashlib.sha256(text.encode()).hexdigest(), "record_count": len(ids)})
    if swap:
        listed[swap[0]], listed[swap[1]] = listed[swap[0]] | {"key": listed[swap[1]]["key"]}, listed[swap[1]] | {"key": listed[swap[0]]["key"]}
    digest = snapshots.listing_hash(p["sha256"] for p in listed)
    manifest = json.dumps({"schema_version": "2.0", "dataset_id": "d", "snapshot_id": "s1", "normalized_key": "verified/d/s1/parts", "normalized_sha256": digest, "validation_status": "passed", "revoked": False, "record_count": sum(map(len, parts.values())), "parts": listed} | ABOUT)
    (root / "verified/d/s1/manifest.json").write_text(manifest)
    (root / "releases/d").mkdir(parents=True, exist_ok=True)
    (root / "releases/d/active.json").write_text(json.dumps({"manifest_key": "verified/d/s1/manifest.json", "manifest_sha256": hashlib.sha256(manifest.encode()).hexdigest()}))


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, root):
    return [r.id for r in snapshots.load(spark, str(root), "d", "id string").records.orderBy("_pos").collect()]


def test_small_parts_before_large_ones(spark, tmp_path):
    parts = {"verified/d/s1/a.json": [f"L{i}" for i in range(3)], "verified/d/s1/b.json": [f"L{i}" for i in range(3, 60)], "verified/d/s1/0.json": ["L60"]}
    store(tmp_path, parts)
    assert read(spark, tmp_path) == [f"L{i}" for i in range(61)]
    found = snapshots.load(spark, str(tmp_path), "d", "id string").records
    assert sorted(r._pos for r in found.collect()) == list(range(61))


def test_split_files_and_equal_names(spark, tmp_path, small_splits):
    parts = {"verified/d/s1/x/p 1+%.json": [f"a{i}" for i in range(100)], "verified/d/s1/y/p 1+%.json": ["b"], "verified/d/s1/empty.json": [], "verified/d/s1/w/p.json": [f"c{i}" for i in range(150)]}
    store(tmp_path, parts)
    assert spark.read.text(str(tmp_path / "verified/d/s1/w/p.json")).rdd.getNumPartitions() > 2
    assert read(spark, tmp_path) == [i for ids in parts.values() for i in ids]


def test_parts_in_each_others_place_or_twice_are_refused(spark, tmp_path):
    parts = {"verified/d/s1/a.json": ["1", "2"], "verified/d/s1/b.json": ["3", "4"]}
    store(tmp_path, parts, swap=(0, 1))
    with pytest.raises(Refused, match="differs"):
        read(spark, tmp_path)
    m = {"parts": [{"key": "verified/d/s1/a.json", "sha256": "0" * 64, "record_count": 1}] * 2, "normalized_sha256": "0" * 64, "record_count": 2}
    with pytest.raises(Refused, match="twice"):
        snapshots._part_records(spark, str(tmp_path), m, "d", None)


def test_published_parts_come_back_in_order(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"), F.expr("repeat('x', cast(id % 50 as int))").alias("pad"))
    digest = snapshots.publish(rows.repartition(5), str(tmp_path), "d", "s7", ["id"], ABOUT, rows_a_part=90)
    found = snapshots.load(spark, str(tmp_path), "d", "id string, pad string")
    assert found.manifest["normalized_sha256"] == digest and len(found.manifest["parts"]) > 8
    assert [(r._pos, r.id) for r in found.records.orderBy("_pos").collect()] == [(i, f"k{i:04}") for i in range(1000)]


def test_parts_without_an_order_or_in_their_own(spark, tmp_path):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("id"))
    snapshots.publish(rows.repartition(5), str(tmp_path / "a"), "d", "s1", [], ABOUT, rows_a_part=90)
    snapshots.publish(rows.repartitionByRange(3, "id").sortWithinPartitions("id"), str(tmp_path / "b"), "d", "s1", ["id"], ABOUT, rows_a_part=90, ordered=True)
    unordered, ordered = (snapshots.load(spark, str(tmp_path / k), "d", "id string") for k in "ab")
    assert len(unordered.manifest["parts"]) == 15 and sorted(r.id for r in unordered.records.collect()) == [f"k{i:04}" for i in range(1000)]
    assert sorted(r._pos for r in unordered.records.collect()) == list(range(1000))
    assert [(r._pos, r.id) for r in ordered.records.orderBy("_pos").collect()] == [(i, f"k{i:04}") for i in range(1000)]


def test_tables_of_several_files(spark, tmp_path, small_splits):
    lines = {"b.csv": [f"n{i},{i + 1}" for i in range(3)], "a.csv": [f"m{i},{i + 1}" for i in range(90)]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("科目,預算數\n" + "\n".join(rows) + "\n", encoding="utf-8")
    both = [str(tmp_path / n) for n in lines]
    want = [r.split(",")[0] for rows in lines.values() for r in rows]
    assert [r.name for r in delimited.read_csv(spark, both).orderBy("_pos").collect()] == want
    assert [r.name for r in delimited.read_csv(spark, both[1]).orderBy("_pos").collect()] == want[3:]
    (tmp_path / "l").mkdir()
    (tmp_path / "l/z.json").write_text("\n".join(json.dumps({"科目": f"z{i}", "預算數": i + 1}, ensure_ascii=False) for i in range(60)), encoding="utf-8")
    (tmp_path / "l/y.json").write_text(json.dumps({"科目": "y", "預算數": 1}, ensure_ascii=False), encoding="utf-8")
    assert [r.name for r in delimited.read_json_lines(spark, str(tmp_path / "l")).orderBy("_pos").collect()] == ["y"] + [f"z{i}" for i in range(60)]
    shown = order.in_source_order(spark.read.text(str(tmp_path / "l"))).orderBy("_pos")
    assert [r._pos for r in shown.collect()] == list(range(61))
