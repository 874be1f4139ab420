"""The list of records within JSON documents against a search over decoded objects."""

import json
import random

import pytest

from lakequarry.errors import Refused
from lakequarry.sources import delimited, json_records


def search(value, depth=5):
    """The same rules over objects."""
    if depth < 0:
        return None
    if isinstance(value, list):
        objects = [x for x in value if isinstance(x, dict)]
        if any(any(k in delimited.NAME_COLUMNS for k in r) and any(k in delimited.AMOUNT_COLUMNS for k in r) for r in objects):
            return objects
        inner = value
    elif isinstance(value, dict):
        inner = [*(value[k] for k in delimited.LIST_KEYS if k in value), *value.values()]
    else:
        return None
    return next((x for x in (search(v, depth - 1) for v in inner) if x is not None), None)


def found(text):
    try:
        return list(json_records.records(text, delimited._has_both(delimited.NAME_COLUMNS, delimited.AMOUNT_COLUMNS), delimited.LIST_KEYS, delimited.DEPTH))
    except json_records.NoJson:
        return None


def any_value(rng, depth):
    kind = rng.randrange(9 if depth else 5)
    if kind < 5:
        return [None, True, -1.5e3, 'a "q" \\ ]}{[ ,:é\n', "甲"][kind]
    if kind < 7:
        return [any_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = ["data", "Records", "x", "科目", "預算數", "科目名稱", 'k"]}']
    return {rng.choice(keys): any_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_same_records_as_over_objects():
    rng, some = random.Random(3), 0
    for _ in range(4000):
        value = any_value(rng, 7)
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        want = search(value)
        some += want is not None
        assert found(text) == want, text
    assert some > 30


@pytest.mark.parametrize("bad", ["", "[", '{"a": [1, 2}', "[1 2]", '{"a" 1}', '[{"科目": "x", "預算數": 1}] x', '{"a": }', "[1,]", '["a', "[{'科目': 1}]"])
def test_broken_documents(bad):
    assert found(bad) is None


def test_large_document_is_read_by_an_executor(spark, tmp_path):
    n = 200_000
    with (tmp_path / "b.json").open("w", encoding="utf-8") as f:
        f.write('﻿{"meta": {"data": [1, {"科目": "no amount"}]}, "result": [')
        f.writelines(f'{"," if i else ""} {{"Seq": {i}, "科目名稱": "n{i}", "本年度預算數": "{i:,}", "note": "{{[ \\" x"}}\n' for i in range(n))
        f.write("]}")
    rows = delimited.read_budget(spark, str(tmp_path / "b.json"))
    assert rows.count() == n and rows.agg({"amount": "sum"}).first()[0] == n * (n - 1) / 2
    assert [r.name for r in rows.orderBy("_pos").limit(3).collect()] == ["n0", "n1", "n2"]
    (tmp_path / "c.json").write_text('{"data": [{"a": 1}]}')
    with pytest.raises(Refused, match="SOURCE_SCHEMA_CHANGED"):
        delimited.read_budget(spark, str(tmp_path / "c.json"))
