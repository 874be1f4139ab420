"""The list of records within a JSON document, found and read by the task that reads the file, whatever the document's size (a file of 2 GB at most).

A document is never built as objects: values are skipped by their brackets and strings, and only places in the text are kept, 16 bytes a record. The first list that qualifies, depth first, gives its records, which are decoded one by one.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"[ \t\r\n]*")
STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
MARK = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{}]', re.S)
PLAIN = re.compile(r"-?\d[\d.eE+-]*|true|false|null|NaN|-?Infinity")
Places = array  # starts and ends by turns


class NoJson(ValueError):
    """What is wrong with a document."""


def _after_space(text: str, at: int) -> int:
    return SPACE.match(text, at).end()


def end_of(text: str, at: int) -> int:
    """Where the value that begins at a place ends."""
    if text[at : at + 1] in ("[", "{"):
        depth = 0
        for m in MARK.finditer(text, at):
            if m[0] in "[{":
                depth += 1
            elif m[0] in "]}":
                depth -= 1
                if not depth:
                    return m.end()
        raise NoJson("a bracket is not closed")
    m = (STRING if text[at : at + 1] == '"' else PLAIN).match(text, at)
    if not m:
        raise NoJson(f"no value at {at}")
    return m.end()


def _separated(text: str, at: int, close: str, part: Callable[[int], int]) -> Iterator[int]:
    """Places of the parts between an opening bracket at `at` and the closing one; part(place): where one ends."""
    at = _after_space(text, at + 1)
    if text[at : at + 1] == close:
        return
    while True:
        yield at
        at = _after_space(text, part(at))
        mark, at = text[at : at + 1], _after_space(text, at + 1)
        if mark == close:
            return
        if mark != ",":
            raise NoJson(f"no comma at {at}")


def elements(text: str, at: int) -> Places:
    found = array("q")
    for a in _separated(text, at, "]", lambda a: found[-1]):
        found.extend((a, end_of(text, a)))
    return found


def members(text: str, at: int) -> dict[str, int]:
    """Places of an object's values by key, in the order of the keys' first places; of a repeated key the last counts."""
    found: dict[str, int] = {}
    ends = [0]
    for a in _separated(text, at, "}", lambda a: ends[0]):
        key = STRING.match(text, a)
        colon = _after_space(text, key.end()) if key else 0
        if not key or text[colon : colon + 1] != ":":
            raise NoJson(f"no key at {a}")
        value = _after_space(text, colon + 1)
        found[json.loads(key[0], strict=False)], ends[0] = value, end_of(text, value)
    return found


def find(text: str, at: int, has_both: Callable[[dict], bool], first_keys: tuple[str, ...], depth: int) -> Places | None:
    """Places of the objects of the first list, at most depth levels down, with an object that has_both() accepts by its keys."""
    if depth < 0 or text[at : at + 1] not in ("[", "{"):
        return None
    if text[at] == "[":
        items = elements(text, at)
        if any(has_both(members(text, items[k])) for k in range(0, len(items), 2) if text[items[k]] == "{"):
            return array("q", (p for k in range(0, len(items), 2) if text[items[k]] == "{" for p in items[k : k + 2]))
        inner = (items[k] for k in range(0, len(items), 2))
    else:
        values = members(text, at)
        inner = iter([*(values[k] for k in first_keys if k in values), *values.values()])
    return next((x for x in (find(text, a, has_both, first_keys, depth - 1) for a in inner) if x is not None), None)


def records(text: str, has_both: Callable[[dict], bool], first_keys: tuple[str, ...], depth: int) -> Iterator[dict]:
    """The records of a whole document; NoJson where it is none, or has no such list."""
    at = _after_space(text, 0)
    if _after_space(text, end_of(text, at)) != len(text):
        raise NoJson("something follows the document")
    places = find(text, at, has_both, first_keys, depth)
    if places is None:
        raise NoJson("no list of records with a name and an amount")
    for k in range(0, len(places), 2):
        yield json.loads(text[places[k] : places[k + 1]])


def read(files: DataFrame, row_of: Callable[[dict], tuple], has_both: Callable[[dict], bool], first_keys: tuple[str, ...], depth: int, a_batch: int = 50_000) -> DataFrame:
    """_pos, name, amount (strings by row_of()) and reason of documents (content: binary). A document that cannot be read is a row with a reason."""
    schema = pa.schema([("_pos", pa.int64()), ("name", pa.string()), ("amount", pa.string()), ("reason", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                try:
                    for n, r in enumerate(records(str(content.as_buffer(), "utf-8").removeprefix("\ufeff"), has_both, first_keys, depth)):
                        rows.append((n, *row_of(r), None))
                        if len(rows) == a_batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                except (ValueError, RecursionError) as e:
                    rows.append((None, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col("content").cast("binary").alias("content")).mapInArrow(run, "_pos long, name string, amount string, reason string")
