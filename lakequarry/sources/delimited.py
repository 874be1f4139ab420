"""Budget tables from CSV or JSON text whose columns are found by their names. Rows come as (_pos, name, amount)."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.numbers import parse_amount
from ..functions.text import normalize
from . import json_records
from .cache import hold
from .order import in_source_order

# Names of the two columns, the first that is there wins; and the keys that are looked into first for the list of records.
NAME_COLUMNS = ("科目名稱", "科目", "主管名稱", "機關名稱")
AMOUNT_COLUMNS = ("本年度預算數", "本年度預算", "預算數")
LIST_KEYS = ("data", "result", "records", "Data", "Result", "Records")
DEPTH = 5
#: Bytes of a snapshot's JSON array that is read as one value; larger ones are refused.
MOST_JSON = 1 << 26


def _plain(name: str) -> str:
    return name.removeprefix("\ufeff").strip()


def _rows(df: DataFrame, name, amount) -> DataFrame:
    found = df.select("_pos", normalize(name).alias("name"), parse_amount(amount).alias("amount"))
    return found.where((F.col("name") != "") & F.col("amount").isNotNull())


def read_csv(spark: SparkSession, paths: str | list[str], names=NAME_COLUMNS, amounts=AMOUNT_COLUMNS) -> DataFrame:
    """Quotes are doubled inside quotes; a line break always ends a row, so large files are split among tasks."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(paths)
    chosen = []
    for candidates in (names, amounts):
        by_name = {_plain(c): c for c in reversed(df.columns)}
        found = next((by_name[c] for c in candidates if c in by_name), None)
        if found is None:
            raise Refused("SOURCE_SCHEMA_CHANGED", f"none of {', '.join(candidates)} is a column: {', '.join(df.columns)}")
        chosen.append(F.col(f"`{found}`"))
    return _rows(in_source_order(df, [paths] if isinstance(paths, str) else paths), *chosen)


def _has_both(names, amounts):
    return lambda record: any(_plain(k) in names for k in record) and any(_plain(k) in amounts for k in record)


def _json_rows(files: DataFrame, names, amounts) -> DataFrame:
    """Rows of JSON documents (content: binary); refused where one cannot be read. In a record the first key that is a column's name decides."""
    first = lambda r, wanted: next((v for k, v in r.items() if _plain(k) in wanted), None)
    shown = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    found = hold(json_records.read(files, lambda r: (shown(first(r, names)), shown(first(r, amounts))), _has_both(names, amounts), LIST_KEYS, DEPTH))
    bad = found.where(F.col("reason").isNotNull()).select("reason").first()
    if bad is not None:
        raise Refused("SOURCE_SCHEMA_CHANGED", f"the source is no JSON with records: {bad.reason}")
    return _rows(found, F.col("name"), F.col("amount"))


def read_json(spark: SparkSession, text: str, names=NAME_COLUMNS, amounts=AMOUNT_COLUMNS) -> DataFrame:
    """Of one small JSON document at hand (an answer of a web service)."""
    return _json_rows(spark.createDataFrame([(text.encode(),)], "content binary"), names, amounts)


def read_json_file(spark: SparkSession, path: str, names=NAME_COLUMNS, amounts=AMOUNT_COLUMNS) -> DataFrame:
    """Of a file that is one JSON document, of any size up to 2 GB: read by an executor, record by record."""
    return _json_rows(spark.read.format("binaryFile").load(path), names, amounts)


def read_json_lines(spark: SparkSession, paths: str | list[str], names=NAME_COLUMNS, amounts=AMOUNT_COLUMNS) -> DataFrame:
    """Of large files with one record a line."""
    lines = in_source_order(spark.read.text(paths), [paths] if isinstance(paths, str) else paths).select("_pos", F.from_json("value", "map<string,string>").alias("m"))
    first = lambda wanted: F.get(F.filter(F.map_entries("m"), lambda e: normalize(e["key"]).isin(*wanted)), F.lit(0))["value"]
    return _rows(lines, first(names), first(amounts))


def refuse_large(spark: SparkSession, path: str, instead: str, most: int) -> None:
    """Refuses a JSON document of more than most bytes, by the length its store states."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if size > most:
        raise Refused("SOURCE_TOO_LARGE", f"{path} is one JSON document of {size} bytes, over {most}; {instead}")


def read_budget(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON by the first character."""
    head = spark.read.text(path, lineSep="\n").select(F.substring("value", 1, 1000).alias("value")).where(normalize(F.col("value")) != "").select(F.left(normalize(F.col("value")), F.lit(1)).alias("v")).first()
    if head is None:
        raise Refused("SOURCE_SCHEMA_CHANGED", f"{path} is empty")
    return read_json_file(spark, path) if head.v in "{[" else read_csv(spark, path)


def read_first(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, str]:
    """(rows, path) of the first path that can be read; refused, with each one's reason, when none can."""
    reasons = []
    for path in paths:
        try:
            return read_budget(spark, path), path
        except (AnalysisException, Refused) as e:
            reasons.append(f"{path}: {str(e).splitlines()[0][:200]}")
    raise Refused("SOURCE_UNAVAILABLE", "; ".join(reasons))
