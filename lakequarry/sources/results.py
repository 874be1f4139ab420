"""Results as JSON: one object a row, nulls kept; and small objects of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One column, json: each row as an object whose keys are the columns."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines below a folder, written by the executors."""
    json_rows(df).write.mode(mode).text(path)


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """One small object (a pointer, a manifest, a stored page) below a folder of any file system that Spark reads. Without replace it is an error where there is one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, replace)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    """A folder or object with all that is below it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
