"""The session's settings, and reading of Parquet tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; settings (with _ for .) go over them."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder. Times without a zone are read as UTC ones, as watermarks need a zone."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = {f.name: F.col(f.name).cast("timestamp") for f in found.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return found.withColumns(zoneless) if zoneless else found


def spread(df: DataFrame) -> DataFrame:
    """df for work that costs much a row: dealt to all cores where its files give fewer tasks than there are cores (a file of one row group is one task's, however many parts it is planned in). Large tables give more tasks than that and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has most_rows rows at most; else unmarked, so that Spark joins it by a shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a local one is made, if all of Spark runs in this process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir=os.environ.get('TMPDIR', '/tmp'))}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found
