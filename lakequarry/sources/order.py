"""Source order: rows of files numbered by file and by their place in it, however Spark packs files and parts of files into tasks.

A task may read several files, the largest first, and a large file in several parts, so ids in the order of tasks are not the source's order. Each part of a file (its path and the byte at which it begins) is read in order
by one task, though. So the parts' row counts are added up file by file, and a row's number is what stands before its part plus its place in the part. Only counts by part and by file are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small
from .cache import hold

MARKS = ("_file", "_block", "_id")


def qualified(spark: SparkSession, path: str) -> str:
    """The path as its file system names it, with scheme and without a slash at the end."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString().rstrip("/")


def decoded(uri: Column) -> Column:
    """A file's path from the encoded one that Spark's metadata have; one that cannot be decoded stays."""
    return F.coalesce(F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), uri)


def marked(df: DataFrame) -> DataFrame:
    """df, just read from files, with the marks of its rows: file, part of the file, and an id that grows within the part."""
    return df.select("*", decoded(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))


def below(root: str) -> Column:
    """The marked file as a key below the qualified root; null for any other file."""
    return F.when(F.startswith(F.col("_file"), F.lit(root + "/")), F.substr("_file", F.lit(len(root) + 2)))


def parts_of(rows: DataFrame) -> DataFrame:
    """_file, _block, n (rows) and first (the least id) of each part of a file."""
    return rows.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_id").alias("first"))


def numbered(rows: DataFrame, parts: DataFrame, rank: Column | str = "_file") -> DataFrame:
    """Marked rows with _pos from 0 on instead of the marks. parts: parts_of() them, with what the rank of a file is told by (its path unless given)."""
    named = parts.withColumn("_rank", F.col(rank) if isinstance(rank, str) else rank)
    files = named.groupBy("_rank", "_file").agg(F.sum("n").alias("n"))
    files = files.withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_rank", "_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_file", "_before")  # a row a file
    within = F.coalesce(F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = hold(named.withColumn("_within", within).join(files, "_file").select("_file", "_block", (F.col("_before") + F.col("_within") - F.col("first")).alias("_shift")))  # a row a part
    moved = F.raise_error(F.lit("files were split in another way than when they were counted"))
    return rows.join(small(starts), ["_file", "_block"], "left").withColumn("_pos", F.coalesce(F.col("_id") + F.col("_shift"), moved.cast("long"))).drop(*MARKS, "_shift")


def in_source_order(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """df, just read from files, with _pos: by the order of the paths given (a file or folder each), else by the files' paths, then by place."""
    rows = marked(df)
    rank = F.lit(len(paths or []))
    for n, path in reversed(list(enumerate(paths or []))):
        own = qualified(df.sparkSession, path)
        rank = F.when((F.col("_file") == own) | F.startswith("_file", F.lit(own + "/")), n).otherwise(rank)
    return numbered(rows, parts_of(rows), rank)
