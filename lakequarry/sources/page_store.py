"""A store of paged records: Parquet dealt by a hash of the record's id into folders, and sorted by it within them.

A few records are read by their ids: the folders are named from the ids, so no other folder is listed for data, and within a folder the ids' filter reaches the files' row groups. What is read for 15 records does not grow with the number of
buckets' other records, as long as buckets grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paged import complete, require_complete

BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int")


def write(records: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Whole records (record_id, pdf_url, total_pages, pages), refused unless each is complete."""
    rows = require_complete(records).select("record_id", "pdf_url", "total_pages", "pages").withColumn("bucket", _bucket(buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "record_id").write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, record_ids: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Those of the records that are stored and whole; a broken one has no row. For a list of ids that fits a query."""
    wanted = spark.createDataFrame([(i,) for i in record_ids], "record_id string").select(_bucket(buckets)).distinct().collect()  # a hash of each id
    stored = spark.read.schema("record_id string, pdf_url string, total_pages int, pages array<struct<page:int,text:string>>, bucket int").parquet(path)
    return stored.where(F.col("bucket").isin([r[0] for r in wanted]) & F.col("record_id").isin(record_ids)).where(complete()).drop("bucket")
