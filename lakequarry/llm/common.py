"""What the operators of this folder share: table reading, staging, and the word class."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Characters that separate words: blank, and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stage(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Its lineage ends there, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    _STAGED[staged] = path
    return staged


def drop_staged(df: DataFrame) -> None:
    """Deletes what stage() wrote for df, when nothing will read it any more."""
    spark, path = df.sparkSession, _STAGED.pop(df)
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Documents reach Python workers by rows a batch, where the session has Spark's default of 10,000: so many long texts at a time fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, rows)


def whole_text(column: str | Column = "text") -> Column:
    """The text, a null one as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text as an array."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row, however often body uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def row_key(df: DataFrame) -> Column:
    """A key of a document's row for joining a verdict back to it: 128 bits in hexadecimal, null-safe, equal for equal rows."""
    own = [F.col(c).cast("string") for c in ("doc_id", "lang", "text") if c in df.columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(c), F.lit(":"), c), F.lit("~")) for c in own]).cast("binary"))


def without(rows: DataFrame, gone: DataFrame, key: str, most_broadcast: int = 1_000_000) -> DataFrame:
    """rows whose key is not in gone: by a broadcast of up to most_broadcast keys (8 or 32 bytes each), else by a shuffle of both sides."""
    gone = stage(gone.select(key).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= most_broadcast else gone, key, "left_anti")


def within(rows: DataFrame, ids: DataFrame, key: str, most_broadcast: int = 1_000_000, bits: int = 16) -> DataFrame:
    """rows whose key is in ids (key, distinct): by a broadcast of up to most_broadcast keys, else by a shuffle of those rows that pass bitmaps of the keys' hashes, of some bits a key."""
    n = ids.count()
    if n <= most_broadcast:
        return rows.join(F.broadcast(ids.select(key)), key, "left_semi")
    size = 4096 * 8  # of a bitmap
    bucket, at = F.pmod(F.xxhash64(key), F.lit(-(-n * bits // size))).alias("_bucket"), F.pmod(F.xxhash64(key, F.lit("bit")), F.lit(size))
    maps = ids.select(bucket, at.alias("_at")).groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket").where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return likely.drop("_bucket", "_map").join(ids.select(key), key, "left_semi")
