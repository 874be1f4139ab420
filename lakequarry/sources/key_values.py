"""A key-value table with expiry as a sink: upserts, deletes and purges that are seen whole or not at all, and that a repeated batch does not repeat.

Rows (key, value, expiration, metadata) lie as Parquet in folders by a hash of the key. A change rewrites only the folders that hold its keys, under new names; then one small commit file names the folder of each bucket and the last batch of each
writer. The commit with the highest number is the table. A commit's file is made only where none of its number is there, so of two writers at a time one fails and its table stays as it was; so it does when a task fails. Files without a commit are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..operators import keyed
from . import results

SCHEMA = "key string, value string, expiration long, metadata string"


@dataclass(frozen=True)
class KeyValues:
    """The table below a root folder. buckets: fixed when the table is made."""

    spark: SparkSession
    root: str
    buckets: int = 64

    def _commits(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()[:20]) for f in files.listStatus(path)) if files.exists(path) else []

    def state(self, number: int | None = None) -> dict:
        """version, folders by bucket, and the last batch of each writer, of a commit (the newest unless named)."""
        known = self._commits()
        if not known:
            return {"version": 0, "folders": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{number or known[-1]:020}.json", wholetext=True).first()[0])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def table(self, state: dict | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows, expired ones too; of some buckets where they are given."""
        folders = (self.state() if state is None else state)["folders"]
        paths = [f"{self.root}/data/{f}" for b, f in folders.items() if only is None or int(b) in only]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def get(self, key: str, now: Column) -> DataFrame:
        """The row of a key, if it has not expired; its bucket alone is read."""
        bucket = self.spark.range(1).select(F.lit(key).alias("key")).select(self._bucket()).first()[0]
        return keyed.get(self.table(only=[bucket]), key, now)

    def _commit(self, state: dict, rewritten: DataFrame, buckets: list[int], batch: tuple[str, int] | None) -> int:
        folder = uuid.uuid4().hex
        rewritten.withColumn("bucket", self._bucket()).repartition(max(1, len(buckets)), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        filled = {r[0] for r in rewritten.sparkSession.read.parquet(f"{self.root}/data/{folder}").select("bucket").distinct().collect()} if self._has_rows(folder) else set()
        folders = {b: f for b, f in state["folders"].items() if int(b) not in buckets} | {str(b): f"{folder}/bucket={b}" for b in sorted(filled)}
        made = {"version": state["version"] + 1, "folders": folders, "batches": state["batches"] | (dict([batch]) if batch else {})}
        try:
            results.put_text(self.spark, f"{self.root}/commits/{made['version']:020}.json", json.dumps(made), replace=False)
        except Py4JJavaError as e:
            raise Refused("WRITE_CONFLICT", f"version {made['version']} was written by another writer") from e
        return made["version"]

    def _has_rows(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data/{folder}")
        return any(f.getPath().getName().startswith("bucket=") for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))

    def _changed(self, touched: DataFrame, merged: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None) -> int:
        state = self.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return state["version"]
        buckets = sorted(r[0] for r in touched.select(self._bucket()).distinct().collect())  # `buckets` numbers at most
        if not buckets and not batch:
            return state["version"]
        return self._commit(state, merged(self.table(state, buckets)), buckets, batch)

    def upsert(self, changes: DataFrame, now: Column, ttl_seconds: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Rows of changes replace those of their keys; of several rows of a key any one stays. batch: a writer's name and number; a number that it has written is left out. Returns the version."""
        return self._changed(changes, lambda old: keyed.put(old, changes.dropDuplicates(["key"]), now, ttl_seconds).select("key", "value", "expiration", "metadata"), batch)

    def delete(self, keys: DataFrame) -> int:
        return self._changed(keys, lambda old: keyed.without_denied(old, keys, "key"))

    def purge(self, now: Column) -> int:
        """Without the rows that have expired; only the buckets that hold some are rewritten."""
        return self._changed(self.table().where(~F.coalesce(F.col("expiration") > now, F.lit(True))), lambda old: keyed.purge(old, now))

    def sink(self, writer: str, now: Column, ttl_seconds: int | None = None) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: upserts a stream's batches, each once."""
        return lambda batch, number: self.upsert(batch, now, ttl_seconds, (writer, number)) and None
