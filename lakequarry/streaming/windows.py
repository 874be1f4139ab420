"""Fixed windows and expiring state, over tables and over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

from ..functions.codes import window_number

# Seconds of a window and requests allowed in it, by lane.
LANES = {"login": (600, 20), "register": (60, 30), "other": (60, 120)}


def rate_windows(df: DataFrame, time: str, keys: list[str], seconds: int, most: int) -> DataFrame:
    """keys, window_start, n, allowed and rejected of every fixed window; works on tables and on streams.

    Requests beyond `most` in a window are rejected. On a stream a window is closed, and its state dropped, once the watermark (two windows behind) has passed it. Counts are combined before the shuffle, so a
    busy key is one row a task.
    """
    if df.isStreaming:
        df = df.withWatermark(time, f"{2 * seconds} seconds")
    counted = df.groupBy(F.window(time, f"{seconds} seconds").alias("_w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("_w.start").alias("window_start"), "n", F.least("n", F.lit(most)).alias("allowed"), F.greatest(F.col("n") - most, F.lit(0)).alias("rejected"))


def within_limit(df: DataFrame, time: str, keys: list[str], seconds: int, most: int, tie: str) -> DataFrame:
    """The rows of a table that are let through: the first `most` of each window and keys, by time and then by tie. Ranks above `most` are cut off before the shuffle's window."""
    from pyspark.sql import Window

    numbered = df.withColumn("_window", window_number(F.col(time), seconds))
    rank = F.row_number().over(Window.partitionBy("_window", *keys).orderBy(time, tie))
    return numbered.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank", "_window")


class _FirstOfWindow(StatefulProcessor):
    """Of a window's rows, the first `most` by time and tie. A row that so many others stand before is rejected at once; those that are left are let through when the watermark has passed the window. The state is `most` rows at most."""

    def __init__(self, most: int, tie: DataType):
        self.most, self.tie = most, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getListState("first", StructType([StructField("at", LongType()), StructField("tie", self.tie), StructField("row", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802, ARG002 - Spark's name and arguments
        if not self.first.exists():
            self.handle.registerTimer(int(key[-1]))
        kept = [tuple(r) for r in self.first.get()] if self.first.exists() else []
        for part in rows:
            if part.empty:
                continue
            kept += zip(part["limit_at"].tolist(), part["limit_tie"].tolist(), part["limit_row"].tolist(), strict=True)
            kept.sort(key=lambda r: r[:2])
            if len(kept) > self.most:
                yield pd.DataFrame({"row": [r[2] for r in kept[self.most :]], "allowed": False})
                kept = kept[: self.most]
        self.first.put(kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        yield pd.DataFrame({"row": [r[2] for r in self.first.get()], "allowed": True})
        self.first.clear()

    def close(self) -> None:
        pass


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def limited(stream: DataFrame, time: str, keys: list[str], seconds: int, most: int, tie: str, delay: str = "0 seconds") -> DataFrame:
    """The rows of a stream, each with allowed: true for the first `most` of each window and keys, by time and then by tie; the others are rejected row by row.

    The same rows are let through as within_limit() lets through of the whole table, however they arrive: `delay` is how late a row may be behind the newest one. Later rows are dropped, as Spark drops them behind a watermark. A window's verdicts
    are final when they are given. tie: a column without nulls. Rows with a null time have no window and are dropped. Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    columns = stream.columns
    marked = stream.where(F.col(time).isNotNull()).select(
        "*", F.unix_micros(F.col(time).cast("timestamp")).alias("limit_at"), F.col(tie).alias("limit_tie"), F.to_json(F.struct(*columns), _JSON).alias("limit_row"), ((window_number(F.col(time), seconds) + 1) * (seconds * 1000)).cast("long").alias("limit_ends")
    )
    grouped = marked.withWatermark(time, delay).groupBy(*keys, "limit_ends")
    verdicts = grouped.transformWithStateInPandas(_FirstOfWindow(most, stream.schema[tie].dataType), "row string, allowed boolean", "Append", "EventTime")
    return verdicts.select(F.from_json("row", stream.schema, _JSON).alias("r"), "allowed").select("r.*", "allowed")


class _Expiring(StatefulProcessor):
    """Keeps a key's last value; Spark drops it once its time to live is over."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", StructType([StructField("value", StringType()), StructField("updates", LongType())]), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's name
        held = self.value.get() if self.value.exists() else (None, 0)
        value, updates = held[0], held[1]
        for part in rows:
            value, updates = part.sort_values("at", kind="stable")["value"].iloc[-1], updates + len(part)
        self.value.update((value, updates))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "updates": [updates]})

    def close(self) -> None:
        pass


def expiring_values(stream: DataFrame, ttl_seconds: int) -> DataFrame:
    """key, value and updates after each batch of a stream (key, value, at): the last value that has not expired. One writer a key; the state store drops expired keys.

    Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    return stream.groupBy("key").transformWithStateInPandas(_Expiring(1000 * ttl_seconds), "key string, value string, updates long", "Update", "ProcessingTime")
