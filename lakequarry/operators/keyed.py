"""Operators over keys: keep-last, uniqueness, keyset pages, lookups, deny-lists, and key-value tables with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..session import small


def keep_last(df: DataFrame, keys: list[str], pos: str = "_pos") -> DataFrame:
    """One row a key: the last one's values, at the first one's position. A plain aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != pos]
    found = df.groupBy(*keys).agg(F.min(pos).alias("_first"), F.max_by(F.struct(*rest), pos).alias("_row"))
    return found.select(*keys, F.col("_first").alias(pos), *[F.col("_row")[c].alias(c) for c in rest])


def check_rows(df: DataFrame, valid: Column, key: str) -> DataFrame:
    """rows, n_valid, all_valid, distinct_keys and unique, as one row. A null verdict is an invalid row."""
    counted = df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.coalesce(valid, F.lit(False))).alias("v"))
    sums = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("v"), F.lit(0)).alias("n_valid"), F.count(key).alias("distinct_keys"))
    return sums.select("rows", "n_valid", (F.col("n_valid") == F.col("rows")).alias("all_valid"), "distinct_keys", (F.col("distinct_keys") == F.col("rows")).alias("unique"))


def require_rows(df: DataFrame, valid: Column, key: str, reason_code: str, what: str) -> DataFrame:
    """df, once a job has shown that all rows are valid and all keys differ; refused else. An eager check cannot be optimised away."""
    found = check_rows(df, valid, key).first()
    if not (found["all_valid"] and found["unique"]):
        raise Refused(reason_code, f"{what}: {found['rows'] - found['n_valid']} of {found['rows']} rows are invalid, {found['distinct_keys']} keys differ")
    return df


def keyset_page(df: DataFrame, key: str, size: int, cursor=None, prefix: str = "") -> DataFrame:
    """size + 1 rows at most, by key after the cursor: one row more than size says that there is another page. The filter reaches the scan."""
    size = max(1, min(size, 1000))
    if prefix:
        df = df.where(F.startswith(F.col(key), F.lit(prefix)))
    if cursor is not None:
        df = df.where(F.col(key) > F.lit(cursor))
    return df.orderBy(key).limit(size + 1)


def read_page(df: DataFrame, key: str, size: int, cursor=None, prefix: str = "") -> tuple[DataFrame, bool, object]:
    """(rows of the page, whether it is complete, cursor of the next page or None)."""
    size = max(1, min(size, 1000))
    rows = keyset_page(df, key, size, cursor, prefix).collect()
    more = len(rows) > size
    page = df.sparkSession.createDataFrame(rows[:size], df.schema)
    return page, not more, rows[size - 1][key] if more else None


def look_up(df: DataFrame, dimension: DataFrame, key: str, value: str, default: Column | None = None) -> DataFrame:
    """df with the dimension's value: rows without one are dropped, or get the default. A dimension of a checked size is broadcast."""
    found = df.join(small(dimension.select(key, value)), key, "inner" if default is None else "left")
    return found if default is None else found.withColumn(value, F.coalesce(value, default))


def without_denied(df: DataFrame, denied: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in denied. Rows with a null key stay."""
    return df.join(small(denied.select(key).where(F.col(key).isNotNull()).distinct()), key, "left_anti")


def active(df: DataFrame, now: Column, expiration: str = "expiration") -> DataFrame:
    """Rows that have no expiration or a later one than now (seconds since 1970)."""
    return df.where(F.col(expiration).isNull() | (F.col(expiration) > now))


def get(df: DataFrame, key: str, now: Column) -> DataFrame:
    """The row of a key, if it has not expired."""
    return active(df.where(F.col("key") == key), now)


def put(df: DataFrame, changes: DataFrame, now: Column, ttl_seconds: int | None = None) -> DataFrame:
    """The table (key, value, expiration, metadata) after the changes, which replace rows of their keys; ttl_seconds sets their expiration from now on."""
    until = F.col("expiration") if ttl_seconds is None else now + ttl_seconds
    new = changes.withColumn("expiration", until.cast("long"))
    both = df.withColumn("_pos", F.lit(0)).unionByName(new.withColumn("_pos", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, ["key"]).drop("_pos")


def delete(df: DataFrame, key: str) -> DataFrame:
    return df.where(~F.col("key").eqNullSafe(key))


def purge(df: DataFrame, now: Column) -> DataFrame:
    """The table without rows that have expired."""
    return active(df, now)
