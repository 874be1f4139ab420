"""What an answer says about its own completeness, and whether the source has applied the filters that were asked for."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused


def completeness(rows: DataFrame, returned: str = "returned_count", counts: str = "tab_counts") -> DataFrame:
    """rows with total_count, is_complete (true, false, or null where the total is not known) and notice.

    counts: array of the totals that the source states. Just one of them is a total; several, or none, say nothing about the rows at hand.
    """
    total = F.when(F.size(counts) == 1, F.get(F.col(counts), F.lit(0)))
    with_total = rows.withColumn("total_count", total).withColumn("is_complete", F.col(returned) >= F.col("total_count"))
    several = F.concat(F.lit("the answer has "), F.size(counts).cast("string"), F.lit(" lists with totals of their own ("), F.array_join(F.col(counts).cast("array<string>"), "/"), F.lit("); completeness is unknown"))
    cut = F.concat(F.lit("the source answers in pages: "), F.col(returned).cast("string"), F.lit(" of "), F.col("total_count").cast("string"), F.lit(" rows are here"))
    return with_total.withColumn("notice", F.when(F.size(counts) > 1, several).when(~F.col("is_complete"), cut))


def require_applied(requested: Mapping[str, str], applied: Mapping[str, str | None]) -> dict[str, str]:
    """The filters that were asked for (those not empty), refused unless the source shows each with the same value."""
    asked = {k: v for k, v in requested.items() if v}
    for name, value in asked.items():
        if applied.get(name) != value:
            raise Refused("FILTER_NOT_CONFIRMED", f"the source does not confirm {name}={value}")
    return asked


def partial_failures(outcomes: DataFrame, ok: Column) -> DataFrame:
    """attempted, succeeded, failed and status of items that may fail one by one; a null outcome is a failure."""
    good = F.coalesce(ok, F.lit(False))
    counts = outcomes.agg(F.count("*").alias("attempted"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"))
    status = F.when((F.col("attempted") > 0) & (F.col("succeeded") == 0), "error").when(F.col("failed") > 0, "partial").otherwise("success")
    return counts.withColumn("status", status)
