"""The totals of a budget: agencies' count, sum, highest and lowest, and the official total that the table itself states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.text import normalize

# A row whose name holds one of these states a total.
TOTAL_MARKERS = ("合計", "總計", "總額")


def states_total(name: Column, markers: tuple[str, ...] = TOTAL_MARKERS) -> Column:
    return name.rlike("|".join(markers))


def summarize(rows: DataFrame, markers: tuple[str, ...] = TOTAL_MARKERS, by: list[str] | None = None) -> DataFrame:
    """agency_count, agency_sum, official_total, highest_name, highest_amount, lowest_name, lowest_amount of rows (_pos, name, amount), one row (or one for each group of by).

    Rows without a name or a finite amount do not count. The last total row is the official total; among equal amounts the first row wins.
    One aggregation, combined before its shuffle.
    """
    known = rows.withColumn("name", normalize(F.col("name"))).where((F.col("name") != "") & (F.abs("amount") < float("inf")))
    total = states_total(F.col("name"), markers)
    agency = lambda c: F.when(~total, c)
    high = F.max_by("name", agency(F.struct("amount", -F.col("_pos"))))
    low = F.min_by("name", agency(F.struct(F.col("amount"), F.col("_pos"))))
    return known.groupBy(*(by or [])).agg(
        F.count_if(~total).alias("agency_count"), F.sum(agency(F.col("amount"))).alias("agency_sum"), F.max_by("amount", F.when(total, F.col("_pos"))).alias("official_total"),
        high.alias("highest_name"), F.max(agency(F.col("amount"))).alias("highest_amount"), low.alias("lowest_name"), F.min(agency(F.col("amount"))).alias("lowest_amount"),
    )


def checked_summary(rows: DataFrame) -> DataFrame:
    """The summary, computed; refused when no agency has an amount."""
    found = summarize(rows)
    row = found.first()
    if not row.agency_count:
        raise Refused("SOURCE_SCHEMA_CHANGED", "no row has an agency and an amount")
    return rows.sparkSession.createDataFrame([row], found.schema)
