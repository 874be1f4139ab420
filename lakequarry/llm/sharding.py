"""Sharding by proportional stratified interleaving, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; the fractional rank (rank - 1 + u) / (rows of the source), with u from 0 to 1 by a seeded hash of the
source, spreads every source evenly over 0 to 1, and sources of a single row over all of it. All rows sorted by it and cut into equal runs give shards that
each hold the sources in the mixture's proportions, and row counts that differ by one at most (law "rows").

No window ever holds a whole source or the whole table: ranks come from counts of hash cells (bounded runs of
rows), summed over cells, plus a rank within the cell. So a source with a third of all rows is dealt over many
tasks. Counts of cells are small tables of sources x cells and of cells.

Defined results: a null source is a stratum of its own; a null text has size 8 and crc32 of nothing; a null doc_id
is ordered last. Equal rows are interchangeable. An empty table gives an empty result. Columns of any names are carried, but shard and slot, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stage, whole_text

SEED = "interleave-1"


def _running(counts: DataFrame, n: str, by: list[str], order: str, out: str) -> DataFrame:
    """Rows before each cell: counts summed along order within by. One row a cell only."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn(out, before)


def interleave(rows: DataFrame, source: str, seeded: Column, n_shards: int = 24, cells: int | None = None) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 within a shard).

    seeded: hexadecimal string of 8 digits or more that shuffles the rows. cells: runs of hash values and of fractional ranks;
    as many as shuffle partitions, times 16, unless given.
    """
    spark = rows.sparkSession
    cells = cells or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.drop("shard", "slot")
    hashed = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("double") / 2.0**32
    keyed = rows.select(F.struct("*").alias("row"), seeded.alias("seeded"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("source"))
    keyed = stage(keyed.withColumn("cell", (hashed(F.col("seeded")) * cells).cast("int")), "interleave")
    n_rows = keyed.count()
    in_cell = keyed.groupBy("source", "cell").agg(F.count("*").alias("n"))
    before = _running(in_cell, "n", ["source"], "cell", "before").withColumn("of", F.sum("n").over(Window.partitionBy("source"))).drop("n")
    rank = F.row_number().over(Window.partitionBy("source", "cell").orderBy("seeded"))
    u = hashed(F.md5(F.concat(F.lit(SEED), F.col("source")).cast("binary")))
    # the position from 0 to 1 gives its cell, then its place within the cell
    ranked = keyed.join(before, ["source", "cell"]).withColumn("at", (F.col("before") + rank - 1 + u) / F.col("of")).drop("cell")
    ranked = stage(ranked.withColumn("cell", (F.col("at") * cells).cast("int")), "interleave-ranked")
    runs = _running(ranked.groupBy("cell").agg(F.count("*").alias("n")), "n", [], "cell", "first").drop("n")
    place = F.row_number().over(Window.partitionBy("cell").orderBy("at", "source", "seeded")) - 1 + F.col("first")
    placed = ranked.join(runs, "cell").withColumn("place", place.cast("long"))
    shard = F.expr(f"cast((place * {n_shards}) div {max(1, n_rows)}L as int)")
    slot = F.expr(f"place - (shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", slot).select("row.*", "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of every document; the text itself is not shuffled."""
    text = whole_text()
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5"))
    seeded = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("text_md5")).cast("binary"))
    return interleave(slim, "source", seeded, n_shards).drop("text_md5")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
#: Ranks by plain windows instead of cells. DuckDB has no CRC-32; it is a sum over bytes by the table of the reversed polynomial, which a rule builds.
ORACLES = {
    "op6_sharding": f"""WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, coalesce('=' || source, '') AS source, coalesce(text, '') AS text, md5(concat_ws(':', '{SEED}', coalesce(CAST(doc_id AS VARCHAR), '~'), md5(coalesce(text, '')))) AS seeded FROM documents),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY seeded) - 1 + CAST(CAST('0x' || substring(md5('{SEED}' || source), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS along FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY along, source, seeded) - 1 AS place, count(*) OVER () AS n FROM r),
s AS (SELECT *, CAST(place * 24 // n AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
 xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
 'rows' AS law, shard, CAST(place - (CAST(shard AS BIGINT) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s, t"""
}
