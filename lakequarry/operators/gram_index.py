"""Literal search over large tables without reading them: postings of character n-grams retrieve blocks of rows, and the rows of those blocks are searched exactly.

Rows are sorted by their key and numbered in blocks. A gram's postings are the blocks that hold it, so they do not grow with a text's length, and a common gram has one entry a block at most, however batches cut the block (more where a block is read by two tasks, or has over a million grams). A task hashes the grams of a block at once and lists the
blocks of each gram, so that a row of the postings is a gram with its blocks, not a gram of a block. Two grams of one hash cost a block that is read in vain, never a row. Postings are dealt by the hash into folders and sorted by it, so a
keyword reads the folders and row groups of its grams alone. Of a keyword's grams the rarest few are intersected; how often each occurs is looked up first. Rows of the blocks that are left are read by a filter that reaches the files' row groups and pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N, SHARDS, BLOCK_ROWS, MOST_GRAMS, MOST_LISTED = 3, 64, 64, 4, 10_000
POSTINGS = "gram long, n int, blocks array<long>, shard int"
# The odd factor of the hash, characters that are hashed at once, and postings that a task gathers before it lists them.
FACTOR, MOST_CHARS, MOST_HELD = np.uint64(0x9E3779B97F4A7C15), 1 << 20, 1 << 22


def grams_of(texts: list[str], n: int = N) -> np.ndarray:
    """The hashes of the different n-grams (of code points) of the texts, sorted; no gram reaches from one text into the next."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    size = len(points) - n + 1
    if size < 1:
        return np.empty(0, np.int64)
    found = np.zeros(size, np.uint64)
    for k in range(n):
        found += points[k : k + size]
        found *= FACTOR
    ends = np.cumsum([len(t) for t in texts])[:-1]
    inside = np.ones(size, bool)
    for k in range(1, n):  # the last n - 1 places of each text
        inside[(at := ends - k)[(at >= 0) & (at < size)]] = False
    found = found[inside].view(np.int64)
    found.sort()
    return found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    return ((grams.view(np.uint64) >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _pieces(texts, n: int) -> Iterator[list[str]]:
    """Texts as lists of MOST_CHARS characters or little more; a longer text in slices that share n - 1 characters."""
    held, size = [], 0
    for t in texts:
        for k in range(0, max(1, len(t) - n + 1), MOST_CHARS):
            held.append(t[k : k + MOST_CHARS + n - 1])
            size += len(held[-1])
            if size >= MOST_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _listed(held: list[tuple[int, np.ndarray]], shards: int) -> pa.RecordBatch:
    """A row for each gram of what is held, with its blocks; a block that is held in pieces, one after the other, is listed once."""
    grams, blocks = np.concatenate([g for _, g in held]), np.concatenate([np.full(len(g), b, np.int64) for b, g in held])
    order = np.argsort(grams, kind="stable")
    grams, blocks = grams[order], blocks[order]
    first = np.concatenate(([True], (grams[1:] != grams[:-1]) | (blocks[1:] != blocks[:-1])))
    grams, blocks = grams[first], blocks[first]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    own, offsets = grams[starts], np.append(starts, len(grams))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(blocks))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.diff(offsets).astype(np.int32)), lists, pa.array(_shard(own, shards))], ["gram", "n", "blocks", "shard"])


def _postings(n: int, shards: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for block, rows in groupby(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), lambda r: r[0]):
                for piece in _pieces((t.as_py().decode("utf-8", "replace") for _, t in rows if t.is_valid), n):
                    found = grams_of(piece, n)
                    if size >= MOST_HELD and (block != held[-1][0] or size >= MOST_HELD + MOST_CHARS):
                        yield _listed(held, shards)
                        held, size = [], 0
                    if len(found):
                        held.append((block, found))
                        size += len(found)
        if held:
            yield _listed(held, shards)

    return postings


def build(rows: DataFrame, key: str, text: str, path: str, n: int = N, shards: int = SHARDS, block_rows: int = BLOCK_ROWS) -> None:
    """Writes rows and postings below a folder. A null text is in no posting. Long texts make blocks of their own size; nothing is cut."""
    spark = rows.sparkSession
    numbered = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_block", F.expr(f"monotonically_increasing_id() div {block_rows}"))
    numbered.write.option("parquet.block.size", 16 << 20).parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows").select("_block", F.col(text).cast("binary").alias("text"))
    postings = stored.mapInArrow(_postings(n, shards), POSTINGS)
    postings.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "gram").write.partitionBy("shard").parquet(f"{path}/postings")


def blocks_of(spark: SparkSession, path: str, keyword: str, n: int = N, shards: int = SHARDS, most_grams: int = MOST_GRAMS) -> DataFrame | None:
    """_block of the blocks that hold the keyword's rarest grams; None for a keyword shorter than a gram, which retrieves nothing."""
    grams = grams_of([keyword], n)
    if not len(grams):
        return None
    postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    own = lambda wanted: F.col("shard").isin(sorted(set(_shard(wanted, shards).tolist()))) & F.col("gram").isin(wanted.tolist())
    known = {r.gram: r.n for r in postings.where(own(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a keyword's grams
    chosen = np.array(sorted(grams.tolist(), key=lambda g: (known.get(g, 0), g))[:most_grams])
    listed = postings.where(own(chosen)).select("gram", F.explode("blocks").alias("_block"))
    return listed.groupBy("_block").agg(F.collect_set("gram").alias("g")).where(F.size("g") == len(chosen)).select("_block")


def search(spark: SparkSession, path: str, text: str, keyword: str, n: int = N, shards: int = SHARDS, most_listed: int = MOST_LISTED) -> DataFrame:
    """The rows whose text holds the keyword, just as a scan finds them. A keyword shorter than a gram is a scan."""
    rows, blocks = spark.read.parquet(f"{path}/rows"), blocks_of(spark, path, keyword, n, shards)
    if blocks is not None:
        few = [r[0] for r in blocks.limit(most_listed + 1).collect()]
        rows = rows.where(F.col("_block").isin(few)) if len(few) <= most_listed else rows.join(blocks, "_block", "left_semi")
    return rows.where(F.contains(F.col(text), F.lit(keyword))).drop("_block")
