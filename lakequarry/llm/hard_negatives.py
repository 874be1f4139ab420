"""Hard negatives by a two-dimensional block matrix multiply (SUMMA).

Vectors are quantised to integers and packed into blocks: runs of rows in the order of label and id. A block of anchors meets a block of rows in a tile of int64 scores. Tiles lie in a grid of cells, a group of anchors' blocks by a group of rows' blocks. As SUMMA has it, tiles stay
where they are and blocks move: a cell gets its blocks by a shuffle, the partial tiles of each chunk of dimensions are added in the task that has the cell, and a cell is reduced to its best candidates before anything else is moved.

Two such products make the result. The first takes the tiles whose labels can be equal and gives each anchor its positives. The second takes all tiles but those of one and the same label, carries the
positives along with the anchors' blocks, and gives the best rows of each anchor's and positive's window of scores. So every tile is multiplied once, but for the few blocks that hold two labels, and no tile is written.

What moves: rows' blocks once for each group of anchors (4,096 of them), and anchors' blocks and candidates once for each group of rows (32,768, fewer of more than 64 dimensions). It grows with anchors x rows, the size of the stated query set's search, by some 0.14 bytes a score with 64 dimensions; nothing but three
counts passes through the driver, and no side is broadcast. A task holds one tile of 128 x 1,024 scores and the candidates of one block of anchors; blocks have the same number of rows whatever the labels are, so a label with a third of all rows is only more blocks. Blocks go to groups by a hash.

Defined results: rows with a null id, label or vector, or with any null or non-finite component, take no part. Shorter vectors are filled up with zeros; an empty vector has the score 0 with any other. Quantised components end at
+-2^22 (x at +-16,384), so that scores and windows stay exact in 64 bits up to 2,048 dimensions; more dimensions are refused. Ties go to the smaller id. Repeated rows are rows of their own, and an anchor's own row, of equal
copies just one, is not its positive; a repeated anchor is answered once a copy. A window of a negative positive score is empty. An empty table gives an empty result. Columns other than the three that are named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_staged, read_table, stage

MOST, MOST_DIMENSIONS = 1 << 22, 2048
LOWEST = np.iinfo(np.int64).min
BLOCK = "block long, low int, high int, ids binary, labels binary, own binary, matrix binary"
A_GROUP, GROUP, LEAST_GROUP = 32, 32, 4  # blocks of anchors, and of rows up to 64 dimensions and from 512 on, in a cell
CANDIDATE = "a_block long, row int, anchor_id long, own long, id long, score long"
NEGATIVE = "a_block long, row int, slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


@contextmanager
def records_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows reach Python at a time: a row here is a block or a tile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, within +-MOST."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 256, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))


def usable(rows: DataFrame, key: str, label: str | Column, vector: str) -> DataFrame:
    """id, label and q of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    named = rows.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("int").alias("label"), F.col(vector).alias("vector"))
    return named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite).select("id", "label", quantised(F.col("vector")).alias("q"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """Lists of ints as rows, filled up with zeros."""
    ends = column.offsets.to_numpy()
    n = np.diff(ends)
    values = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out = np.zeros((len(n), dimensions), np.int32)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], n)] = values
    return out


def pack(rows: DataFrame, size: int, dimensions: int, n_rows: int) -> DataFrame:
    """Blocks of `size` rows at most in the order of label and id. Within a block rows lie by id."""

    def block(number: int, ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> tuple:
        by_id = np.argsort(ids, kind="stable")
        ids, labels, m = ids[by_id], labels[by_id], m[by_id]
        own = np.square(m, dtype=np.int64).sum(1)
        return number, int(labels.min()), int(labels.max()), ids.astype("<i8").tobytes(), labels.astype("<i4").tobytes(), own.astype("<i8").tobytes(), m.astype("<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        schema = pa.schema(list(zip(("block", "low", "high", "ids", "labels", "own", "matrix"), (pa.int64(), *[pa.int32()] * 2, *[pa.binary()] * 4), strict=True)))

        def cut(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            ids, labels, m = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0), None, None)
            at = 0
            while len(ids) - at >= least:
                part = slice(at, at + size)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, block(number, ids[part], labels[part], m[part]), strict=True))], schema)
                number, at = number + 1, at + size
            held = [(ids[at:], labels[at:], m[at:])] if at < len(ids) else []

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), dimensions)))
            yield from cut(size)
        yield from cut(1)

    parts = max(1, ceil(n_rows / (16 * size)))
    return rows.select("id", "label", "q").repartitionByRange(parts, "label", "id").sortWithinPartitions("label", "id").mapInArrow(run, BLOCK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed in int64: by float64, where every sum is below 2^53 and so exact, else by integers."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def _first(found: list[np.ndarray], keys: int, most: int) -> list[np.ndarray]:
    """Of columns that end in id and score, the rows with the `most` best scores of each value of the first `keys` columns; of equal ones those of the smaller ids."""
    order = np.lexsort((found[-2], -found[-1], *found[keys - 1 :: -1]))
    found = [x[order] for x in found]
    new = np.zeros(len(order), bool)
    for x in found[:keys]:
        new[1:] |= x[1:] != x[:-1]
    at = np.arange(len(order))
    kept = at - np.maximum.accumulate(np.where(new, at, 0)) < most
    return [x[kept] for x in found]


def summed_tiles(anchors: DataFrame, rows: DataFrame, wanted: Column, grid: tuple[int, int], width: int, reduce, keys: int, most: int, schema: str) -> DataFrame:
    """The best candidates of each cell, from reduce(scores, a, b) of every tile of blocks that are wanted; scores are added up by chunks of `width` dimensions.

    grid: groups of anchors' blocks and of rows' blocks. A tile's candidates end in id and score; `most` of them stay for each value of the first `keys` columns.
    """
    group, every = (lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = anchors.select(*[F.col(c).alias(f"a_{c}") for c in ("block", "low", "high", "ids", "labels", "own", "matrix")], "positives", group(grid[0]).alias("i"), every(grid[1]).alias("j"))
    b = rows.select("block", "low", "high", "ids", "labels", "matrix", group(grid[1]).alias("j"), every(grid[0]).alias("i"))
    # a merge join by intent: what is repeated for every cell is far larger than Spark takes it for, and would be broadcast
    met = a.repartition(grid[0] * grid[1], "i", "j").join(b.repartition(grid[0] * grid[1], "i", "j").hint("merge"), ["i", "j"]).where(wanted)
    names, kinds = zip(*[(x.split()[0], pa.int32() if x.split()[1] == "int" else pa.int64()) for x in schema.split(", ")], strict=True)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, a, a_matrix, held = None, {}, None, []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                found = _first([np.concatenate(x) for x in zip(*held, strict=True)], keys, most)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([np.full(len(found[0]), number), *found], kinds, strict=True)], list(names))

        for batch in batches:
            for n in range(batch.num_rows):
                get = lambda name, kind, batch=batch, n=n: np.frombuffer(batch.column(name)[n].as_py() or b"", kind)
                if (of := batch.column("a_block")[n].as_py()) != number:
                    yield from out()
                    number, a = of, {"ids": get("a_ids", "<i8"), "labels": get("a_labels", "<i4"), "own": get("a_own", "<i8"), "positives": get("positives", "<i8").reshape(-1, 4)}
                    a_matrix = get("a_matrix", "<i4").reshape(len(a["ids"]), -1)
                b = {"ids": get("ids", "<i8"), "labels": get("labels", "<i4")}
                matrix = get("matrix", "<i4").reshape(len(b["ids"]), -1)
                scores = np.zeros((len(a["ids"]), len(b["ids"])), np.int64)
                for k in range(0, matrix.shape[1], width):
                    scores += product(a_matrix[:, k : k + width], matrix[:, k : k + width])
                held.extend(reduce(scores, a, b))
        yield from out()

    return met.select("a_block", "a_ids", "a_labels", "a_own", "a_matrix", "positives", "ids", "labels", "matrix").mapInArrow(tiles, schema)


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and score of each row's best allowed columns, one a row at a time; of equal ones the first column."""
    left, rows = np.where(allowed, scores, LOWEST), np.arange(len(scores))
    for _ in range(min(most, scores.shape[1])):
        at = left.argmax(1)
        top = left[rows, at]
        there = top > LOWEST
        if not there.any():
            return
        yield rows[there], at[there], top[there]
        left[rows, at] = LOWEST


def _positives_of(most: int):
    def reduce(scores: np.ndarray, a: dict, b: dict) -> Iterator[tuple]:
        same = a["labels"][:, None] == b["labels"][None, :]
        for r, c, s in best(scores, same, most + 1):  # one more, for the anchor's own row
            yield r, a["ids"][r], a["own"][r], b["ids"][c], s

    return reduce


def _negatives_of(most: int, low: int, high: int):
    def reduce(scores: np.ndarray, a: dict, b: dict) -> Iterator[tuple]:
        other = a["labels"][:, None] != b["labels"][None, :]
        for slot in np.unique(a["positives"][:, 1]):
            row, _, ids, positive = a["positives"][a["positives"][:, 1] == slot].T
            of = scores[row]
            window = (of >= -(-low * positive // 100)[:, None]) & (of <= (high * positive // 100)[:, None])
            for r, c, s in best(of, other[row] & window, most):
                yield row[r], np.full(len(r), slot), a["ids"][row[r]], ids[r], positive[r], b["ids"][c], s

    return reduce


def _own_row_out(candidates: DataFrame, most: int) -> DataFrame:
    """The first `most` candidates of each anchor by score and id, without one that is the anchor's own row; slot from 1."""
    key, order = ["a_block", "row"], [F.desc("score"), "id"]
    top = candidates.withColumn("slot", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("slot") <= most + 1)
    top = top.withColumn("self", (F.col("id") == F.col("anchor_id")) & (F.col("score") == F.col("own")))
    top = top.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "self").orderBy(*order))).where("NOT (self AND copy = 1)")
    return top.withColumn("slot", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("slot") <= most)


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, a_size: int = 128, size: int = 1024, width: int | None = None, shards: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score from rows (id, label, q), as usable() gives them.

    anchor: which rows are anchors, by id and label. low, high: per cent of the positive's score between which a negative's score lies. width: dimensions in a chunk; half of them, 512 at most, unless given. shards: groups of rows' blocks.
    """
    spark = rows.sparkSession
    rows = stage(rows, "quantised")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(anchor).alias("anchors"), F.coalesce(F.max(F.size("q")), F.lit(0)).alias("d")).first()
    if sizes.d > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {sizes.d} dimensions, over {MOST_DIMENSIONS}")
    width = width or max(1, min(512, ceil(sizes.d / 2)))
    in_group = size * max(LEAST_GROUP, min(GROUP, GROUP * 64 // max(1, sizes.d)))
    shards = shards or max(1, ceil(sizes.n / in_group), min(ceil(sizes.n / (LEAST_GROUP * size)), spark.sparkContext.defaultParallelism))
    grid = max(1, ceil(sizes.anchors / (A_GROUP * a_size))), shards
    every = stage(pack(rows, size, sizes.d, sizes.n), "row-blocks")
    some = stage(pack(rows.where(anchor), a_size, sizes.d, sizes.anchors), "anchor-blocks")
    drop_staged(rows)
    one_label = lambda lo, hi: F.col(lo) == F.col(hi)
    may_equal = (F.col("a_low") <= F.col("high")) & (F.col("low") <= F.col("a_high"))
    may_differ = ~(one_label("a_low", "a_high") & one_label("low", "high") & one_label("a_low", "low"))
    as_bytes = lambda c: F.unhex(F.array_join(F.transform(c, lambda p: F.concat(*[_little_endian(p[x]) for x in ("row", "slot", "id", "score")])), ""))
    with records_a_batch(spark, max(1, min(16, MOST_DIMENSIONS // max(1, sizes.d)))):
        candidates = stage(summed_tiles(some.withColumn("positives", F.lit(None).cast("binary")), every, may_equal, grid, width, _positives_of(positives), 1, positives + 1, CANDIDATE), "positive-candidates")
        chosen = _own_row_out(candidates, positives).groupBy(F.col("a_block").alias("block")).agg(as_bytes(F.collect_list(F.struct("row", "slot", "id", "score"))).alias("positives"))  # a_size x positives at most
        chosen = stage(chosen, "positives")
        found = stage(summed_tiles(some.join(chosen.hint("merge"), "block"), every, may_differ, grid, width, _negatives_of(negatives, low, high), 2, negatives, NEGATIVE), "negative-candidates")
    for done in (every, some, candidates, chosen):
        drop_staged(done)
    rank = F.row_number().over(Window.partitionBy("a_block", "row", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _little_endian(x: Column) -> Column:
    """A long's eight bytes as hexadecimal digits, the lowest first."""
    digits = F.lpad(F.hex(x.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(8))])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "vec_id", label, "embedding")
    return mine(rows, F.col("id") % 100 == 0)


SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(NOT isfinite(x), true))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> p.own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
