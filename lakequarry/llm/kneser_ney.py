"""Quality classifier: an interpolated modified Kneser-Ney bigram model of byte-level BPE ids, trained on trusted text.

With counts n(v w) of pairs, n(v) = sum of n(v w), three discounts D from the counts of counts, and the share g(v) that the discounts free,

    p(w | v) = max(n(v w) - D, 0) / n(v) + g(v) q(w),      q(w) = max(N(w) - D', 0) / N + g' / V

where N(w) counts the different ids before w and V is the vocabulary. A pair that training has not seen has p = g(v) q(w). So the log-probability of
a text is a sum over its ids of log g(v) + log q(w), which needs two arrays as long as the vocabulary, plus, for the pairs seen in training, a gain
log p - log g - log q. Gains are a table that grows with the corpus; they are joined to the texts' pairs by shards of pairs:

1. Each task turns runs of documents (blocks of bounded size) into postings: for each different pair, the block's documents that hold it and how often. A block's
   postings are packed into one value a shard, so what is shuffled is a few bytes a posting.
2. Postings and gains of a shard meet in one task (cogroup), which returns each block's partial sums; those are added up by block. There are as many tasks as
   the input needs for some 32 MB of text each: first more shards, and beyond 256 (or what the number of pairs needs) more salts, each a share of the blocks, to which the shard's gains are copied.

Trusted are all documents with label quality 1. The model is trained on one half of them (by a hash of doc_id). A document
is rejected when its log-perplexity is above its language's threshold: the quantile of the other half's log-perplexities, which the model has not seen, plus margin times the
distance of that quantile from their median. So each trusted document counts, in one of the two. All documents are scored, over whole texts.

Defined results: a null or empty text has no ids, a null log_ppl, and is rejected. Null languages are a language of their own; a language with fewer than least_trusted
trusted documents in the second half uses the quantiles of all. Without trusted text nothing but empty texts is rejected. Repeated rows stay; an empty table gives an empty result. Columns but doc_id, lang and text
are not looked at, and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import shared_bpe
from .common import read_table, row_key, small_batches, stage, within, without

VOCABULARY = 50_257
START = 50_256  # stands before a text; no text has it
BLOCK = 3 << 20  # bytes of text that a worker turns into ids and sorts at a time
POSTINGS = "shard int, salt int, block long, n_docs int, postings binary, doc_ids array<long>, langs array<string>, row_keys array<string>, n_ids array<long>, base array<double>"
SUMS = "shard int, salt int, block long, n_docs int, at binary, sums binary, doc_ids array<long>, langs array<string>, row_keys array<string>, n_ids array<long>, base array<double>"


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def pairs_of(texts: list[str | None], bpe) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids before, ids, number of the text) of every id of the texts, and the ids a text has."""
    coded = [bpe.plain_ids(t or "") for t in texts]
    sizes = np.array([len(c) // 4 for c in coded], np.int64)
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.uint16)  # VOCABULARY < 65,536
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    starts = np.cumsum(sizes) - sizes
    before[starts[sizes > 0]] = START
    return before, ids, np.repeat(np.arange(len(texts), dtype=np.uint16), sizes), sizes


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes of sorted ones, and how often each comes."""
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[firsts], np.diff(firsts, append=len(codes))


def packed_pairs(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """id before << 16 | id, in 32 bits."""
    return before.astype(np.uint32) << np.uint32(16) | ids


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with a text of most_bytes together (or one row), and fewer than 65,536 rows."""
    held, size, rows = [], 0, 0
    for b in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k in range(b.num_rows):
            if rows and (size + sizes[k] > most_bytes or rows >= 65_535):
                held.append(b.slice(start, k - start))
                yield pa.Table.from_batches(held)
                held, size, rows, start = [], 0, 0, k
            size += int(sizes[k])
            rows += 1
        held.append(b.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def pair_counts(texts: DataFrame, tokenizer: str | None = None, most_bytes: int = BLOCK) -> DataFrame:
    """key (id before << 16 | id) and n over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(tokenizer)
        for block in _blocks(batches, most_bytes):
            before, ids, _, _ = pairs_of(block.column("text").to_pylist(), bpe)
            keys = packed_pairs(before, ids)
            keys.sort()
            keys, n = runs_of(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0, 1, 2, and 3 or more, from how many have a count of 1 to 4; 0.5, 1, 1.5 where that says nothing."""
    usual = np.array([0.0, 0.5, 1.0, 1.5])
    if not (n1 and n2 and n3 and n4):
        return usual
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found > 0) & (found < [1, 1, 2, 3]), found, usual)


@dataclass(frozen=True)
class Lower:
    """What has a row for each id of the vocabulary at most: log g and log q, and what makes gains of counts."""

    log_free: np.ndarray
    log_q: np.ndarray
    total: np.ndarray
    discount: np.ndarray

    def gains(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        v, w = keys >> 16, keys & 0xFFFF
        free = self.log_free[v] + self.log_q[w]
        return np.log((n - self.discount[np.minimum(n, 3)]) / self.total[v] + np.exp(free)) - free


def lower_orders(counts: DataFrame) -> Lower:
    """From pair counts; at most VOCABULARY rows come to the driver, twice."""
    of_counts = counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    pair_d = discounts(*of_counts)
    v, w = F.shiftright("key", 16), F.col("key").bitwiseAND(F.lit(0xFFFF))
    before = counts.groupBy(v.alias("v")).agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2)], F.count_if(F.col("n") >= 3).alias("n3")).toPandas()
    after = counts.groupBy(w.alias("w")).agg(F.count("*").alias("n")).toPandas()
    total, free = np.ones(VOCABULARY), np.ones(VOCABULARY)
    at = before["v"].to_numpy(np.int64)
    total[at] = before["total"]
    free[at] = (before[["n1", "n2", "n3"]].to_numpy(float) @ pair_d[1:]) / before["total"].to_numpy(float)
    held = np.zeros(VOCABULARY, np.int64)
    held[after["w"].to_numpy(np.int64)] = after["n"]
    d = discounts(*[int((held == k).sum()) for k in (1, 2, 3, 4)])[np.minimum(held, 3)]
    kinds = max(1, int(held.sum()))
    q = (held - d) / kinds + (d.sum() / kinds if held.any() else 1.0) / VOCABULARY
    return Lower(np.log(free), np.log(q), total, pair_d)


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: str, at: int, n: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    part = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
    return np.ascontiguousarray(part.T).view(kind).ravel(), at + n * size


def pack_postings(keys: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n: np.ndarray) -> bytes:
    """Postings of sorted keys: sizes postings each, documents (ascending within a key) and how often."""
    gaps = docs.astype(np.int64)
    gaps[1:] -= docs[:-1]
    firsts = np.cumsum(sizes) - sizes
    gaps[firsts] = docs[firsts]
    parts = (np.diff(keys, prepend=0).astype("<u4"), sizes.astype("<u4"), gaps.astype("<u2"), n.astype("<u4"))
    return zlib.compress(np.array([len(keys), len(docs)], "<u8").tobytes() + b"".join(map(_planes, parts)), 1)


def unpack_postings(data: bytes) -> tuple[np.ndarray, ...]:
    data = zlib.decompress(data)
    n_keys, n_docs = np.frombuffer(data, "<u8", 2).tolist()
    keys, at = _from_planes(data, "<u4", 16, n_keys)
    sizes, at = _from_planes(data, "<u4", at, n_keys)
    gaps, at = _from_planes(data, "<u2", at, n_docs)
    n, _ = _from_planes(data, "<u4", at, n_docs)
    docs, sizes = np.cumsum(gaps, dtype=np.int64), sizes.astype(np.int64)
    firsts = np.cumsum(sizes) - sizes
    before = np.zeros(n_keys, np.int64)
    before[1:] = docs[firsts[1:] - 1]
    return np.cumsum(keys, dtype=np.int64), sizes, docs - np.repeat(before, sizes), n


def postings(docs: DataFrame, lower, shards: int, salts: int = 1, tokenizer: str | None = None, most_bytes: int = BLOCK) -> DataFrame:
    """Rows of POSTINGS of docs (doc_id, lang, row_key, text): a value for each block and shard, and a row of what is known of the block's documents."""
    names = [x.split(" ")[0] for x in POSTINGS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = shared_bpe(tokenizer), lower.value
        block = TaskContext.get().partitionId() << 32
        for table in _blocks(batches, most_bytes):
            before, ids, doc, sizes = pairs_of(table.column("text").to_pylist(), bpe)
            base = np.bincount(doc, known.log_free[before] + known.log_q[ids], len(sizes))
            keys = packed_pairs(before, ids)
            codes = shard_of(keys, shards) << np.uint64(48) | keys.astype(np.uint64) << np.uint64(16) | doc
            del before, ids, doc, keys
            codes.sort()  # by shard, pair and document
            codes, n = runs_of(codes)
            shard, keys, docs_of = (codes >> np.uint64(48)).astype(np.int64), ((codes >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.int64), (codes & np.uint64(0xFFFF)).astype(np.int64)
            edges = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
            salt = (block * 0x9E3779B1 >> 8) % salts
            rows = [(block % shards, salt, block, len(sizes), None, *(table.column(c).to_pylist() for c in ("doc_id", "lang", "row_key")), sizes.tolist(), base.tolist())]
            for a, b in zip(edges, [*edges[1:], len(shard)], strict=True):
                firsts = np.flatnonzero(np.diff(keys[a:b], prepend=-1))
                rows.append((int(shard[a]), salt, block, len(sizes), pack_postings(keys[a:b][firsts], np.diff(firsts, append=b - a), docs_of[a:b], n[a:b]), *[None] * 5))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            block += 1

    return docs.select("doc_id", "lang", "row_key", "text").mapInArrow(run, POSTINGS)


def gains(counts: DataFrame, lower, shards: int, salts: int = 1) -> DataFrame:
    """shard, salt, key and gain of every pair seen in training, once a salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys, shards).astype(np.int32)), pa.array(keys), pa.array(lower.value.gains(keys, b.column("n").to_numpy()))], ["shard", "key", "gain"])

    found = counts.select("key", "n").mapInArrow(run, "shard int, key long, gain double")
    return found.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", "gain")


def _sum_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one shard: each block's sums of gains, for the documents that have any."""
    known = right.column("key").to_numpy()
    order = np.argsort(known)
    known, gain = np.append(known[order], 1 << 40), np.append(right.column("gain").to_numpy()[order], 0.0)
    at, sums = [], []
    for value, n_docs in zip(left.column("postings"), left.column("n_docs").to_pylist(), strict=True):
        if not value.is_valid:
            at.append(None)
            sums.append(None)
            continue
        keys, sizes, docs, n = unpack_postings(value.as_py())
        place = np.searchsorted(known, keys)
        own = np.bincount(docs, np.repeat(np.where(known[place] == keys, gain[place], 0.0), sizes) * n, n_docs)
        some = np.flatnonzero(own)
        at.append(some.astype("<u2").tobytes())
        sums.append(own[some].astype("<f4").tobytes())
    rest = [left.column(c) for c in ("doc_ids", "langs", "row_keys", "n_ids", "base")]
    columns = [left.column("shard"), left.column("salt"), left.column("block"), left.column("n_docs"), pa.array(at, pa.binary()), pa.array(sums, pa.binary()), *rest]
    return pa.Table.from_arrays(columns, ["shard", "salt", "block", "n_docs", "at", "sums", "doc_ids", "langs", "row_keys", "n_ids", "base"])


def _sum_block(table: pa.Table) -> pa.Table:
    """Of one block: its documents with their log-perplexities; shards are added in order, so that results never vary."""
    about = next(r for r in table.select(["doc_ids", "langs", "row_keys", "n_ids", "base"]).filter(pa.compute.is_valid(table.column("base"))).to_pylist())
    total = np.array(about["base"], float)
    for row in table.select(["shard", "at", "sums"]).sort_by("shard").to_pylist():
        if row["at"]:
            total[np.frombuffer(row["at"], "<u2")] += np.frombuffer(row["sums"], "<f4")
    n = np.array(about["n_ids"], np.int64)
    ppl = -total / np.maximum(n, 1)
    return pa.Table.from_arrays(
        [pa.array(about["doc_ids"], pa.int64()), pa.array(about["langs"], pa.string()), pa.array(about["row_keys"], pa.string()), pa.array(n), pa.array(ppl, pa.float64(), mask=n == 0)],
        ["doc_id", "lang", "row_key", "n_ids", "log_ppl"],
    )


def dealt(n_bytes: int, pairs: int, partitions: int, task_bytes: int = 32 << 20, most_shards: int = 256, shard_pairs: int = 500_000) -> tuple[int, int]:
    """(shards, salts) for so many bytes of text and pairs of a model, with partitions tasks at least."""
    tasks = max(partitions, -(-n_bytes // task_bytes))
    shards = min(tasks, max(most_shards, -(-pairs // shard_pairs)), 65_536)
    return shards, -(-tasks // shards)


def score(docs: DataFrame, trusted: DataFrame, tasks: int | None = None, tokenizer: str | None = None, **limits) -> DataFrame:
    """doc_id, lang, row_key, n_ids and log_ppl of docs (doc_id, lang, text) under a model of trusted (text). tasks: those of the join at least; limits: of dealt()."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = stage(pair_counts(trusted, tokenizer), "pair-counts")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, salts = dealt(n_bytes, counts.count(), tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), **limits)
    lower = spark.sparkContext.broadcast(lower_orders(counts))  # three arrays of the vocabulary's length
    coded = postings(docs.withColumn("row_key", row_key(docs)), lower, shards, salts, tokenizer)
    met = coded.groupBy("shard", "salt").cogroup(gains(counts, lower, shards, salts).groupBy("shard", "salt")).applyInArrow(_sum_shard, SUMS)
    return met.groupBy("block").applyInArrow(_sum_block, "doc_id long, lang string, row_key string, n_ids long, log_ppl double")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of every trusted document."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 0.5, least_trusted: int = 50, tasks: int | None = None, tokenizer: str | None = None, most_broadcast: int = 10_000, most_ids: int = 1_000_000) -> DataFrame:
    """doc_id, lang, row_key, n_ids, log_ppl, threshold and kept of docs (doc_id, lang, text). most_ids: of within()."""
    docs = docs.select("doc_id", "lang", "text")
    ids = stage(trusted_ids(labels).select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("to_fit")), "trusted")
    found = stage(score(docs, within(docs, ids.where("to_fit"), "doc_id", most_ids), tasks, tokenizer), "perplexities")
    # rounded, so that the order of additions never shows, and that the different values are bounded; exact over these
    own_lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("own_lang")
    known = within(found.where("n_ids > 0"), ids.where("NOT to_fit"), "doc_id", most_ids).groupBy(own_lang, F.round("log_ppl", 4).alias("value")).agg(F.count("*").alias("n"))
    known = stage(known, "trusted-values")
    quantiles = F.percentile("value", F.array(F.lit(0.5), F.lit(quantile)), F.col("n"))
    limit = (quantiles[1] + margin * (quantiles[1] - quantiles[0])).alias("threshold")
    overall = known.agg(limit).first()[0]
    by_lang = known.groupBy("own_lang").agg(limit, F.sum("n").alias("n")).where(F.col("n") >= least_trusted).drop("n")
    # a row a language; joined without a shuffle, as few languages hold most rows, unless there are too many to broadcast
    by_lang = stage(by_lang, "thresholds")
    judged = found.withColumn("own_lang", own_lang).join(F.broadcast(by_lang) if by_lang.count() <= most_broadcast else by_lang, "own_lang", "left")
    threshold = F.coalesce("threshold", F.lit(overall).cast("double"))
    kept = F.col("log_ppl").isNotNull() & F.coalesce(F.col("log_ppl") <= threshold, F.lit(True))
    return judged.select("doc_id", "lang", "row_key", "n_ids", "log_ppl", threshold.alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    rejected = classify(docs, labels, **options).where("NOT kept").select("row_key")
    whole = docs.select(F.struct("*").alias("doc"), row_key(docs).alias("row_key"))
    return without(whole, rejected, "row_key").select("doc.*")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "lang", "n_ids", "log_ppl", "threshold", "kept")


QUERIES = {"op3_kneser_ney": op3_kneser_ney}
ORACLES: dict[str, str] = {}
