"""SimHash near-duplicate groups with bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Only distinct fingerprints are compared. Two of them
within radius 2 agree on at least two of four 16-bit quarters, so each fingerprint goes to the six buckets of its pairs of quarters and no
link is lost. Within a bucket, the fingerprints lie as bit planes: word b of a block of 64 fingerprints holds bit b of all 64. A query's
distances to a block grow by one carry-save step a plane (two one-bit counters and a flag for "over two"), 64 at a time, and a
block is abandoned once the flag is set for all of its fingerprints. Links become a tree per bucket before they leave the task.

A bucket with more than most_in_bucket fingerprints is dealt in blocks to several tasks, and pairs of blocks are compared the same way until nothing is left
to link (exact_links()). So the components never depend on most_in_bucket.

drop_near_duplicates() removes by an exact Jaccard similarity (0.8 of the distinct five-word shingles unless given). Texts of equal shingle sets are one node. Fingerprints of
256 bits only find candidates: their expected distance at a similarity j is 256 acos(2 j / (1 + j)) / pi, and the radius lies three standard deviations above it. Buckets come from
bands of minima over the same shingle hashes: 32 bands of 8 minima, so that a pair of a similarity j meets in a bucket with the chance 1 - (1 - j^8)^32, which is 0.997 at just 0.8 and does not depend on the number of documents; neither does what is shuffled, 32 rows of
48 bytes a document. Within a bucket fingerprints are compared bit-sliced as above. The members of each candidate component then bring their shingle hashes,
and a link is a pair whose intersection over union reaches the similarity. So every document removed is joined to the one that stays by links of that similarity.
Crowded candidate components are dealt in blocks in the same way.

Components come from alternating large-star and small-star rounds over links between distinct fingerprints, staged in the
shared folder after every round. Nothing is collected but counts.

Defined results: a null or empty text has the fingerprint zero. doc_ids that are null never become a component's id; a component of
such rows only has a null id. Repeated rows stay. An empty table gives an empty result. Columns of other names than doc_id and text are carried or not looked at, whatever
their names are. A text is hashed in runs of a megabyte, so its words are never all in memory as strings.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, read_table, small_batches, stage, without

RADIUS, SEED = 2, 42
PAIRS = tuple(combinations(range(4), 2))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_runs(text: str | None, shingle: int, most_bytes: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles, repeats included; of the whole sequence if it has fewer words. A run of them for each most_bytes of the text."""
    data = (text or "").encode().lower()  # bytes: A-Z only
    words, at, some = [], 0, False
    while at < len(data):
        stop = at + most_bytes
        if stop < len(data):
            found = _SPACE.search(data, stop)
            stop = found.start() if found else len(data)
        words, at = [*words, *data[at:stop].split()], stop  # the six separators only
        if len(words) >= shingle:
            yield _hashes(words, shingle)
            words, some = words[len(words) - shingle + 1 :], True
    if words and not some:
        yield _hashes(words, len(words))


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()] if len(words) > shingle else [0]
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends, strict=True)], repeat(SEED)), np.uint64, len(ends))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different values of shingle_runs(), in order."""
    runs = [np.unique(r) for r in shingle_runs(text, shingle)]
    return (runs[0] if len(runs) == 1 else np.unique(np.concatenate(runs))) if runs else np.empty(0, np.uint64)


def majority(runs: Iterable[np.ndarray], words: int = 1) -> np.ndarray:
    """Bits set in over half the hashes, 64 a word; the words from the second on take the hashes mixed by different constants."""
    total, n = np.zeros(64 * words, np.int64), 0
    for hashes in runs:
        n += len(hashes)
        for at in range(0, len(hashes), 16384):
            part = hashes[at : at + 16384]
            mixed = np.column_stack([part, *[_mix(part, k) for k in range(1, words)]]).astype("<u8")
            total += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > n, bitorder="little").view("<u8")


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    h = h ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of a text as an unsigned number."""
    return int(majority(shingle_runs(text, shingle))[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of docs (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in b.column(b.schema.names.index("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k, n in enumerate(b.schema.names) if n != "text"), pa.array(found)], [*(n for n in b.schema.names if n != "text"), "fp"])

    small_batches(docs.sparkSession)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(run, ", ".join([*kept, "fp long"]))


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes, (64 words, blocks) words: bit i of word [b, k] is bit b of values[64 k + i]. values: (n,) or (n, words)."""
    values = values.reshape(len(values), -1)
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T).reshape(bits.shape[1], -1, 64), axis=2, bitorder="little")
    return np.ascontiguousarray(planes).view(np.uint64).reshape(bits.shape[1], -1)


def near(queries: np.ndarray, planes: np.ndarray, block: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each query, the fingerprints of one block (a bit each, among wanted) within the radius.

    A block's 64 distances are one-bit counters side by side, from the ones up; they start so that the first distance over the radius carries out of the top.
    """
    queries = queries.reshape(len(queries), -1)
    n_bits = max(1, radius.bit_length())
    start = (1 << n_bits) - 1 - radius
    out = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    counters = [np.full(len(queries), 0xFFFFFFFFFFFFFFFF if start >> i & 1 else 0, np.uint64) for i in range(n_bits)]
    over = np.zeros(len(queries), np.uint64)
    for b in range(len(planes)):
        asked = (queries[live, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        carry = planes[b, block[live]] ^ (np.uint64(0) - asked)
        for i in range(n_bits):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if b % 8 == 7 and b >= radius and b < len(planes) - 1:
            left = (wanted[live] & ~over) != 0
            if not left.all():  # blocks abandoned: nothing wanted in them is within the radius any more
                live, over, counters = live[left], over[left], [c[left] for c in counters]
                if not len(live):
                    break
    out[live] = wanted[live] & ~over
    return out


def bucket_links(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links as positions (smaller root, member), at most one less than the members of each connected part.

    values: fingerprints in order of buckets; ends: for each position, where its bucket ends.
    """
    n = len(values)
    planes, place = planes_of(values), np.arange(n)
    root = np.arange(n)
    for ahead in range(int(((ends - 1) // 64 - place // 64).max(initial=0)) + 1):
        block = place // 64 + ahead
        low = np.maximum(place + 1 - block * 64, 0)
        high = np.minimum(ends - block * 64, 64)
        active = np.flatnonzero(high > low)
        if not len(active):
            continue
        shift = np.minimum(low[active], 63).astype(np.uint64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - high[active]).astype(np.uint64)
        wanted = top & (np.uint64(0xFFFFFFFFFFFFFFFF) << shift)
        found = near(values[active], planes, block[active], wanted, radius)
        _join_found(root, found, active, place, block[active])
    root = _flat(root)
    member = np.flatnonzero(root != place)
    return root[member], member


def asked_links(values: np.ndarray, labels: np.ndarray, asks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links as positions between those that ask and those that do not, as a forest over the labels: positions of one label count as joined already."""
    asking, others = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(asking) or not len(others):
        return asking[:0], asking[:0]
    _, first, own = np.unique(labels, return_index=True, return_inverse=True)
    root = first[own]
    before, planes = root.copy(), planes_of(values[others])
    for k in range(planes.shape[1]):
        wanted = np.full(len(asking), np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - min(64, len(others) - 64 * k)))
        block = np.full(len(asking), k)
        _join_found(root, near(values[asking], planes, block, wanted, radius), asking, others, block)
    root = _flat(root)
    member = np.flatnonzero((root != before) & (before == np.arange(len(root))))
    return root[member], member


def _join_found(root: np.ndarray, found: np.ndarray, queries: np.ndarray, others: np.ndarray, block: np.ndarray) -> None:
    """Unites queries[i] with the others that found[i] marks within block[i]; a round for each of a query's links."""
    hit = np.flatnonzero(found)
    while len(hit):
        word = found[hit]
        lowest = word & (np.uint64(0) - word)
        _join(root, queries[hit], others[block[hit] * 64 + np.log2(lowest.astype(np.float64)).astype(np.int64)])
        found[hit] = word & ~lowest
        hit = hit[found[hit] != 0]


def _flat(root: np.ndarray) -> np.ndarray:
    while not (root[root] == root).all():
        root = root[root]
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the components of links (a, b): from the smallest node of each to its others."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = np.arange(len(nodes))
    _join(root, at[: len(a)], at[len(a) :])
    root = _flat(root)
    member = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[member]], nodes[member]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the parts of a[i] and b[i]; root points towards the smallest position of a part."""
    while len(a):
        ra, rb = root[a], root[b]
        while True:
            na, nb = root[ra], root[rb]
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            return
        a, b = low[open_], high[open_]
        np.minimum.at(root, b, a)


def _groups(batches: Iterator[pa.RecordBatch], most_rows: int = 1 << 16, most_bytes: int = 1 << 24) -> Iterator[pa.Table]:
    """Rows sorted by their first column, in tables that hold all rows of its values."""
    held, rows, size = [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= most_rows or size >= most_bytes:
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last value may go on
            if cut:
                yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), rows - cut
            size = sum(h.nbytes for h in held)
    if rows:
        yield pa.Table.from_batches(held)


def _ends(keys: np.ndarray) -> np.ndarray:
    """For each position of sorted keys, where its run ends."""
    edges = np.flatnonzero(np.diff(keys, append=~keys[-1:]) != 0) + 1
    return np.repeat(edges, np.diff(edges, prepend=0))


def links(distinct: DataFrame, most_in_bucket: int = 1024) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs within two bits."""
    def bucket(k: int, pair: tuple[int, int]):
        value = F.lit(0).cast("long")
        for q in pair:
            value = F.shiftleft(value, 16).bitwiseOR(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF)))
        return F.shiftleft(F.lit(k).cast("long"), 32).bitwiseOR(value)

    keyed = distinct.select(F.explode(F.array(*[bucket(k, p) for k, p in enumerate(PAIRS)])).alias("bucket"), F.col("fp").alias("node"))
    own = lambda table: table.column("node").to_numpy().view(np.uint64)
    return exact_links(keyed, _sliced(own, RADIUS), _sliced_asked(own, RADIUS), most_in_bucket)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the smallest node reachable) for every node of edges (a, b: longs), by large-star and small-star rounds."""
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        if _settled(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        # large star: every larger neighbour of b is linked to b's smallest neighbour (or b itself)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: every smaller neighbour of b, and b, are linked to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b"))
        before, edges = edges, stage(small.where("a <> b").distinct(), "links")
        drop_staged(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether every node is either a root or linked to one root only; then the root is its component's smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("n")).unionByName(edges.select(F.col("b").alias("node"), F.lit(1).alias("n")))
    return ends.groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("is_b"), F.min("n").alias("is_a")).where("n > 1 OR (is_b = 1 AND is_a = 0)").isEmpty()


def near_duplicates(docs: DataFrame, most_in_bucket: int = 1024) -> DataFrame:
    """doc_id, fp and component_id of docs (doc_id, text)."""
    marked = stage(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), most_in_bucket))
    grouped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = grouped.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp")


WIDE = 4  # words of a wide fingerprint
BANDS, BAND_ROWS = 32, 8
MULTIPLIERS = np.random.default_rng(13).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PIVOTS = 64


def radius_for(similarity: float, n_bits: int = 64 * WIDE) -> tuple[int, float]:
    """(radius, chance that a bit differs) of texts of this Jaccard similarity. The radius admits candidates only, so it lies 3 standard deviations above the mean."""
    differs = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(n_bits * differs + 3 * (n_bits * differs * (1 - differs)) ** 0.5), differs


def bands_of(hashes: np.ndarray) -> bytes:
    """BANDS buckets (64 bits each) of a set of hashes: of each band's BAND_ROWS minima over the set, each under a random odd multiplier. Nothing for an empty set."""
    if not len(hashes):
        return b""
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * MULTIPLIERS).min(axis=0), out=least)
    mixed = ((least >> np.uint64(29)) ^ least).reshape(BANDS, BAND_ROWS) * MULTIPLIERS[:BAND_ROWS]
    return _mix(mixed.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 1).astype("<u8").tobytes()


def shingle_sets(rows: DataFrame, made: dict, shingle: int = 5) -> DataFrame:
    """rows without text, with binary columns made from the sorted distinct hashes of its shingles."""
    small_batches(rows.sparkSession)
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[] for _ in made]
            for t in b.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                for own, f in zip(found, made.values(), strict=True):
                    own.append(f(hashes))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), *(pa.array(own, pa.binary()) for own in found)], [*(f.name for f in others), *made])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), *(f"{name} binary" for name in made)]))


def wide_fingerprints(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """rows without text, with fp (binary, 32 bytes) of the distinct shingles, key, equal for equal sets of them only, and bands."""
    return shingle_sets(rows, {"fp": lambda h: majority([h], WIDE).tobytes(), "key": lambda h: xxhash.xxh128_digest(h.tobytes()), "bands": bands_of}, shingle)


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WIDE)


def buckets(distinct: DataFrame) -> DataFrame:
    """bucket, node and fp of distinct (node, fp, bands): a row for each band."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = np.frombuffer(b"".join(b.column("bands").to_pylist()), "<u8").reshape(b.num_rows, -1)
            for t in range(bands.shape[1] if b.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(bands[:, t].astype(np.uint64).view(np.int64)), b.column("node"), b.column("fp")], ["bucket", "node", "fp"])

    return distinct.where(F.length("bands") > 0).select("node", "fp", "bands").mapInArrow(run, "bucket long, node long, fp binary")


def _link(labels: np.ndarray, asks: np.ndarray | None, hits) -> tuple[list[int], list[int]]:
    """Links as positions: those of a spanning tree over all hits between different labels. Each position that asks meets those that do not; without asks, all meet. hits(k, others): which of others k is linked to."""
    part = np.unique(labels, return_inverse=True)[1]
    place = np.arange(len(part))
    others = place if asks is None else np.flatnonzero(~asks)
    low, high = [], []
    for k in (place if asks is None else np.flatnonzero(asks)).tolist():
        open_ = others[part[others] != part[k]]
        open_ = open_[open_ > k] if asks is None else open_
        if not len(open_):
            continue
        found = open_[hits(k, open_)]
        for x in found.tolist():
            if part[x] != part[k]:
                part[part == part[x]] = part[k]
                low.append(k)
                high.append(x)
    return low, high


def _similar(sets: list[bytes], similarity: float):
    """For _link(): sets of hashes of the Jaccard similarity or more, by their exact intersections."""
    sizes = np.array([len(x) // 8 for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    kinds, ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)

    def hits(k: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        asked = np.flatnonzero(np.minimum(sizes[others], sizes[k]) >= similarity * np.maximum(sizes[others], sizes[k]) - 1e-6)
        if not len(asked):
            return out
        mark, own = np.zeros(len(kinds), bool), others[asked]
        mark[ids[starts[k] : ends[k]]] = True
        if len(own) * 8 < len(sizes):
            both = np.array([np.count_nonzero(mark[ids[starts[x] : ends[x]]]) for x in own.tolist()])
        else:
            sums = np.concatenate([[0], np.cumsum(mark[ids])])
            both = sums[ends[own]] - sums[starts[own]]
        out[asked] = both / np.maximum(sizes[own] + sizes[k] - both, 1) >= similarity
        return out

    return hits


def _run(links_of):
    """For mapInArrow(): links of rows (bucket, node, others) sorted by bucket and node, as forests; links_of(table) gives positions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            nodes = table.column("node").to_numpy()
            low, high = (np.asarray(x, np.int64) for x in links_of(table))
            a, b = forest(nodes[low], nodes[high])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _each_bucket(link):
    """links_of(table) by link(bucket's rows)."""
    def links_of(table: pa.Table) -> tuple[list[int], list[int]]:
        ends, start, low, high = _ends(table.column("bucket").to_numpy()), 0, [], []
        while start < len(ends):
            stop = int(ends[start])
            if stop - start > 1:
                a, b = link(table.slice(start, stop - start))
                low.extend(start + int(x) for x in a)
                high.extend(start + int(x) for x in b)
            start = stop
        return low, high

    return links_of


def _labels_and_asks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("label").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)


def _sliced(values_of, radius: int):
    """All pairs within the radius, bit-sliced, in all buckets of a table at once."""
    return lambda table: bucket_links(values_of(table), _ends(table.column("bucket").to_numpy()), radius)


def _sliced_asked(values_of, radius: int):
    return _each_bucket(lambda rows: asked_links(values_of(rows), *_labels_and_asks(rows), radius))


def exact_links(rows: DataFrame, all_pairs, asked_pairs, most: int, weight: Column | None = None) -> DataFrame:
    """Links (a, b) between nodes whose components are those of all hits within a bucket of rows (bucket, node, others). all_pairs(table), asked_pairs(table): links as positions of sorted rows.

    Buckets over most (in rows, or by weight) are dealt in blocks. Within a block, and to the bucket's pivots, all are compared. What the links so far put together
    need not meet; so each member outside the bucket's largest component then meets all members of other components, in blocks again.
    """
    spark, weight = rows.sparkSession, F.lit(1).cast("long") if weight is None else weight
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def compared(dealt: DataFrame, links_of) -> DataFrame:
        return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(_run(links_of), "a long, b long")

    kept = [c for c in rows.columns if c != "bucket"]
    met = stage(rows.groupBy("bucket").agg(F.sum(weight).alias("w"), F.count("*").alias("n")).where((F.col("w") > most) & (F.col("n") > 1)), "crowded")
    number = met.count()
    few = lambda df: F.broadcast(df) if number <= 100_000 else df
    if not number:
        return compared(rows.select("bucket", *kept), all_pairs)
    links = compared(rows.join(few(met.select("bucket")), "bucket", "left_anti").select("bucket", *kept), all_pairs)
    salts = F.ceil(F.col("w") / most).cast("int")
    rest = stage(rows.join(few(met), "bucket").withColumn("salts", salts).withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("salts")).cast("int")), "crowded-rows")
    pivots = rest.where(F.pmod(F.xxhash64("node", "bucket"), F.col("n")) < PIVOTS).withColumn("own", F.col("salt"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).where("salt <> own").drop("own")
    blocks = rest.unionByName(pivots).select(F.xxhash64("bucket", "salt").alias("bucket"), *kept)
    links = stage(links.unionByName(compared(blocks, all_pairs)), "block-links")
    labelled = stage(rest.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root"), "labelled")
    parts = labelled.groupBy("bucket", "label").agg(F.sum(weight).alias("w"))
    main = parts.groupBy("bucket").agg(F.max_by("label", "w").alias("main"), (F.sum("w") - F.max("w")).alias("others")).where("others > 0")
    open_ = labelled.join(few(main), "bucket").withColumn("chunks", F.ceil(F.col("others") / most).cast("int"))
    asking = open_.where("label <> main").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(-2)), F.col("chunks")).cast("int"))
    asking = asking.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("asks", F.lit(True))
    asked = open_.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
    dealt = asking.unionByName(asked).select(F.xxhash64("bucket", "salt", "chunk").alias("bucket"), *kept, "label", "asks")
    return links.unionByName(compared(dealt, asked_pairs))


def similar_links(distinct: DataFrame, similarity: float = 0.8, most_in_bucket: int = 1024) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes of distinct (node, fp: wide fingerprints, bands) that share a bucket and are within the similarity's radius."""
    radius, _ = radius_for(similarity)
    own = lambda table: _words(table.column("fp"))
    return exact_links(buckets(distinct), _sliced(own, radius), _sliced_asked(own, radius), most_in_bucket)


def similar_sets(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes of rows (bucket, node, data: sorted hashes) of a bucket with the Jaccard similarity or more."""
    sets = lambda table: _similar(table.column("data").to_pylist(), similarity)
    all_pairs = _each_bucket(lambda table: _link(table.column("node").to_numpy(), None, sets(table)))
    asked = _each_bucket(lambda table: _link(*_labels_and_asks(table), sets(table)))
    return exact_links(rows, all_pairs, asked, most, F.ceil((F.length("data") + 1) / 4096))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, most_in_bucket: int = 1024) -> DataFrame:
    """docs (doc_id, text, others) with one row of each group of near-duplicates: that of the smallest doc_id (null ones last); of equal rows, one. Texts without words are one group."""
    numbered = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    marked = stage(wide_fingerprints(numbered.select("row", "doc.doc_id", "doc.text"), shingle), "wide-fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("row"))).alias("least")
    distinct = stage(marked.groupBy("key", "fp").agg(least, F.first("bands").alias("bands")).withColumn("node", F.col("least.row")), "distinct")
    found = components(similar_links(distinct, similarity, most_in_bucket))
    roots = components(similar_sets(candidate_sets(numbered, found, shingle), similarity, most_in_bucket))
    grouped = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = grouped.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    gone = marked.select("row").join(kept, "row", "left_anti")
    rest = without(numbered, gone, "row").select("doc.*")
    for done in (marked, distinct):  # the rows that go are written
        drop_staged(done)
    return rest


def candidate_sets(numbered: DataFrame, found: DataFrame, shingle: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """bucket (the component of found), node and data (the distinct shingle hashes) of the members of found (node, root)."""
    members = stage(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "candidates")
    texts = numbered.select(F.col("row").alias("node"), "doc.text").join(F.broadcast(members) if members.count() <= most_broadcast else members, "node")
    return stage(shingle_sets(texts.select(F.col("root").alias("bucket"), "node", "text"), {"data": lambda h: h.tobytes()}, shingle), "shingle-sets")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash": op7_simhash}
ORACLES: dict[str, str] = {}
