"""Packing of documents into training sequences by sum-of-squares online placement.

A document's ids (with its end id) are cut into whole windows and a remainder. The remainder goes to the fill level that minimises
the sum over levels of the squared counts of partially filled windows: with N[h] windows filled to h, placing s ids at level h
changes the sum by -2 N[h] + 1 (leaving level h) plus 2 N[h+s] + 1 (entering h+s; nothing when the window is full then).
The counts live in one array of levels, so a placement is one vector minimum. At the end of a task's rows the windows
still open are poured together, cutting documents where a window is full, so a task leaves at most one short window. The same is done whenever most_open windows are
open (documents of just over half a window never fit together), and the short window that is left stays open. So a task holds most_open windows of ids at most.

Every task packs the rows of its input split and keeps only the open windows; nothing is shuffled. A retried task gives the same rows,
as its split and its order of rows are the same.

Defined results: a null or empty text is its end id alone. Repeated rows are packed one by one. An empty table gives an empty result.
A null doc_id is kept. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import shared_bpe
from .common import read_table, small_batches

LENGTH, END = 2048, 1
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SquaresPacker:
    """Places pieces (doc_id, start, doc_tokens, ids bytes) online; a full window comes back from add()."""

    def __init__(self, length: int = LENGTH, most_open: int = 2048):
        self.length, self.most_open, self.n_open = length, most_open, 0
        self.counts = np.zeros(length + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def add(self, piece: tuple) -> list | None:
        size = len(piece[3]) // 4
        if size == self.length:
            return [piece]
        room = self.length - size
        held = self.counts[: room + 1]
        change = 2 * (self.counts[size:] - held) + 2
        change[room] = 1 - 2 * held[room]  # the window is full and no longer counts
        change[held == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.counts[size] + 1  # a new window
        level = int(change.argmin())
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            return window
        self._keep(window, level + size)
        return None

    def _keep(self, window: list[tuple], level: int) -> None:
        self.open.setdefault(level, []).append(window)
        self.counts[level] += 1
        self.n_open += 1

    def relieve(self) -> Iterator[list]:
        """Full windows poured from the open ones, if these are most_open; the rest stays open."""
        if self.n_open >= self.most_open:
            for window in list(self.close()):
                size = sum(len(p[3]) // 4 for p in window)
                if size == self.length:
                    yield window
                else:
                    self._keep(window, size)

    def close(self) -> Iterator[list]:
        """The open windows poured together, fullest first; all but the last are full."""
        window, room = [], self.length
        for level in sorted(self.open, reverse=True):
            for pieces in self.open[level]:
                for doc_id, start, total, ids in pieces:
                    while ids:
                        part, ids = ids[: 4 * room], ids[4 * room :]
                        window.append((doc_id, start, total, part))
                        start, room = start + len(part) // 4, room - len(part) // 4
                        if not room:
                            yield window
                            window, room = [], self.length
        self.open.clear()
        self.counts[:], self.n_open = 0, 0
        if window:
            yield window


def pack_rows(rows: Iterator[tuple], packer: SquaresPacker) -> Iterator[list]:
    """Windows, each a list of pieces, from rows (doc_id, ids bytes with the end id)."""
    step = 4 * packer.length
    for doc_id, ids in rows:
        total = len(ids) // 4
        for at in range(0, len(ids), step):
            if (window := packer.add((doc_id, at // 4, total, ids[at : at + step]))) is not None:
                yield window
        yield from packer.relieve()
    yield from packer.close()


def _batches(windows: Iterator[list], base: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    rows, held = [], 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for n, window in enumerate(windows):
        offset = 0
        for doc_id, start, total, ids in window:
            rows.append((doc_id, start, len(ids) // 4, total, base + n, offset, ids))
            offset += len(ids) // 4
        held += 4 * offset
        if held >= most_bytes:
            yield flush()
            rows, held = [], 0
    if rows:
        yield flush()


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    small_batches(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared_bpe(tokenizer)
        rows = ((doc_id, bpe.ids_of(text or "") + end) for b in batches for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from _batches(pack_rows(rows, SquaresPacker(length)), TaskContext.get().partitionId() << 40)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
