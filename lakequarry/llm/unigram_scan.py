"""SentencePiece encoding and decoding by unigram Viterbi, with a max-plus parallel scan over chunks of giant documents.

Encoding finds the pieces of the largest total score, with the scores that the model file holds, in fixed point (whole where the file's are whole, else in steps
of 2**-20), so that sums are exact. A blank is written as U+2581, one goes before the text, and characters without a piece become byte pieces. Among equal totals the path is that which,
from the end backwards, always takes the piece that begins first.

No piece has U+2581 after another character, so every best path has a cut before a blank that follows a word; and one between
characters that no pieces link, as letters and stops. Texts up to chunk_chars are cut there, and each worker keeps the pieces of the words it has seen in a bounded cache, which drops its older half when it is full. A longer text is cut into chunks, which go to different tasks:

1. Each chunk yields a transfer matrix: from "the first cut at or after the chunk's begin is s characters on" to the same at its end, the best score.
   s is below the longest piece's length. Where the chunk has certain cuts, the matrix is the sum of a head, a middle and a tail.
2. Matrices combine by the associative max-plus product: runs of 64 chunks in parallel, then a document's runs, then back into the runs. So each chunk learns
   the best score of every state at its begin.
   The pieces between a chunk's first and last certain cut never depend on its begin: they are found once, with the matrix, and stand for that text from then on.
3. With these, each chunk is traced back independently, for every state at its end: the ids, and the state at its begin that they come from. The document's states are then
   looked up from its end. The rule for equal totals looks at exact best scores only, so the ids are those of the whole text, whatever chunk_chars is.

decode() joins the pieces' bytes; decode(encode(text)) is the text, for every text (U+2581 itself is encoded as bytes).

Defined results: a null text stays null, with null ids; an empty one has no ids. Repeated rows stay. An empty table gives an empty result. Columns of any other names than text are
carried as they are, but ids, path_score and decoded, which the results replace.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, stage

BLANK, OWN_BLANK = "▁", "\ud800"  # the second stands for a U+2581 of the text itself
NEVER = -(1 << 60)
RUN = 64  # chunks whose matrices one task combines


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The pieces of a SentencePiece model file, and best paths over them."""

    def __init__(self, path: str | None = None, cache: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {sp.id_to_piece(i): i for i in plain}
        raw = {p: sp.get_score(i) for p, i in self.id.items()}
        self.scale = 1 if all(x == round(x) for x in raw.values()) else 1 << 20
        self.score = {p: round(x * self.scale) for p, x in raw.items()}
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10 * self.scale
        self.begins: dict[str, int | None] = {p[:n]: None for p in self.score for n in range(1, len(p))} | self.score  # every begin of a piece, with the score where it is one
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        self.raw = [b""] * len(ids)
        for p, i in self.id.items():
            self.raw[i] = p.replace(BLANK, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.id):
            raise ValueError("a piece has a blank after another character")
        self.single = {p for p in self.score if len(p) == 1}
        self.cut = re.compile(words_between_cuts(self.id)).findall
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), self.score[p], i))
        self.automaton.make_automaton()
        self.most, self.seen, self.older = cache, {}, {}

    def of(self, text: str, start: int, end: int) -> int | None:
        """Score of text[start:end] as one piece."""
        found = self.score.get(text[start:end])
        return self.unknown if found is None and end == start + 1 else found

    def forward(self, text: str, starts: dict[int, int], last: int, stop: int) -> tuple[dict[int, int], dict[int, int]]:
        """(best, back) from scores of starts: each place's best score and where its last piece begins (none for a start that nothing beats). Pieces begin before last and end at stop at most."""
        best, back = dict(starts), {}
        known, unknown, longest = self.begins, self.unknown, self.longest
        for s in range(min(starts), last):
            if (own := best.get(s)) is None:
                continue
            for end in range(s + 1, min(s + longest, stop) + 1):
                if (x := known.get(text[s:end], NEVER)) is NEVER and end > s + 1:
                    break  # no piece begins with this
                if x is NEVER or x is None:
                    if end > s + 1:
                        continue
                    x = unknown
                if end not in best or own + x > best[end]:
                    best[end], back[end] = own + x, s
        return best, back

    def path(self, text: str, start: int, stop: int, inner: int | None = None) -> tuple[int, list[int]]:
        """(score, cuts) of the best path from start to stop; inner: all cuts but the last are below it. NEVER if there is none."""
        best, back = self.forward(text, {start: 0}, stop if inner is None else min(inner, stop), stop)
        return (best[stop], cuts_to(back, stop)) if stop in best else (NEVER, [])

    def ids(self, text: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            found = self.id.get(text[a:b])
            out.extend([found] if found is not None else [self.byte[x] for x in text[a:b].replace(OWN_BLANK, BLANK).encode()])
        return out

    def word(self, word: str) -> tuple[bytes, int]:
        """(ids as little-endian 32-bit bytes, score) of a word between certain cuts."""
        if (found := self.seen.get(word)) is None:
            if len(self.seen) >= self.most // 2:
                self.seen, self.older = {}, self.seen
            self.seen[word] = found = self.older.get(word) or (self._known(word) if self.single.issuperset(word) else self._any(word))
        return found

    def _any(self, word: str) -> tuple[bytes, int]:
        score, cuts = self.path(word, 0, len(word))
        return np.array(self.ids(word, cuts), "<u4").tobytes(), score

    def _known(self, word: str) -> tuple[bytes, int]:
        """As _any, for words all of whose characters are pieces: the automaton gives every piece in a word, by its end and then by its begin."""
        best, piece = [NEVER] * len(word) + [0], [None] * len(word)  # by a place's last character; the last entry, at -1, is the begin
        for end, found in self.automaton.iter(word):
            own = best[end - found[0]] + found[1]
            if own > best[end]:
                best[end], piece[end] = own, found
        at, out = len(word) - 1, array("I")
        while at >= 0:
            size, _, one = piece[at]
            out.append(one)
            at -= size
        out.reverse()
        return out.tobytes(), best[-2] if word else 0

    def words(self, text: str) -> tuple[bytes, int]:
        own = [self.seen.get(w) or self.word(w) for w in self.cut(text)]
        return b"".join([x[0] for x in own]), sum(x[1] for x in own)

    def decode(self, ids: bytes) -> str:
        found = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return found[1:].decode(errors="replace")  # without the blank that encoding puts first


def words_between_cuts(pieces: Iterable[str]) -> str:
    """A pattern of words with certain cuts around them: blanks and characters of one group. No piece joins characters of two groups: the largest set of characters that pieces link with each other, other ones in pieces of several characters, and all the rest."""
    group: dict[str, set[str]] = {}
    for p in pieces:
        own = set(p.lstrip(BLANK)) if len(p) > 1 else set()
        linked = own.union(*[group[c] for c in own if c in group])
        if any(group.get(c) is not linked and group.get(c) != linked for c in own):
            group |= dict.fromkeys(linked, linked)
    largest = max(group.values(), key=len, default=set())
    most, others = ("".join(map(re.escape, sorted(x))) for x in (largest, group.keys() - largest))
    return "|".join([*(f"{BLANK}*[{x}]+" for x in (most, others) if x), f"{BLANK}+", f"[^{BLANK}{most}{others}]+"])


def cuts_to(back: dict[int, int], stop: int) -> list[int]:
    cuts = [stop]
    while cuts[-1] in back:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


@lru_cache(maxsize=1)
def shared_pieces(path: str | None = None) -> Pieces:
    return Pieces(path)


def written(text: str) -> str:
    """The text as the pieces write it; empty for an empty one."""
    return BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK) if text else ""


def certain_cuts(text: str, start: int, stop: int) -> tuple[int, int] | None:
    """First and last place from start to stop, both included, where every path is cut; None without any."""
    found = [m.start() + 1 for m in re.finditer(f"[^{BLANK}]{BLANK}", text[max(0, start - 1) : stop + 1])]
    return (found[0] + max(0, start - 1), found[-1] + max(0, start - 1)) if found else None


def between(pieces: Pieces, text: str, size: int) -> tuple[int, int, bytes, int] | None:
    """First and last certain cut of a chunk, with the ids and the score between them; None without any."""
    cut = certain_cuts(text, 0, size)
    return (*cut, *pieces.words(text[cut[0] : cut[1]])) if cut else None


def transfer(pieces: Pieces, text: str, size: int, known: tuple[int, int, bytes, int] | None = None) -> np.ndarray:
    """The transfer matrix of a chunk: of its size characters, text has longest - 1 more (fewer at the document's end). known: what between() gives, if it was asked."""
    n = pieces.longest
    out = np.full((n, n), NEVER, np.int64)
    ends = range(min(n, len(text) - size + 1))
    known = known or between(pieces, text, size)
    if known:
        first, last, _, middle = known
        head = [pieces.path(text, s, first)[0] if s <= first else NEVER for s in range(n)]
        tail = [pieces.path(text, last, size + t, size)[0] if last < size or t == 0 else NEVER for t in ends]
        for s, a in enumerate(head):
            for t, b in enumerate(tail):
                if a > NEVER and b > NEVER:
                    out[s, t] = a + middle + b
        return out
    # no certain cut: all states at once, a vector a place
    best = np.full((size + len(ends), n), NEVER, np.int64)
    for s in range(min(n, len(best))):
        best[s, s] = 0
    for end in range(1, len(best)):
        for s in range(max(0, end - n), min(end, size)):
            if (x := pieces.of(text, s, end)) is not None:
                best[end] = np.maximum(best[end], np.where(best[s] > NEVER, best[s] + x, NEVER))
    for t in ends:
        out[:, t] = best[size + t]
    for s in range(size + 1, n):  # a begin after the end, where a chunk is shorter than a piece
        if s - size < n:
            out[s, s - size] = 0
    return out


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    found = (a[:, :, None] + b[None, :, :]).max(axis=1)
    return np.where(found < NEVER // 2, NEVER, found)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """All combined, as a tree."""
    while len(matrices) > 1:
        matrices = [combine(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def scores_before(start: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The states' best scores before each matrix, and after the last, from those at the start."""
    found = [start]
    for m in matrices:
        found.append(combine(found[-1][None, :], m)[0])
    return found


def first_state(n: int) -> np.ndarray:
    return np.where(np.arange(n) == 0, 0, NEVER)


def trace(pieces: Pieces, text: str, size: int, before: np.ndarray, at: int | None = None, middle: bytes = b"") -> tuple[list[int], bytes, list[bytes]]:
    """(state at the chunk's begin, for each state at its end; ids that all of these have; the ids after them for each), from the best scores of the states at its begin.

    States that cannot be reached have -1 and no ids. middle: ids that stand, at a place, for the text between the certain cuts; text and size are then without it.
    """
    n = pieces.longest
    starts = {s: int(x) for s, x in enumerate(before.tolist()) if x > NEVER and s <= max(size, 0)}
    coded = lambda cuts: np.array(pieces.ids(text, cuts), "<u4").tobytes()
    cut = certain_cuts(text, 0, size) if at is None else (at, at)
    ends = range(min(n, len(text) - size + 1))
    states, tails = [-1] * n, [b""] * n
    if cut:
        first, last = cut
        head = cuts_to(pieces.forward(text, {s: x for s, x in starts.items() if s <= first}, first, first)[1], first)
        best, back = pieces.forward(text, {last: 0}, size, size + n - 1)
        for t in ends:
            if (size + t in best) and (last < size or t == 0):
                states[t], tails[t] = head[0], coded(cuts_to(back, size + t))
        return states, coded(head) + (pieces.words(text[first:last])[0] if at is None else middle), tails
    best, back = pieces.forward(text, starts, size, size + n - 1)
    found = {t: cuts_to(back, size + t) for t in ends if size + t in best}
    if not found:
        return states, b"", tails
    shared = 0
    while all(len(c) > shared and c[shared] == next(iter(found.values()))[shared] for c in found.values()):
        shared += 1
    shared = max(shared, 1)
    for t, cuts in found.items():
        states[t], tails[t] = cuts[0], coded(cuts[shared - 1 :])
    alike = len({c[0] for c in found.values()}) == 1
    return states, coded(next(iter(found.values()))[:shared]) if alike else b"", tails


def packed(ids: bytes) -> bytes:
    """Ids compressed, by their bytes' places."""
    return zlib.compress(np.frombuffer(ids, np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> bytes:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T.tobytes()


def joined(parts: list[tuple[list[int], bytes, list[bytes]]]) -> bytes:
    """A document's ids from its chunks' traces."""
    state, out = 0, []
    for states, own, tails in reversed(parts):
        out.append(own + tails[state])
        state = states[state]
    return b"".join(reversed(out))


def encode(docs: DataFrame, chunk_chars: int = 16_384, model: str | None = None) -> DataFrame:
    """docs (doc_id, text, others) with ids (little-endian unsigned 32-bit) and path_score (long)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("ids", "path_score")
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "ids binary, path_score long"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for b in batches:
            for part in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                found = [(None, None) if t is None else pieces.words(written(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int64())], [*part.schema.names, "ids", "path_score"])

    giant = F.coalesce(F.length("text") > chunk_chars, F.lit(False))
    short = docs.where(~giant).mapInArrow(whole, kinds)
    return short.unionByName(encode_chunked(docs.where(giant), chunk_chars, model))


def _chunks(longest: int, chunk_chars: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows row, chunk, size and part of rows (row, text)."""
    for b in batches:
        for k, row in enumerate(b.column("row").to_pylist()):
            text = written(b.column("text")[k].as_py())
            sizes = [min(chunk_chars, len(text) - at) for at in range(0, len(text), chunk_chars)]
            parts = [text[at : at + chunk_chars + longest - 1].encode("utf-8", "surrogatepass") for at in range(0, len(text), chunk_chars)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], ["row", "chunk", "size", "part"])


def encode_chunked(docs: DataFrame, chunk_chars: int = 16_384, model: str | None = None) -> DataFrame:
    """As encode, with every text cut into chunks that are worked on in different tasks. Texts are not null."""
    spark = docs.sparkSession
    longest = shared_pieces(model).longest
    if chunk_chars < longest:
        raise ValueError("a chunk must hold the longest piece")
    numbered = stage(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "giant-texts")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)

        def one(text: str, size: int) -> tuple[int, bytes, int | None, bytes | None, bytes]:
            known = between(pieces, text, size)
            matrix = zlib.compress(transfer(pieces, text, size, known).tobytes(), 1)
            first, last, ids = known[:3] if known else (None, None, None)
            rest = text[:first] + text[last:] if known else text
            return size - (last - first if known else 0), rest.encode("utf-8", "surrogatepass"), first, packed(ids) if known else None, matrix

        for b in batches:
            found = [one(p.as_py().decode("utf-8", "surrogatepass"), s.as_py()) for p, s in zip(b.column("part"), b.column("size"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True))], ["row", "chunk", "size", "part", "at", "middle", "matrix"])

    def of(table: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(zlib.decompress(m.as_py()), np.int64).reshape(longest, longest) for m in table.column("matrix")]

    def combined(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        return pa.table({"row": table.column("row")[:1], "run": table.column("run")[:1], "matrix": pa.array([zlib.compress(product(of(table)).tobytes(), 1)], pa.binary())})

    def over_runs(table: pa.Table) -> pa.Table:
        table = table.sort_by("run")
        found = scores_before(first_state(longest), of(table))
        return pa.table({"row": table.column("row"), "run": table.column("run"), "before": pa.array([x.tobytes() for x in found[:-1]], pa.binary()), "path_score": pa.array([int(found[-1][0])] * len(table), pa.int64())})

    def within_runs(chunks: pa.Table, runs: pa.Table) -> pa.Table:
        chunks = chunks.sort_by("chunk")
        found = scores_before(np.frombuffer(runs.column("before")[0].as_py(), np.int64), of(chunks))
        return pa.table({"row": chunks.column("row"), "chunk": chunks.column("chunk"), "before": pa.array([x.tobytes() for x in found[:-1]], pa.binary()), "path_score": pa.array([runs.column("path_score")[0].as_py()] * len(chunks), pa.int64())})

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for b in batches:
            found = []
            for r in b.select(["part", "size", "before", "at", "middle"]).to_pylist():
                states, own, tails = trace(pieces, r["part"].decode("utf-8", "surrogatepass"), r["size"], np.frombuffer(r["before"], np.int64), r["at"], b"" if r["middle"] is None else unpacked(r["middle"]))
                found.append((states, packed(own), tails))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), b.column("path_score"), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), (pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())), strict=True))], ["row", "chunk", "path_score", "states", "own", "tails"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        parts = [(states, unpacked(own), tails) for states, own, tails in zip(*(table.column(c).to_pylist() for c in ("states", "own", "tails")), strict=True)]
        return pa.table({"row": table.column("row")[:1], "ids": pa.array([joined(parts)], pa.binary()), "path_score": table.column("path_score")[:1]})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = "row long, chunk long, size long, part binary"
    cut = numbered.select("row", F.col("doc.text").alias("text")).mapInArrow(lambda it: _chunks(longest, chunk_chars, it), chunks).repartition(tasks, "row", "chunk")
    measured = stage(cut.mapInArrow(matrices, f"{chunks}, at long, middle binary, matrix binary"), "chunk-matrices")
    own = measured.select("row", "chunk", (F.col("chunk") / RUN).cast("long").alias("run"), "matrix")
    runs = own.groupBy("row", "run").applyInArrow(combined, "row long, run long, matrix binary").groupBy("row").applyInArrow(over_runs, "row long, run long, before binary, path_score long")
    known = own.groupBy("row", "run").cogroup(runs.groupBy("row", "run")).applyInArrow(within_runs, "row long, chunk long, before binary, path_score long")
    parts = measured.drop("matrix").join(known, ["row", "chunk"]).mapInArrow(traced, "row long, chunk long, path_score long, states array<int>, own binary, tails array<binary>")
    found = parts.groupBy("row").applyInArrow(whole, "row long, ids binary, path_score long")
    return numbered.join(found, "row").select("doc.*", "ids", "path_score")


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows (ids, others) with decoded (string); null ids give null."""
    rows = rows.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces(model)
        for b in batches:
            for part in (b.slice(k, 1000) for k in range(0, b.num_rows, 1000)):
                found = [None if x is None else pieces.decode(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "decoded string"]))


def op8_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # hashed before encoding, so that giant texts are not carried through its last join
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    slim = encode(docs).select("doc_id", "text_hash", "ids", "path_score")
    found = decode(slim)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_ids")
    return found.select("doc_id", n, F.crc32("ids").alias("ids_crc32"), "path_score", (F.xxhash64("decoded") == F.col("text_hash")).alias("round_trip"))


QUERIES = {"op8_unigram": op8_unigram}
ORACLES: dict[str, str] = {}
