r"""Repair of conversations: the cheapest edits that make roles a legal sequence, by composition of weighted finite-state machines.

A conversation's rows are an input acceptor, one symbol a row: the role's initial and the row's fault. An edit transducer of one state turns each symbol into itself (Keep), another role (Rerole) or nothing (Delete), and nothing
into a role (Insert). An acceptor of roles, (s?(ua)+)? by initials, reads what comes out. The composition is made lazily: its states are (rows read, state of the role grammar, inserts since), and arcs() and inserts() give the arcs of
one state when they are asked for. More than two inserts in a row come back to where they began at a higher cost, so two are allowed and the composition has no cycles. Its states are visited in reverse topological
order, last row first; each keeps the least weight (cost, label string) to the end. Weights are compared as pairs and extended on the left, which keeps their order, so the result is the cheapest and, of the cheapest, the
ASCII-least string of edits.

Conversations of up to most_rows rows are answered in their own row. Longer ones are never brought together: their rows are dealt by ranges of turns and cut into segments of most_rows rows. Each segment gives its transfer matrix,
the least weight from each state of the grammar before it to each state after it (each string there ends with a row's edit, so none is a beginning of another, and the least one stays the least under what follows). Matrices are
multiplied onto the end's weights, last segment first, as a stream; the string is cut into the segments' own parts, and each segment is rewritten by itself. The digest of a long conversation reads its rewritten segments in order, as a
stream in one task: SHA-256 cannot be split. Only one segment, the digest and the string of edits are held.

Faults: blank (no character but \x20 and \x09-\x0D), duplicate (role and text stood earlier), truncated (the last such character is none of .!?); the first of them counts. A duplicate is found by the first place of each role and
text hash, so a hot text is combined before the shuffle.

Defined results: null roles and texts are one blank; null turns come first and count in no gap; rows of one turn lie by role and text, repeated rows are rows of their own. Rows with a null conv_id are one conversation. A role that
begins with none of s, u, a (an empty one too) is legal nowhere. A conversation without rows has zeros, an empty audit and the hash of nothing. Texts of any length are read whole. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches, stage

MOST_ROWS = 128
#: States of the role grammar: 0 at the start, 1 after s, 2 after u, 3 after a; where an initial leads, and where the sequence may end.
GOES, ENDS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, (0, 3)
STATES = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: A row's symbol: by its fault, then by its role's initial (x: another).
INITIALS = "suax"
SYMBOLS = {"": "suax", "truncated": "SUAX", "blank": "0123", "duplicate": "4567"}
INITIAL_OF = {c: INITIALS[i] for symbols in SYMBOLS.values() for i, c in enumerate(symbols)}
FAULT_OF = {c: fault for fault, symbols in SYMBOLS.items() for c in symbols}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"

Weight = tuple[int, str] | None  # None: no path


def least(weights: Iterable[Weight]) -> Weight:
    return min((w for w in weights if w is not None), default=None)


def then(cost: int, label: str, rest: Weight) -> Weight:
    return None if rest is None else (cost + rest[0], label + rest[1])


def arcs(symbol: str, state: int) -> Iterator[tuple[int, str, int]]:
    """Cost, label and next state of what the edit transducer and the grammar do with a row's symbol."""
    yield 4, "D", state
    if symbol.isdigit():
        return  # blank or duplicate
    more = 3 if symbol.isupper() else 0
    if (state, symbol.lower()) in GOES:
        yield more, "K", GOES[state, symbol.lower()]
    yield from ((3 + more, "R", GOES[state, role]) for role in NAMES if (state, role) in GOES)


def inserts(state: int) -> Iterator[int]:
    yield from (GOES[state, role] for role in NAMES if (state, role) in GOES)


def with_inserts(weights: list[Weight]) -> list[Weight]:
    """Weights of the states before up to two inserts."""
    once = [least([weights[g], *(then(3, "I", weights[to]) for to in inserts(g))]) for g in STATES]
    return [least([weights[g], *(then(3, "I", once[to]) for to in inserts(g))]) for g in STATES]


def before(symbols: str, weights: list[Weight]) -> list[Weight]:
    """Least weights from each state before the rows, when `weights` lead on from each state after them."""
    for symbol in reversed(symbols):
        weights = with_inserts([least(then(cost, label, weights[to]) for cost, label, to in arcs(symbol, g)) for g in STATES])
    return weights


AT_END = with_inserts([(0, "") if g in ENDS else None for g in STATES])


def matrix(symbols: str) -> list[list[Weight]]:
    """matrix[g][h]: the least weight from g before a segment's rows to h right after its last row."""
    columns = [before(symbols, [(0, "") if g == h else None for g in STATES]) for h in STATES]
    return [[columns[h][g] for h in STATES] for g in STATES]


def onto(m: list[list[Weight]], weights: list[Weight]) -> list[Weight]:
    """The weights before a segment from those after it."""
    return [least(then(*m[g][h], weights[h]) for h in STATES if m[g][h] is not None) for g in STATES]


@lru_cache(100_000)
def cheapest(symbols: str) -> tuple[int, str]:
    return before(symbols, AT_END)[0]


def walk(audit: str, state: int, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of what the edits make of the rows, from a state of the grammar on."""
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else "a" if state == 2 else "u"
        yield (role if edit == "K" else NAMES[initial]), text
        state = GOES[state, initial]


def after(audit: str, state: int, symbols: str) -> int:
    """The state after a segment's edits."""
    left = iter(symbols)
    for edit in audit:
        symbol = "" if edit == "I" else next(left)
        if edit != "D":
            state = GOES[state, symbol.lower() if edit == "K" else "a" if state == 2 else "u"]
    return state


def symbols_of(rows: list[tuple[str, str]]) -> str:
    """The symbols of all rows of a conversation."""
    seen, out = set(), []
    for role, text in rows:
        inner = text.strip(SPACE)
        fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(SYMBOLS[fault][INITIALS.find(role[:1] or "x")])
    return "".join(out)


def counted(symbols: str) -> dict[str, int]:
    """blank, duplicate, truncated and illegal of a conversation's symbols."""
    faults, roles = [FAULT_OF[c] for c in symbols], "".join(INITIAL_OF[c] for c in symbols)
    return {f: faults.count(f) for f in ("blank", "duplicate", "truncated")} | {"illegal": sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))}


def _line(turn: tuple[str, str]) -> str:
    return f"{turn[0]}:{turn[1]}"


ANSWER = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, segment long, turns array<struct<role:string,text:string>>"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _batches(function, **kinds: pa.DataType):
    """A function for mapInArrow: `function` turns rows (dicts) into rows; every 500 of them are a batch."""
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for made in function(row for b in batches for row in b.to_pylist()):
            held.append(made)
            if len(held) == 500:
                yield pa.RecordBatch.from_pylist(held, schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    return run


_NUMBERS = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), pa.int64())


def _short_answers(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        symbols, numbers = symbols_of(turns), {t["turn"] for t in r["turns"]} - {None}
        cost, audit = cheapest(symbols)
        digest = hashlib.sha256("\n".join(map(_line, walk(audit, 0, turns))).encode()).hexdigest()
        yield {"conv_id": r["conv_id"], "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **counted(symbols), "cost": cost, "audit": audit, "repaired_sha256": digest}


def _short_turns(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        turns = [(t["role"], t["text"]) for t in r["turns"]]
        made = walk(cheapest(symbols_of(turns))[1], 0, turns)
        yield {"conv_id": r["conv_id"], "segment": 0, "turns": [{"role": role, "text": text} for role, text in made]}


def _matrices(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        cells = [w for line in matrix(r["symbols"]) for w in line]
        yield r | {"costs": [None if w is None else w[0] for w in cells], "labels": [None if w is None else w[1] for w in cells]}


def _chained(rows: Iterator[dict]) -> Iterator[dict]:
    """From segments by conversation, last first: each segment's state and edits, and (with a null segment) the conversation's own."""
    held, key = [], object()
    weights: list[Weight] = AT_END

    def finish() -> Iterator[dict]:
        if not held:
            return
        cost, audit = weights[0]
        state, at, symbols = 0, 0, "".join(s for _, s in reversed(held))
        yield {"conv_id": key, "segment": None, "state": 0, "audit": audit, "cost": cost, **counted(symbols)}
        for n, (segment, own) in enumerate(reversed(held)):
            stop = len(audit) if n == len(held) - 1 else re.compile(f"(?:I*[KRD]){{{len(own)}}}").match(audit, at).end()
            yield {"conv_id": key, "segment": segment, "state": state, "audit": audit[at:stop], "cost": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            state, at = after(audit[at:stop], state, own), stop

    for r in rows:
        if not held or r["conv_id"] != key:
            yield from finish()
            held, key, weights = [], r["conv_id"], AT_END
        held.append((r["segment"], r["symbols"]))
        weights = onto([[None if r["costs"][4 * g + h] is None else (r["costs"][4 * g + h], r["labels"][4 * g + h]) for h in STATES] for g in STATES], weights)
    yield from finish()


def _rewritten(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        made = walk(r["audit"], r["state"], ((t["role"], t["text"]) for t in r["rows"]))
        yield {"conv_id": r["conv_id"], "segment": r["segment"], "turns": [{"role": role, "text": text} for role, text in made]}


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """From rewritten segments by conversation, first to last."""
    key, digest = object(), None
    for r in rows:
        if digest is None or r["conv_id"] != key:
            if digest is not None:
                yield {"conv_id": key, "repaired_sha256": digest.hexdigest()}
            key, digest, any_ = r["conv_id"], hashlib.sha256(), False
        for t in r["turns"]:
            digest.update((("\n" if any_ else "") + _line((t["role"], t["text"]))).encode())
            any_ = True
    if digest is not None:
        yield {"conv_id": key, "repaired_sha256": digest.hexdigest()}


def _key() -> Column:
    """A conversation's key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _symbol() -> Column:
    """symbols_of() of a row of a long conversation; `first`: whether no equal row stands before it."""
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("first"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z"), "truncated").otherwise("")
    place = F.lit(len(INITIALS))
    for n, c in enumerate(INITIALS[:3], 1):
        place = F.when(F.startswith("role", F.lit(c)), n).otherwise(place)
    letters = F.lit("")
    for name, symbols in SYMBOLS.items():
        letters = F.when(fault == name, symbols).otherwise(letters)
    return F.substring(letters, place, F.lit(1))


def _segments(rows: DataFrame, n_rows: int, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of long conversations with key and segment, the staged plan of their edits by segment)."""
    parts = max(1, ceil(n_rows / (64 * most_rows)))
    ordered = rows.repartitionByRange(parts, "conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = stage(ordered.withColumn("n", F.monotonically_increasing_id()), "turns").withColumn("segment", F.expr(f"n div {most_rows}")).withColumn("key", _key())
    first = placed.groupBy("key", "role", F.sha2("text", 256)).agg(F.min("n").alias("n")).select("n", F.lit(True).alias("first"))
    flagged = placed.select("n", "key", "conv_id", "segment", "role", "text").join(first, "n", "left").withColumn("first", F.coalesce("first", F.lit(False)))
    symbols = flagged.select("key", "conv_id", "segment", "n", _symbol().alias("symbol")).groupBy("key", "conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "symbol"))).alias("s"))
    joined = symbols.select("conv_id", "segment", F.array_join(F.transform("s", lambda x: x["symbol"]), "").alias("symbols"))
    kinds = {"conv_id": pa.int64(), "segment": pa.int64(), "symbols": pa.string(), "costs": pa.list_(pa.int64()), "labels": pa.list_(pa.string())}
    matrices = joined.mapInArrow(_batches(_matrices, **kinds), "conv_id long, segment long, symbols string, costs array<long>, labels array<string>")
    chained = matrices.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")).mapInArrow(
        _batches(_chained, conv_id=pa.int64(), segment=pa.int64(), state=pa.int64(), audit=pa.string(), **_NUMBERS), "conv_id long, segment long, state long, audit string, blank long, duplicate long, truncated long, illegal long, cost long"
    )
    return placed, stage(chained.withColumn("key", _key()), "edits")


def _long_turns(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """Rewritten segments of long conversations."""
    together = placed.groupBy("key", "conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text"))).alias("rows"))  # most_rows rows at most
    met = together.join(edits.where("segment IS NOT NULL").select("key", "segment", "state", "audit"), ["key", "segment"]).select("conv_id", "segment", "state", "audit", "rows")
    return met.mapInArrow(_batches(_rewritten, conv_id=pa.int64(), segment=pa.int64(), turns=_TURNS), TURNS)


def _split(rows: DataFrame, present: Column, most_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows of short conversations, of long ones, the long ones' keys, number of their rows)."""
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), present.alias("present")).withColumn("key", _key())
    long = stage(clean.groupBy("key", "conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most_rows), "long-conversations")
    size = long.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    keys = F.broadcast(long.select("key")) if size["keys"] <= 1_000_000 else long.select("key")
    return clean.join(keys, "key", "left_anti"), clean.join(keys, "key", "left_semi"), long, size["rows"]


def _short(rows: DataFrame) -> DataFrame:
    turn = F.when(F.col("present"), F.struct("turn", "role", "text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))  # most_rows input rows at most


def repair(rows: DataFrame, present: Column | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """ANSWER of every conversation of rows (conv_id, turn, role, text); rows that are not present only name their conversation."""
    small_batches(rows.sparkSession)
    short, long, keys, n_long = _split(rows, F.lit(True) if present is None else present, most_rows)
    kinds = {"conv_id": pa.int64(), "gaps": pa.int64(), **_NUMBERS, "audit": pa.string(), "repaired_sha256": pa.string()}
    answers = _short(short).mapInArrow(_batches(_short_answers, **kinds), ANSWER)
    if not n_long:
        return answers
    placed, edits = _segments(long.where("present").drop("present", "key"), n_long, most_rows)
    turns = _long_turns(placed, edits).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    digests = turns.mapInArrow(_batches(_digests, conv_id=pa.int64(), repaired_sha256=pa.string()), "conv_id long, repaired_sha256 string").select(_key().alias("key"), "repaired_sha256")
    span = placed.select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = keys.select("key", "conv_id").join(edits.where("segment IS NULL").drop("conv_id", "segment", "state"), "key", "left").join(span, "key", "left").join(digests, "key", "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    filled = found.select("conv_id", *[F.coalesce(F.col(c), nothing.get(c, F.lit(0))).alias(c) for c in ANSWER.replace(",", "").split()[2::2]])
    return answers.unionByName(filled)


def repaired_turns(rows: DataFrame, present: Column | None = None, most_rows: int = MOST_ROWS) -> DataFrame:
    """conv_id, place (in order within a conversation), role and text of every turn after the repair."""
    small_batches(rows.sparkSession)
    short, long, _, n_long = _split(rows, F.lit(True) if present is None else present, most_rows)
    made = _short(short).mapInArrow(_batches(_short_turns, conv_id=pa.int64(), segment=pa.int64(), turns=_TURNS), TURNS)
    if n_long:
        made = made.unionByName(_long_turns(*_segments(long.where("present").drop("present", "key"), n_long, most_rows)))
    return made.select("conv_id", "segment", F.posexplode("turns").alias("at", "t")).select("conv_id", F.struct("segment", "at").alias("place"), "t.role", "t.text")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and present of rows under the five kinds of damage that crc32(conv_id:turn) % 20 names."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy")).drop("copy")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair(rows, F.col("present"))


QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLES: dict[str, str] = {}
