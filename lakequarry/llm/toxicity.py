"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps homoglyphs (full-width, Greek and Cyrillic look-alikes) to Latin letters and digits and signs to the letters they stand for, and makes
every other character a blank. Patterns are whole words and beginnings of words, so they start at a blank. Exception phrases of two words take
away the matches that lie within them. The sum of the matches' weights is normalised by the number of words, and a logistic curve gives a score from 0 to 1.

The lexicon and its weights are learned from labelled documents: a word or beginning of words is taken when its rate per word in toxic documents is
min_ratio times its rate in others or more and one in 50 of them (5 at least) has it, and weighs the logarithm of that ratio. An exception is a pair of neighbouring words, one of them matched, that one in 500 of the other
documents (3 at least) has and that is exception_ratio times rarer in toxic ones, half a toxic document added. The model is fitted on a bounded sample: about max_labelled labelled rows at most, chosen by a hash of doc_id. Its size is bounded too:
of the toxic documents' patterns the most_candidates commonest are weighed, the lexicon patterns that gain most are kept, and the most_exceptions commonest exceptions; rarer ones of a larger vocabulary are left out. Every document is scored, over its
whole text, however long.

Defined results: a null or empty text has no match and gets the curve's value at 0. Null labels and null doc_ids are not learned from. Without toxic examples to
learn from the lexicon is empty and every score is 0. Equal texts get equal scores. Repeated rows stay; an empty table gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage

# Characters that look like Latin letters or stand for them.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}
LETTERS = "".join(chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x180)))
SHORTEST, LONGEST = 4, 10


class _Fold(dict):
    """For str.translate: each character by rule, kept once seen."""

    def __missing__(self, code: int) -> str:
        c = chr(code - 0xFEE0) if 0xFF01 <= code <= 0xFF5E else chr(code)
        c = c.lower()
        c = LOOK_ALIKES.get(c, c)
        self[code] = found = c if c in LETTERS or len(c) > 1 else c if c.isalpha() else " "
        return found


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Words with one blank before each and one at the end."""
    return " " + " ".join((text or "").translate(_FOLD).split()) + " "


def features(word: str) -> set[str]:
    """Patterns of a folded word: itself (with its end) and its beginnings."""
    found = {f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1)}
    if 3 <= len(word) <= 24:
        found.add(f" {word} ")
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # by pattern
    curve: tuple[float, ...]  # of 1, log rate, log words
    exceptions: tuple[str, ...] = ()  # folded phrases

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for p, w in self.weights.items():
            found.add_word(p, (len(p), w))
        for p in self.exceptions:
            found.add_word(fold(p), (len(fold(p)), None))
        if len(found):
            found.make_automaton()
        return found


def match(automaton, text: str | None) -> tuple[float, int, int]:
    """(weight, matches, words) of a text; of matches that begin with the same word, the heaviest counts."""
    folded = fold(text)
    words = folded.count(" ") - 1 if len(folded) > 2 else 0
    if not words or not len(automaton):
        return 0.0, 0, words
    hits: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        else:
            hits[start] = max(hits.get(start, 0.0), weight)
    for a, b in excused:
        for start in [s for s in hits if a <= s < b]:
            del hits[start]
    return float(sum(hits.values())), len(hits), words


def scores(model: Model, found: np.ndarray) -> np.ndarray:
    """Scores of rows (weight, matches, words)."""
    if not model.weights:
        return np.zeros(len(found))
    return 1 / (1 + np.exp(-np.clip(_inputs(found) @ np.array(model.curve), -30, 30)))


def _inputs(found: np.ndarray) -> np.ndarray:
    weight, words = found[:, 0], found[:, 2]
    return np.column_stack([np.ones(len(found)), np.log(weight / (words + 10) + 1e-3) - np.log(1e-3), np.log1p(words), (weight == 0) * 1.0])


def _fit_curve(found: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """A logistic curve by Newton steps with a small ridge."""
    x, beta = _inputs(found), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (toxic - p) - 1e-2 * beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(4), slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def _count(rows: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """feature, n (times), d (documents) over rows (text), and the feature "" with n words; wanted: only these."""
    chosen = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, d, words = Counter(), Counter(), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                own = Counter(fold(text).split())
                words += own.total()
                seen = Counter()
                for w, k in own.items():
                    for f in features(w):
                        if chosen is None or f in chosen:
                            seen[f] += k
                n.update(seen)
                d.update(seen.keys())
        n[""] = words
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[f] for f in n], pa.int64())], ["feature", "n", "d"])

    return rows.select("text").mapInArrow(run, "feature string, n long, d long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _phrases(sample: DataFrame, model: Model) -> DataFrame:
    """phrase, toxic and n: how many documents of each kind have each pair of words around a match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            out: Counter = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                out.update((p, toxic == 1) for p in phrases_of(automaton, text))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.bool_()), pa.array(list(out.values()), pa.int64())], ["phrase", "toxic", "n"])

    return sample.select("text", "toxic").mapInArrow(run, "phrase string, toxic boolean, n long").groupBy("phrase").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("o"))


def phrases_of(automaton, text: str | None) -> set[str]:
    """The pairs of neighbouring words of a text of which one is matched."""
    folded = fold(text)
    found = set()
    for end, (size, _) in automaton.iter(folded):
        start = end - size + 1  # a blank; the word ends at the next one
        after = folded.find(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        if before >= 0:
            found.add(folded[before + 1 : after])
        if (next_ := folded.find(" ", after + 1)) >= 0:
            found.add(folded[start + 1 : next_])
    return found


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, most_candidates: int = 20_000, min_ratio: float = 8.0, lexicon: int = 400, exception_ratio: float = 2.0, most_exceptions: int = 1_000) -> Model:
    """A model from labelled rows that are not held out; max_labelled bounds the sample (on average: rows are chosen by a hash)."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_labelled / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")  # at most max_labelled ids of 8 bytes
    toxic, other = sample.where("toxic = 1"), sample.where("toxic <> 1")
    n_toxic = toxic.count()
    least = max(5, n_toxic // 50)
    # features of toxic documents that enough of them have; most_candidates of them at most come to the driver
    candidates = {r.feature: (r.n, r.d) for r in _count(toxic, None).where((F.col("d") >= least) | (F.col("feature") == "")).orderBy(F.col("feature") != "", F.desc("n"), "feature").limit(most_candidates).collect()}
    against = {r.feature: r.n for r in _count(other, candidates).collect()}
    toxic_words, other_words = max(1, candidates.pop("", (0, 0))[0]), max(1, against.get("", 0))
    gains = []
    for f, (n, _) in candidates.items():
        ratio = ((n + 0.5) / toxic_words) / ((against.get(f, 0) + 0.5) / other_words)
        if ratio >= min_ratio:
            gains.append((n * float(np.log(ratio)), f, float(np.log(ratio))))
    weights: dict[str, float] = {}
    for _, f, weight in sorted(gains, key=lambda g: (-round(g[0], 6), -len(g[1]), g[1])):
        if len(weights) < lexicon and not any(f.startswith(x) or x.startswith(f) for x in weights):
            weights[f] = weight
    if not weights:
        return Model({}, (0.0,) * 4)
    model = Model(weights, (0.0,) * 4)
    n_other = max(1, other.count())
    harmless = _phrases(sample, model).where((F.col("o") >= max(3, n_other // 500)) & (F.col("o") / F.lit(n_other) >= (F.col("t") + 0.5) * F.lit(exception_ratio / max(1, n_toxic))))
    model = Model(weights, model.curve, tuple(r.phrase for r in harmless.orderBy(F.desc("o"), "phrase").limit(most_exceptions).collect()))
    found = _matched(sample, model).select("weight", "matches", "n_words", "toxic").toPandas()  # at most max_labelled rows of numbers
    return Model(weights, exceptions=model.exceptions, curve=_fit_curve(found[["weight", "matches", "n_words"]].to_numpy(float), (found["toxic"] == 1).to_numpy(float)))


def _matched(rows: DataFrame, model: Model) -> DataFrame:
    """rows without text, with weight, matches, n_words and score."""
    others = [f for f in rows.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for b in batches:
            if not b.num_rows:
                continue
            found = np.array([match(automaton, t.as_py()) for t in b.column("text")], float).reshape(-1, 3)
            columns = [pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int64)), pa.array(found[:, 2].astype(np.int64)), pa.array(scores(model, found))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), *columns], [*(f.name for f in others), "weight", "matches", "n_words", "score"])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "weight double, matches long, n_words long, score double"])
    return rows.mapInArrow(run, kinds)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, weight, matches, n_words, score and predicted (1 from 0.5 on) of docs (doc_id, text)."""
    found = _matched(docs.select("doc_id", "text"), model)
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "matches", "n_words")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
